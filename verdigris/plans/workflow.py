"""The run, grade and report pipelines over DataFrames.

Systems are called once at most: outside calls go through `once`, which writes an
intent ledger before and the outcome after. Only the first attempt of a task calls. When Spark runs a task again, whether it
failed or was slow, it can't know which rows were sent before, so it sends none and hands its rows to a human.
Judges are asked once at most where `grade` is given a ledger (judge_store.JudgeLedger); a judge without one is a lazy step of the plan,
and runs with every action.
"""

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim, page_text
from ..operators import citations, grading, ledger, metrics, selection, state
from ..storage import exists
from .judge_store import JudgeLedger

Adapter = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
RESULT = "task_id string, status string, answer string, error string"


def select_tasks(tasks: DataFrame, chosen) -> DataFrame:
    """A config.Selection applied: listed ids in their order, else seeded order."""
    mine = tasks.where(F.col("split") == chosen.split)
    if chosen.ids:
        return selection.select_ids(mine, list(chosen.ids))
    return selection.select_seeded(mine, chosen.seed, chosen.limit)


def fixture_run(requests: DataFrame) -> DataFrame:
    """Results of the deterministic stand-in system."""
    return requests.select("task_id", F.lit("completed").alias("status"), selection.fixture_answer(F.col("task_id"), F.col("prompt")).alias("answer"), F.lit(None).cast("string").alias("error"))


def first_attempt_only(adapter: Adapter) -> Adapter:
    """The adapter for the first attempt of each task; a later attempt gives its rows back as in need of a human."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        if context is None or not context.attemptNumber():
            yield from adapter(batches)
            return
        for batch in batches:
            yield pd.DataFrame({"task_id": batch["task_id"], "status": "needs_human_verification", "answer": None, "error": "the task ran again: outcome unknown"})

    return run


def once(requests: DataFrame, adapter: Adapter, store: str) -> DataFrame:
    """Results of an outside system. A request with a written intent and no outcome is not sent again: it needs a human.

    The batch is read from its own file without a shuffle, so no stage but a task's attempt is ever repeated.
    """
    spark = requests.sparkSession
    intents, outcomes = f"{store}/intents", f"{store}/outcomes"

    def stored(path: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)

    known = stored(intents, "task_id string")
    rest = [c for c in requests.columns if c != "task_id"]
    single = requests.groupBy("task_id").agg(F.min(F.struct(F.lit(0).alias("_"), *rest)).alias("_r")).select("task_id", *[f"_r.{c}" for c in rest]).select(requests.columns)  # a repeated task is one call
    new = single.join(known, "task_id", "left_anti")
    batch = f"{store}/batch-{uuid.uuid4().hex}"
    new.write.parquet(batch)
    fixed = spark.read.schema(requests.schema).parquet(batch)
    fixed.select("task_id").write.mode("append").parquet(intents)
    fixed.mapInPandas(first_attempt_only(adapter), RESULT).write.mode("append").parquet(outcomes)
    done = stored(outcomes, RESULT)
    lost = requests.select("task_id").join(done, "task_id", "left_anti")
    unsure = lost.select("task_id", F.lit("needs_human_verification").alias("status"), F.lit(None).cast("string").alias("answer"), F.lit("outcome unknown").alias("error"))
    return done.join(requests.select("task_id"), "task_id", "left_semi").unionByName(unsure)


def case_states(results: DataFrame) -> DataFrame:
    """The case state that each result leads to."""
    return results.withColumn("state", F.coalesce(state.failure_state(F.col("status"), F.col("answer")), F.lit("READY_FOR_GRADING")))


def grade(cases: DataFrame, gold: DataFrame, judge: grading.Judge, style: str = "chinese", ledger_of: JudgeLedger | None = None, run_id: str = "") -> DataFrame:
    """Scores of gradable cases: gold joins here and nowhere before. With a ledger the judge is asked now, once for each key that has no verdict yet."""
    judge = ledger_of.judge(judge, run_id) if ledger_of else judge
    ready = cases.where(F.col("state").isin(state.GRADABLE)).select("task_id", F.col("answer").alias("final_answer"))
    graded = grading.short_fact(ready.join(gold.select("task_id", "reference_answer"), "task_id", "left"), judge, style)
    status = F.when(F.col("error").isNull(), "scored").otherwise("failed")
    value = F.when(F.col("error").isNull(), F.when(F.col("conclusion") == "correct", "1").otherwise("0"))
    return graded.select("task_id", F.lit("short_fact_accuracy").alias("metric_id"), status.alias("status"), value.alias("value_json"), "exact", "error")


def report(scores: DataFrame, cases: DataFrame, keys: tuple[str, ...] = ("task_id", "metric_id"), order: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(metrics, case counters) of a run; of scores written more than once the latest count."""
    now = ledger.latest(scores, list(keys), list(order)) if order else scores
    return metrics.metric_report(now), metrics.case_counters(cases.select(F.col("state").alias("status")))


def resume(cases: DataFrame) -> DataFrame:
    """cases with the action that a resumed run takes."""
    return cases.withColumn("action", state.resume_action(F.col("state")))


def refreshed_citations(old: DataFrame, new: DataFrame) -> DataFrame:
    """New citations of cases whose answer is unchanged but for white space; the others are refused."""
    both = old.select("case_id", F.col("answer").alias("_old")).join(new, "case_id")
    same = page_text(js_trim(F.col("_old"))) == page_text(js_trim(F.col("answer")))
    return both.withColumn("accepted", same).drop("_old")


overlay = citations.overlay
