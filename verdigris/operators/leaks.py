"""Checks of datasets: leaked answers, gold fields in tasks, and ids that don't agree."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import matching

#: Keys that belong to gold records only.
GOLD_KEYS = ["reference_answer", "acceptable_answers", "unacceptable_answers", "answer", "canary", "official_grader_payload"]
LEAST_ANSWER = 8
#: What graders' prompts and gold records say, and tasks never do.
MARKERS = ["JUDGE_PROMPT", "extracted_final_answer", "reference_steps", "reference_answer"]


def leaked_keys(tasks: DataFrame, raw: str, key: str = "task_id") -> DataFrame:
    """Gold keys that a task's JSON has."""
    found = F.array_intersect(F.json_object_keys(raw), F.array(*[F.lit(k) for k in GOLD_KEYS]))
    return tasks.select(key, found.alias("leaked")).where(F.size("leaked") > 0)


def answer_in_prompt(tasks: DataFrame, gold: DataFrame, prompt: str, answer: str, key: str = "task_id") -> DataFrame:
    """Tasks whose own answer, of 8 characters and more, stands in their prompt."""
    joined = tasks.join(gold, key)
    return joined.where((F.length(answer) >= LEAST_ANSWER) & F.col(prompt).contains(F.col(answer)))


def corpus_leaks(docs: DataFrame, answers: DataFrame, doc_id: str, text: str, item_id: str, answer: str, **sizes: int) -> DataFrame:
    """(doc_id, item_id) where a document contains an answer in full. Blank answers leak nothing; any number of answers of any length will do.

    One pass over whole texts for each part of the answers that can be broadcast (matching.contained); pairs of repeated rows are repeated.
    """
    some = answers.where(F.col(answer).rlike(r"[^\x20\x09-\x0D]"))
    return matching.contained(docs, some, text, item_id, answer, doc_id, **sizes)


def leaked_markers(rows: DataFrame, raw: str, key: str = "task_id", markers: Sequence[str] = MARKERS) -> DataFrame:
    """(key, marker) for each literal marker of graders that stands anywhere in a record's text."""
    listed = rows.sparkSession.createDataFrame([(m, m) for m in dict.fromkeys(markers)], "marker string, text string")
    return matching.contained(rows, listed, raw, "marker", "text", key)


def id_parity(tasks: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Ids that occur on one side only, or more than once: (key, in_tasks, in_gold, problem)."""
    a = tasks.groupBy(key).agg(F.count(F.lit(1)).alias("in_tasks"))
    b = gold.groupBy(key).agg(F.count(F.lit(1)).alias("in_gold"))
    both = a.join(b, key, "full").na.fill(0, ["in_tasks", "in_gold"])
    problem = F.when(F.col("in_gold") == 0, "missing_gold").when(F.col("in_tasks") == 0, "missing_task").when((F.col("in_tasks") > 1) | (F.col("in_gold") > 1), "duplicate")
    return both.withColumn("problem", problem).where("problem is not null")


def broken_references(rows: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Rows whose foreign key no parent has."""
    return rows.join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")
