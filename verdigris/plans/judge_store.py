"""Judge jobs in the shared store: a key is asked for once at most, over actions, retries and runs.

Three append-only tables. `claims` says which batch may ask for a key; it is written before any call, under a lock, so two runs
never claim the same key. `verdicts` has what the judge said, written by the one pass over the batch that calls. `jobs` has a row for each
row that was graded, with the job that its verdict comes from. Whatever is returned reads these tables: counting,
writing or regrading a result calls nobody.

A batch is read from its own file without a shuffle, and only a task's first attempt calls: what a later attempt finds has no verdict,
like what a lost driver was asking. Such claims stay open until a human releases them.
"""

import uuid
from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ledger
from ..operators.grading import Judge
from ..session import bounded_batches
from ..storage import exists, exclusive

CLAIMS = "cache_key string, batch string, state string, at timestamp"
VERDICTS = "cache_key string, judge_job_id string, judge_text string, completed_at timestamp"
JOBS = "judge_job_id string, run_id string, task string, grader string, profile string, cache_key string, status string, cache_source_job_id string, created_at timestamp"


def calling(ask: Callable[[dict], str | None]) -> Judge:
    """A judge that calls ask(row) in a task's first attempt; a later attempt can't know what the first has sent, and gives no text."""

    def judge(rows: DataFrame) -> DataFrame:
        bounded_batches(rows.sparkSession)

        def run(frames):
            context = TaskContext.get()
            again = context is not None and context.attemptNumber() > 0
            for frame in frames:
                yield frame.assign(judge_text=[None if again else ask(row) for row in frame.to_dict("records")])

        return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("judge_text", T.StringType())]))

    return judge


class JudgeLedger:
    """The jobs of one grader and judge profile in a store; parts are the columns that decide a verdict."""

    def __init__(self, spark: SparkSession, store: str, grader: str, profile: str, parts: tuple[str, ...] = ("task_id", "reference_answer", "final_answer")):
        self.spark, self.store, self.grader, self.profile, self.parts = spark, store.rstrip("/"), grader, profile, parts

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.store}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def verdicts(self) -> DataFrame:
        """The latest verdict of each key."""
        return ledger.latest(self._table("verdicts", VERDICTS), ["cache_key"], ["completed_at", "judge_job_id"])

    def jobs(self) -> DataFrame:
        return self._table("jobs", JOBS)

    def claims(self) -> DataFrame:
        """The state of each key that was ever claimed; of one moment a release counts."""
        return ledger.latest(self._table("claims", CLAIMS), ["cache_key"], ["at", "state"]).where("state = 'claimed'")

    def open_claims(self) -> DataFrame:
        """Claimed keys without a verdict: their outcome is unknown, or their batch is still running."""
        return self.claims().join(self.verdicts().select("cache_key"), "cache_key", "left_anti")

    def release(self, keys: DataFrame) -> None:
        """Let the open claims among these (cache_key) be asked for again."""
        with exclusive(self.spark, f"{self.store}/lock"):
            mine = self.open_claims().join(keys.select("cache_key").distinct(), "cache_key", "left_semi")
            mine.select("cache_key", "batch", F.lit("released").alias("state"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.store}/claims")

    def keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("cache_key", ledger.cache_key(F.lit(self.grader).alias("grader"), F.lit(self.profile).alias("profile"), *self.parts))

    def _claim(self, rows: DataFrame) -> DataFrame:
        """The rows that are asked for now, one for each key that nobody has claimed: written, and claimed before they are returned."""
        batch = uuid.uuid4().hex
        path = f"{self.store}/batches/{batch}"
        with exclusive(self.spark, f"{self.store}/lock"):
            new = rows.join(self.claims().select("cache_key"), "cache_key", "left_anti")
            columns = [c for c in new.columns if c != "cache_key"]
            first = new.groupBy("cache_key").agg(F.min(F.struct(*columns)).alias("_row")).select("cache_key", "_row.*")
            first.write.parquet(path)
            fixed = self.spark.read.schema(first.schema).parquet(path)
            fixed.select("cache_key", F.lit(batch).alias("batch"), F.lit("claimed").alias("state"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.store}/claims")
        return fixed

    def ask(self, rows: DataFrame, judge: Judge, run_id: str, task: str = "task_id") -> DataFrame:
        """rows with cache_key, judge_text, cache_hit and cache_source_job_id. judge_text is null where the outcome is unknown.

        Rows with equal keys share a verdict: the first of this run's own calls is no hit, whatever comes from earlier is.
        """
        keyed = self.keyed(rows)
        batch = self._claim(keyed)
        said = judge(batch).where("judge_text is not null").select("cache_key", F.expr("uuid()").alias("judge_job_id"), "judge_text", F.current_timestamp().alias("completed_at"))
        said.write.mode("append").parquet(f"{self.store}/verdicts")
        own = batch.select("cache_key", F.lit(True).alias("_own"))
        out = keyed.join(self.verdicts().withColumnRenamed("judge_job_id", "cache_source_job_id"), "cache_key", "left").join(own, "cache_key", "left")
        out = out.withColumn("cache_hit", F.col("_own").isNull() & F.col("judge_text").isNotNull()).drop("_own", "completed_at")
        done = F.when(F.col("judge_text").isNull(), "UNKNOWN").otherwise("COMPLETED")
        jobs = out.select(F.expr("uuid()").alias("judge_job_id"), F.lit(run_id).alias("run_id"), F.col(task).cast("string").alias("task"), F.lit(self.grader).alias("grader"), F.lit(self.profile).alias("profile"),
                          "cache_key", done.alias("status"), F.when(F.col("cache_hit"), F.col("cache_source_job_id")).alias("cache_source_job_id"), F.current_timestamp().alias("created_at"))
        jobs.write.mode("append").parquet(f"{self.store}/jobs")
        return out

    def judge(self, judge: Judge, run_id: str, task: str = "task_id") -> Judge:
        """A judge for the graders of `grading` that asks through this ledger."""
        return lambda rows: self.ask(rows, judge, run_id, task).select(*rows.columns, "judge_text")
