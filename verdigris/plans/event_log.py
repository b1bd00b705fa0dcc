"""An append-only event log whose numbers go on where the stored ones end.

A batch is written under its id together with the last number of each key that it touches, and counts from the moment its commit mark is
there: a batch that was lost half-way is invisible, and writing it again replaces it; one that is committed is never written twice.
Events that are in the log already are left out, whatever batch brings them. Numbers come from places in one range-partitioned
order, so a key with very many events (events of the run itself, say) is in no single task; and only last numbers are read to go on, not the log.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import js_trim, page_text
from ..operators.selection import numbered
from ..storage import children, discard, exclusive, exists, touch

KEYS = ("run_id", "case_id", "attempt_id")


def joined(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """left with the other columns of right, where all keys agree; null agrees with null."""
    renamed = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(renamed, same, "left").drop(*[f"_{k}" for k in keys])


class EventLog:
    """Events (event_id, keys, order, ...) in a store, with seq from 0 for each key; null keys are a key like any other."""

    def __init__(self, spark: SparkSession, store: str, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ("created_at", "event_id")):
        self.spark, self.store, self.keys, self.order = spark, store.rstrip("/"), tuple(keys), tuple(order)

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        path = f"{self.store}/commits"
        return sorted(children(self.spark, path)) if exists(self.spark, path) else []

    def _read(self, name: str) -> DataFrame | None:
        found = self.batches()
        return self.spark.read.parquet(*[f"{self.store}/{name}/{b}" for b in found]) if found else None

    def read(self) -> DataFrame:
        """All committed events with their numbers."""
        found = self._read("log")
        if found is None:
            raise ValueError(f"no batch has been committed in {self.store}")
        return found

    def last(self) -> DataFrame | None:
        """(keys, last): the last number of each key."""
        heads = self._read("heads")
        return None if heads is None else heads.groupBy(*self.keys).agg(F.max("last").alias("last"))

    def append(self, events: DataFrame, batch: str) -> int:
        """Append a batch; how many events are new. A repeated event of the batch counts once (of two with one id the least), null ids are refused."""
        with exclusive(self.spark, f"{self.store}/lock"):
            if batch in self.batches():
                return 0
            checked = events.withColumn("event_id", F.when(F.col("event_id").isNotNull(), F.col("event_id")).otherwise(F.raise_error(F.lit("an event has no id")).cast(events.schema["event_id"].dataType)))
            rest = [c for c in events.columns if c != "event_id"]
            new = checked.groupBy("event_id").agg(F.min(F.struct(*rest)).alias("_e")).select("event_id", "_e.*").select(events.columns)
            old, last = self._read("log"), self.last()
            if old is not None:
                new = new.join(old.select("event_id"), "event_id", "left_anti")
            by = [*self.keys, *(c for c in self.order if c not in self.keys)]
            placed = numbered(new, by)
            first = placed.groupBy(*self.keys).agg(F.min("ordinal").alias("_first"), F.count(F.lit(1)).alias("_n"))
            base = first.withColumn("last", F.lit(None).cast("long")) if last is None else joined(first, last, self.keys)
            base = base.withColumn("_base", F.coalesce("last", F.lit(-1)) + 1)
            out = joined(placed, base.drop("last", "_n"), self.keys)
            seq = (F.col("_base") + F.col("ordinal") - F.col("_first")).alias("seq")
            out.select(*events.columns, seq).write.mode("overwrite").parquet(f"{self.store}/log/{batch}")
            base.select(*self.keys, (F.col("_base") + F.col("_n") - 1).alias("last")).write.mode("overwrite").parquet(f"{self.store}/heads/{batch}")
            discard(placed)
            touch(self.spark, f"{self.store}/commits/{batch}")
            return self.spark.read.parquet(f"{self.store}/log/{batch}").count()


def recovery(cases: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unconfirmed submissions that were looked for again: (cases with their new status, events (case_id, step, event_type, payload_json), counts).

    results: case_id, found, result, answer. What was found has been submitted after all; with an answer it goes on until it can be
    graded, else it ends as timed out or failed. What wasn't found stays as it is.
    """
    asked = cases.where("status = 'SUBMISSION_UNCONFIRMED'").select("case_id").join(results, "case_id")
    good = F.coalesce((F.col("result") == "completed") & F.col("answer").isNotNull(), F.lit(False))
    path = lambda *s: F.array(*map(F.lit, ("SUBMISSION_UNCONFIRMED", "SUBMITTED", "RUNNING", *s)))
    states = F.when(good, path("COMPLETED", "COLLECTED", "NORMALIZED", "READY_FOR_GRADING")).when(F.col("result") == "timeout", path("TIMED_OUT")).otherwise(path("COLLECTION_FAILED"))
    outcome = F.when(~F.coalesce("found", F.lit(False)), "not_found").when(good, "recovered").otherwise("failed")
    walked = asked.select("case_id", outcome.alias("outcome"), states.alias("states"))
    there = walked.where("outcome <> 'not_found'")
    steps = there.select("case_id", F.posexplode(F.slice("states", 2, 9)).alias("step", "to"), "states")
    payload = F.to_json(F.struct(F.get("states", F.col("step")).alias("from"), "to", F.lit(True).alias("recovery")))
    events = steps.select("case_id", F.col("step").cast("long").alias("step"), F.lit("TRANSITION").alias("event_type"), payload.alias("payload_json"))
    now = there.select("case_id", F.element_at("states", -1).alias("_to"))
    moved = cases.join(now, "case_id", "left").withColumn("status", F.coalesce("_to", "status")).drop("_to")
    counts = walked.agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("recovered", "not_found", "failed")])
    return moved, events, counts


def citation_refresh(cases: DataFrame, old: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations of gradable cases collected anew: (events (case_id, event_type, payload_json), counts).

    old: case_id, answer. results: case_id, found, result, answer, citations. An answer that has changed, but for white space, is refused with an event; a
    result that isn't complete counts as failed without one.
    """
    asked = cases.where("status = 'READY_FOR_GRADING'").select("case_id").join(old.withColumnRenamed("answer", "_old"), "case_id").join(results, "case_id")
    whole = F.coalesce((F.col("result") == "completed") & F.col("answer").isNotNull(), F.lit(False))
    same = F.coalesce(page_text(js_trim(F.col("_old"))) == page_text(js_trim(F.col("answer"))), F.lit(False))
    n = F.coalesce(F.size("citations"), F.lit(0))
    outcome = F.when(~F.coalesce("found", F.lit(False)), "not_found").when(~whole, "failed").when(~same, "changed").when(n > 0, "refreshed").otherwise("product_absent")
    rows = asked.select("case_id", outcome.alias("outcome"), n.cast("long").alias("citation_count"))
    refused = F.to_json(F.struct(F.concat(F.lit("Answer changed while refreshing citations for "), F.col("case_id").cast("string")).alias("message")))
    events = rows.where("outcome in ('refreshed', 'product_absent', 'changed')").select(
        "case_id", F.when(F.col("outcome") == "changed", "CITATION_REFRESH_FAILED").otherwise("CITATIONS_REFRESHED").alias("event_type"),
        F.when(F.col("outcome") == "changed", refused).otherwise(F.to_json(F.struct("citation_count"))).alias("payload_json"))
    is_ = lambda *x: F.count_if(F.col("outcome").isin(*x))
    return events, rows.agg(is_("refreshed").alias("refreshed"), is_("product_absent").alias("product_absent"), is_("not_found").alias("not_found"), is_("failed", "changed").alias("failed"))
