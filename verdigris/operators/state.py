"""The case state machine over an append-only event log."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: State -> states that normally follow.
NEXT = {
    "CREATED": ["QUEUED"],
    "QUEUED": ["RESOURCE_LEASED"],
    "RESOURCE_LEASED": ["WORKER_READY"],
    "WORKER_READY": ["SESSION_CREATED"],
    "SESSION_CREATED": ["SUBMITTING"],
    "SUBMITTING": ["SUBMITTED"],
    "SUBMITTED": ["RUNNING", "COMPLETED"],
    "RUNNING": ["COMPLETED"],
    "COMPLETED": ["COLLECTED"],
    "COLLECTED": ["NORMALIZED"],
    "NORMALIZED": ["READY_FOR_GRADING"],
    "READY_FOR_GRADING": ["GRADING"],
    "GRADING": ["SCORED"],
    "SCORED": ["DONE"],
    "DONE": ["GRADING"],
    "NEEDS_LOGIN": ["QUEUED", "CANCELLED"],
    "NEEDS_HUMAN_VERIFICATION": ["QUEUED", "CANCELLED"],
    "CAPABILITY_MISMATCH": [],
    "UI_CHANGED": [],
    "SUBMISSION_UNCONFIRMED": ["SUBMITTED", "NEEDS_HUMAN_VERIFICATION", "CANCELLED"],
    "PROVIDER_ERROR": [],
    "TIMED_OUT": [],
    "COLLECTION_FAILED": ["COLLECTED", "CANCELLED"],
    "NORMALIZATION_FAILED": ["NORMALIZED", "CANCELLED"],
    "GRADING_FAILED": ["GRADING", "CANCELLED"],
    "CANCELLED": [],
}
#: States that any state which is not terminal may fail into.
FAILURES = list(NEXT)[list(NEXT).index("NEEDS_LOGIN") :]
#: What a resumed run does in each state.
SKIPPED = ["DONE", "READY_FOR_GRADING"]
BEFORE_SUBMISSION = ["CREATED", "QUEUED", "RESOURCE_LEASED", "WORKER_READY", "SESSION_CREATED"]
AMBIGUOUS = ["SUBMITTING", "SUBMITTED", "RUNNING", "SUBMISSION_UNCONFIRMED"]
GRADABLE = ["READY_FOR_GRADING", "DONE", "GRADING_FAILED"]


def is_terminal(state: str) -> bool:
    return state == "DONE" or not NEXT[state]


def can_transition(start: str, end: str) -> bool:
    return end in NEXT[start] or (not is_terminal(start) and end in FAILURES)


def legal_edges() -> list[tuple[str, str]]:
    return [(a, b) for a in NEXT for b in NEXT if can_transition(a, b)]


def edge_table(spark: SparkSession) -> DataFrame:
    """All legal transitions: a few hundred rows, whatever the data."""
    return spark.createDataFrame(legal_edges(), "from_state string, to_state string")


def sequence(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """events with seq from 0 in each group; null keys form a group like any other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))


def illegal_transitions(log: DataFrame, keys: list[str], order: list[str], state: str = "state") -> DataFrame:
    """Steps of the log that the state machine doesn't have."""
    w = Window.partitionBy(*keys).orderBy(*order)
    steps = log.withColumn("from_state", F.lag(state).over(w)).where("from_state is not null").withColumn("to_state", F.col(state))
    return steps.join(F.broadcast(edge_table(log.sparkSession)), ["from_state", "to_state"], "left_anti")


def resume_action(state: Column) -> Column:
    return (
        F.when(state.isin(SKIPPED), "skip")
        .when(state.isin(BEFORE_SUBMISSION), "rerun")
        .when(state.isin(AMBIGUOUS), "needs_human")
        .otherwise("skip_other")
    )


def reset_to_queue(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases that may safely start again, as QUEUED, and the event rows that say so."""
    safe = cases.where(F.col("status").isin(BEFORE_SUBMISSION))
    kind = F.when(F.col("status") == "CREATED", "TRANSITION").otherwise("RECOVERY_RESET")
    events = safe.select("case_id", kind.alias("event_type"), F.to_json(F.struct(F.col("status").alias("from"), F.lit("QUEUED").alias("to"))).alias("payload_json"))
    return safe.withColumn("status", F.lit("QUEUED")), events


def failure_state(result: Column, answer: Column) -> Column:
    """The state that a failed execution leads to; null for one that is completed and has an answer. Whatever isn't named is the provider's error."""
    return F.when(
        ~F.coalesce(result == "completed", F.lit(False)) | answer.isNull(),
        F.when(result == "timeout", "TIMED_OUT")
        .when(result == "submission_unconfirmed", "SUBMISSION_UNCONFIRMED")
        .when(result == "collection_failed", "COLLECTION_FAILED")
        .otherwise("PROVIDER_ERROR"),
    )


def stable_polls(polls: DataFrame, keys: list[str], order: list[str], value: str, needed: int) -> DataFrame:
    """polls with stable (equal values in a row so far, from 1) and complete (stable has reached `needed`)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    island = polls.withColumn("_changed", changed).withColumn("_island", F.sum("_changed").over(w))
    run = Window.partitionBy(*keys, "_island").orderBy(*order)
    return island.withColumn("stable", F.row_number().over(run).cast("long")).withColumn("complete", F.col("stable") >= needed).drop("_changed", "_island")


def poll_outcomes(polls: DataFrame, keys: list[str], order: list[str], answer: str, running: str, needed: int) -> DataFrame:
    """(keys, complete, answer, polls): of each group the answer of the first poll at which it was not empty, not running, and the same `needed` times in a row; without such a poll the
    longest answer so far (of equally long ones the first), which is partial, or null if all were empty. An empty or null answer starts the count anew. polls: how many were looked at.
    """
    text = F.coalesce(answer, F.lit(""))
    marked = stable_polls(polls.withColumn("_answer", text), keys, order, "_answer", needed).withColumn("_at", F.struct(*order))
    done = marked.where((F.col("_answer") != "") & ~F.coalesce(F.col(running), F.lit(False)) & F.col("complete")).groupBy(*keys).agg(F.min(F.struct("_at", "_answer")).alias("_done"))
    here = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = marked.alias("a").join(done.alias("b"), here, "left").select(*[F.col(f"a.{k}").alias(k) for k in keys], "a._at", "a._answer", "b._done")
    seen = joined.where(F.col("_done").isNull() | (F.col("_at") <= F.col("_done._at")))
    first = F.min(F.when(F.col("_answer") != "", F.struct((-F.length("_answer")).alias("short"), "_at", "_answer")))
    whole = seen.groupBy(*keys).agg(F.first("_done").alias("_done"), first.alias("_best"), F.count(F.lit(1)).alias("polls"))
    return whole.select(*keys, F.col("_done").isNotNull().alias("complete"), F.coalesce(F.col("_done._answer"), F.col("_best._answer")).alias("answer"), "polls")


def run_status(cases: DataFrame, key: str = "run_id") -> DataFrame:
    ready = F.bool_and(F.col("status") == "READY_FOR_GRADING")
    return cases.groupBy(key).agg(F.when(ready, "READY_FOR_GRADING").otherwise("INCOMPLETE").alias("run_status"))
