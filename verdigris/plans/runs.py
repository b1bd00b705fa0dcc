"""Queries over event logs: runs, states, ledgers and reports. Each has its DuckDB SQL beside it."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, metrics, selection, state
from ..sources import readers
from ..storage import delete, materialize, setting, shared_dir
from ..tables import table
from . import event_log
from .event_log import EventLog

STATES = list(state.NEXT)
SQL_STATES = "[" + ", ".join(f"'{s}'" for s in STATES) + "]"
#: Events as cases and scores: props holds {"k": n}; n picks the state and the score's status.
SQL_EVENTS = f"""
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  {SQL_STATES}[CAST(json_extract_string(props, '$.k') AS BIGINT) % {len(STATES)} + 1] AS state FROM events)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with k (of props) and the case state it stands for."""
    k = F.get_json_object("props", "$.k").cast("long")
    names = F.array(*[F.lit(s) for s in STATES])
    events = table(spark, sf_dir, "events").withColumn("k", k)
    return events.withColumn("state", F.get(names, F.pmod("k", F.lit(len(STATES))).cast("int")))


def scores(spark, sf_dir) -> DataFrame:
    """Events as an append-only score table with all its re-gradings."""
    status = F.when(F.pmod("k", F.lit(10)) == 0, "failed").when(F.pmod("k", F.lit(10)) == 1, "not_observable").otherwise("scored")
    value = F.when(F.pmod("k", F.lit(7)) == 0, "null").when(F.pmod("k", F.lit(7)) == 1, "true").otherwise(F.col("k").cast("string"))
    return log(spark, sf_dir).select(
        F.col("event_type").alias("metric_id"), F.col("user_id").alias("attempt_id"), "ts", "event_id", status.alias("status"), value.alias("value_json")
    )


def metric_report(spark, sf_dir) -> DataFrame:
    now = ledger.latest(scores(spark, sf_dir), ["metric_id", "attempt_id"], ["ts", "event_id"])
    return metrics.metric_report(now).withColumn("mean", F.round("mean", 6))


def case_counters(spark, sf_dir) -> DataFrame:
    cases = ledger.latest(log(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", F.col("state").alias("status")), ["user_id", "event_type"], ["ts", "event_id"])
    return metrics.case_counters(cases, "event_type")


def event_sequence(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.nullif("event_type", F.lit("click")).alias("event_type"))
    return state.sequence(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "seq")


def event_log_append(spark, sf_dir) -> DataFrame:
    """Events appended in two batches by time, the second one twice, and some of the first once more in a third."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.nullif("event_type", F.lit("click")).alias("event_type"))
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    store = f"{shared_dir(spark)}/verdigris-events-{uuid.uuid4().hex[:12]}"
    kept = EventLog(spark, store, keys=("user_id", "event_type"), order=("ts", "event_id"))
    for batch, some in (("a", rows.where(early)), ("b", rows.where(~early)), ("b", rows.where(~early)), ("c", rows.where(early & (F.pmod("event_id", F.lit(3)) == 0)))):
        kept.append(some, batch)
    out = materialize(kept.read().select("event_id", "user_id", "event_type", "seq"), "events")
    delete(spark, store)
    return out


def recovered_cases(spark, sf_dir) -> DataFrame:
    """Orders as cases: the open ones were unconfirmed; priority and number say what looking for them again has found."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "O", "SUBMISSION_UNCONFIRMED").otherwise("DONE").alias("status"), "o_custkey")
    n = F.pmod("o_custkey", F.lit(5))
    results = orders.select("case_id", (n > 0).alias("found"), F.when(n == 1, "timeout").when(n == 2, "provider_error").otherwise("completed").alias("result"), F.when(n < 4, "answer").alias("answer"))
    cases, events, _ = event_log.recovery(orders.drop("o_custkey"), results)
    said = events.groupBy("case_id").agg(F.count(F.lit(1)).alias("events"), F.max_by("payload_json", "step").alias("last_payload"))
    return cases.join(said, "case_id", "left").select("case_id", "status", F.coalesce("events", F.lit(0)).alias("events"), "last_payload")


def illegal_transitions(spark, sf_dir) -> DataFrame:
    bad = state.illegal_transitions(log(spark, sf_dir).select("user_id", "ts", "event_id", "state"), ["user_id"], ["ts", "event_id"])
    return bad.select("event_id", "user_id", "from_state", "to_state")


def stable_polls(spark, sf_dir) -> DataFrame:
    polls = log(spark, sf_dir).select("user_id", "ts", "event_id", F.pmod("k", F.lit(2)).alias("answer"))
    return state.stable_polls(polls, ["user_id"], ["ts", "event_id"], "answer", 3).select("event_id", "stable", "complete")


def poll_outcomes(spark, sf_dir) -> DataFrame:
    """Events as polls: the answer has 0 to 3 characters, every fifth poll is still running."""
    polls = log(spark, sf_dir).select("user_id", "ts", "event_id", F.substring(F.lit("xyz"), 1, F.pmod("k", F.lit(4)).cast("int")).alias("answer"), (F.pmod("event_id", F.lit(5)) == 0).alias("running"))
    return state.poll_outcomes(polls, ["user_id"], ["ts", "event_id"], "answer", "running", 2)


def latest_verdict(spark, sf_dir) -> DataFrame:
    verdicts = log(spark, sf_dir).select(F.col("k").alias("cache_key"), "ts", "event_id", "value")
    return ledger.latest(verdicts, ["cache_key"], ["ts", "event_id"]).select("cache_key", "event_id", "value")


def _jobs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = log(spark, sf_dir).withColumn("cache_key", F.concat_ws("/", F.col("user_id").cast("string"), F.col("k").cast("string")))
    return rows.where("event_type = 'view'").select("event_id", "cache_key"), rows.where("event_type <> 'view'").select("cache_key", F.col("ts").alias("completed_at"), F.col("event_id").alias("job_id"))


def cache_hit(spark, sf_dir) -> DataFrame:
    jobs, done = _jobs(spark, sf_dir)
    return ledger.cache_split(jobs, done, order=("completed_at", "job_id"))[0].select("event_id", "cache_key", "job_id")


def cache_miss_antijoin(spark, sf_dir) -> DataFrame:
    jobs, done = _jobs(spark, sf_dir)
    return ledger.cache_split(jobs, done)[1].select("event_id", "cache_key")


def coalesce_update(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changed = table(spark, sf_dir, "orders").where("o_totalprice > 150000")
    patch = changed.select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"), F.when(F.col("o_orderstatus") == "O", "urgent").alias("o_orderpriority"))
    return ledger.patched(orders, patch, "o_orderkey", always=["o_orderstatus"])


def resume_triage(spark, sf_dir) -> DataFrame:
    return log(spark, sf_dir).groupBy("event_type", state.resume_action(F.col("state")).alias("action")).agg(F.count(F.lit(1)).alias("cases"))


def safe_reset(spark, sf_dir) -> DataFrame:
    cases = log(spark, sf_dir).select(F.col("event_id").alias("case_id"), F.col("state").alias("status"))
    return state.reset_to_queue(cases)[1]


def run_rollup(spark, sf_dir) -> DataFrame:
    cases = log(spark, sf_dir).select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("run_id"), F.col("state").alias("status"))
    return state.run_status(cases)


def seeded_selection(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return selection.select_seeded(docs, "seed-7", 50, "doc_id")


def broken_references(spark, sf_dir) -> DataFrame:
    from ..operators.leaks import broken_references as broken

    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    return broken(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customers, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


def task_case_attempt(spark, sf_dir) -> DataFrame:
    """Case, attempt and task together: lineitem as attempts, orders as cases, customers as tasks."""
    attempts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    cases = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    tasks = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = cases.join(attempts, cases.o_orderkey == attempts.l_orderkey).join(tasks, cases.o_custkey == tasks.c_custkey)
    return joined.groupBy("c_mktsegment", "o_orderstatus").agg(F.countDistinct("o_orderkey").alias("cases"), F.count(F.lit(1)).alias("attempts"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def file_positions(spark, sf_dir) -> DataFrame:
    """Documents written as JSON lines, a file for each hundred, with blank lines between and broken ones behind some; read back in many small splits."""
    name = F.to_json(F.struct("doc_id", "lang"))
    lines = F.concat(F.when(F.pmod("doc_id", F.lit(7)) == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array().cast("array<string>")), F.array(name),
                     F.when(F.pmod("doc_id", F.lit(11)) == 0, F.array(F.concat(F.lit("broken "), F.col("doc_id").cast("string")))).otherwise(F.array().cast("array<string>")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.format_string("%09d", F.expr("doc_id div 100")).alias("part"), F.posexplode(lines).alias("k", "value"))
    store = f"{shared_dir(spark)}/verdigris-lines-{uuid.uuid4().hex[:12]}"
    docs.repartition("part").sortWithinPartitions("part", "doc_id", "k").select("part", "value").write.partitionBy("part").text(store)
    with setting(spark, spark__sql__files__maxPartitionBytes="1k"):
        good, broken = readers.json_lines(spark, store, "doc_id long, lang string")
        part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part")
        found = good.select("doc_id", part, "line_no", "ordinal").unionByName(broken.select(F.substring("line", 8, 20).cast("long").alias("doc_id"), part, "line_no", F.lit(-1).cast("long").alias("ordinal")))
        out = materialize(found, "positions")
    delete(spark, store)
    return out


def bootstrap_ci(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return metrics.bootstrap_mean(rows, "value", "event_type")


QUERIES = {f.__name__: f for f in (
    metric_report, case_counters, event_sequence, event_log_append, recovered_cases, illegal_transitions, stable_polls, poll_outcomes, latest_verdict, cache_hit, cache_miss_antijoin,
    coalesce_update, resume_triage, safe_reset, run_rollup, seeded_selection, broken_references, task_case_attempt, bootstrap_ci, file_positions,
)}

_in = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
_edges = ", ".join(f"('{a}', '{b}')" for a, b in state.legal_edges())

ORACLES = {
    "file_positions": """
WITH l AS (
  SELECT doc_id, doc_id // 100 AS part, unnest(list_concat(CASE WHEN doc_id % 7 = 0 THEN [-2, -1] ELSE [] END, [0], CASE WHEN doc_id % 11 = 0 THEN [1] ELSE [] END)) AS k FROM documents
), n AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id, k) AS line_no, count(*) FILTER (k >= 0) OVER (ORDER BY part, doc_id, k) - 1 AS ordinal FROM l
)
SELECT doc_id, part, line_no, CASE WHEN k = 0 THEN ordinal ELSE -1 END AS ordinal FROM n WHERE k >= 0""",
    "metric_report": f"""
WITH {SQL_EVENTS}, s AS (SELECT event_type AS metric_id, user_id, ts, event_id,
  CASE WHEN k % 10 = 0 THEN 'failed' WHEN k % 10 = 1 THEN 'not_observable' ELSE 'scored' END AS status,
  CASE WHEN k % 7 = 0 THEN 'null' WHEN k % 7 = 1 THEN 'true' ELSE CAST(k AS VARCHAR) END AS value_json FROM e),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric_id, user_id ORDER BY ts DESC, event_id DESC) AS n FROM s) WHERE n = 1),
v AS (SELECT *, CASE WHEN status = 'scored' THEN try_cast(value_json AS DOUBLE) END AS v FROM (SELECT * REPLACE (CASE WHEN value_json IN ('null', 'true') THEN NULL ELSE value_json END AS value_json) FROM l))
SELECT metric_id, count(*) AS records, count(v) AS scored, round(avg(v), 6) AS mean,
  count(*) FILTER (WHERE status = 'not_observable') AS not_observable, count(*) FILTER (WHERE status = 'not_applicable') AS not_applicable, count(*) FILTER (WHERE status = 'failed') AS failed
FROM v GROUP BY metric_id""",
    "case_counters": f"""
WITH {SQL_EVENTS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM e) WHERE n = 1)
SELECT event_type, count(*) AS total, count(*) FILTER (WHERE state = 'DONE') AS done, count(*) FILTER (WHERE state NOT IN ('DONE', 'READY_FOR_GRADING')) AS system_failures FROM l GROUP BY event_type""",
    "event_log_append": """
SELECT event_id, user_id, nullif(event_type, 'click') AS event_type,
  row_number() OVER (PARTITION BY user_id, nullif(event_type, 'click') ORDER BY ts, event_id) - 1 AS seq FROM events""",
    "recovered_cases": """
WITH c AS (SELECT o_orderkey AS case_id, o_orderstatus = 'O' AS asked, o_custkey % 5 AS n FROM orders)
SELECT case_id, CASE WHEN NOT asked THEN 'DONE' WHEN n = 0 THEN 'SUBMISSION_UNCONFIRMED' WHEN n = 1 THEN 'TIMED_OUT' WHEN n = 3 THEN 'READY_FOR_GRADING' ELSE 'COLLECTION_FAILED' END AS status,
  CASE WHEN NOT asked OR n = 0 THEN 0 WHEN n = 3 THEN 6 ELSE 3 END AS events,
  CASE WHEN NOT asked OR n = 0 THEN NULL WHEN n = 3 THEN '{"from":"NORMALIZED","to":"READY_FOR_GRADING","recovery":true}'
    WHEN n = 1 THEN '{"from":"RUNNING","to":"TIMED_OUT","recovery":true}' ELSE '{"from":"RUNNING","to":"COLLECTION_FAILED","recovery":true}' END AS last_payload FROM c""",
    "event_sequence": """
SELECT event_id, user_id, nullif(event_type, 'click') AS event_type,
  row_number() OVER (PARTITION BY user_id, nullif(event_type, 'click') ORDER BY ts, event_id) - 1 AS seq FROM events""",
    "illegal_transitions": f"""
WITH {SQL_EVENTS}, s AS (SELECT event_id, user_id, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, state AS to_state FROM e)
SELECT * FROM s WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN (VALUES {_edges})""",
    "poll_outcomes": f"""
WITH {SQL_EVENTS}, a AS (SELECT event_id, user_id, ts, substr('xyz', 1, k % 4) AS answer, event_id % 5 = 0 AS running, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e),
b AS (SELECT *, lag(answer) OVER (PARTITION BY user_id ORDER BY n) AS before FROM a),
d AS (SELECT user_id, min(n) AS n FROM b WHERE answer <> '' AND NOT running AND answer = before GROUP BY user_id),
s AS (SELECT b.*, d.n AS done FROM b LEFT JOIN d ON b.user_id = d.user_id WHERE d.n IS NULL OR b.n <= d.n)
SELECT user_id, bool_or(done IS NOT NULL) AS complete, coalesce(max(CASE WHEN n = done THEN answer END), arg_min(answer, struct_pack(x := -length(answer), y := n)) FILTER (answer <> '')) AS answer, count(*) AS polls FROM s GROUP BY user_id""",
    "stable_polls": f"""
WITH {SQL_EVENTS}, a AS (SELECT event_id, user_id, ts, k % 2 AS answer FROM e),
b AS (SELECT *, CASE WHEN answer = lag(answer) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM a),
d AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b),
f AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS stable FROM d)
SELECT event_id, stable, stable >= 3 AS complete FROM f""",
    "latest_verdict": f"""
WITH {SQL_EVENTS} SELECT k AS cache_key, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS n FROM e) WHERE n = 1""",
    "cache_hit": f"""
WITH {SQL_EVENTS}, j AS (SELECT *, user_id || '/' || k AS cache_key FROM e),
d AS (SELECT * FROM (SELECT cache_key, event_id AS job_id, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, event_id DESC) AS n FROM j WHERE event_type <> 'view') WHERE n = 1)
SELECT j.event_id, j.cache_key, d.job_id FROM j JOIN d USING (cache_key) WHERE event_type = 'view'""",
    "cache_miss_antijoin": f"""
WITH {SQL_EVENTS}, j AS (SELECT *, user_id || '/' || k AS cache_key FROM e)
SELECT event_id, cache_key FROM j WHERE event_type = 'view' AND cache_key NOT IN (SELECT cache_key FROM j WHERE event_type <> 'view')""",
    "coalesce_update": """
SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN nullif(o_orderstatus, 'F') ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_totalprice > 150000 AND o_orderstatus = 'O' THEN 'urgent' ELSE o_orderpriority END AS o_orderpriority FROM orders""",
    "resume_triage": f"""
WITH {SQL_EVENTS} SELECT event_type, CASE WHEN state IN {_in(state.SKIPPED)} THEN 'skip' WHEN state IN {_in(state.BEFORE_SUBMISSION)} THEN 'rerun'
  WHEN state IN {_in(state.AMBIGUOUS)} THEN 'needs_human' ELSE 'skip_other' END AS action, count(*) AS cases FROM e GROUP BY 1, 2""",
    "safe_reset": f"""
WITH {SQL_EVENTS} SELECT event_id AS case_id, CASE WHEN state = 'CREATED' THEN 'TRANSITION' ELSE 'RECOVERY_RESET' END AS event_type,
  '{{"from":"' || state || '","to":"QUEUED"}}' AS payload_json FROM e WHERE state IN {_in(state.BEFORE_SUBMISSION)}""",
    "run_rollup": f"""
WITH {SQL_EVENTS} SELECT user_id || '/' || event_type AS run_id, CASE WHEN bool_and(state = 'READY_FOR_GRADING') THEN 'READY_FOR_GRADING' ELSE 'INCOMPLETE' END AS run_status FROM e GROUP BY 1""",
    "seeded_selection": """
WITH s AS (SELECT doc_id, lang, row_number() OVER (ORDER BY sha256('seed-7:' || doc_id), doc_id) - 1 AS ordinal FROM documents)
SELECT doc_id, lang, ordinal FROM s WHERE ordinal < 50""",
    "broken_references": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "task_case_attempt": """
SELECT c_mktsegment, o_orderstatus, count(DISTINCT o_orderkey) AS cases, count(*) AS attempts, round(sum(l_quantity), 2) AS quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
}
