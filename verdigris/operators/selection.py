"""Task projection, selection and numbering."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize


def track_for(family: Column) -> Column:
    return F.when(family == "report_research", "long_form").otherwise("short_fact")


def seeded_order(seed: str, task_id: Column) -> Column:
    """The reproducible shuffle key of a task."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), task_id.cast("string")), 256)


def numbered(tasks: DataFrame, by: list[str]) -> DataFrame:
    """All tasks with their ordinal in the order of `by`, from 0: ranges of the order are numbered apart and moved by the rows before them.

    The ranges are written, since counts and rows must come from the same ranges.
    """
    dealt = tasks.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = materialize(dealt.select("*", F.monotonically_increasing_id().alias("_at")).withColumn("_range", F.shiftrightunsigned("_at", 33)), "ranges")
    counts = sorted(ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each range
    before, total = [], 0
    for r in counts:
        before.append((r["_range"], total))
        total += r.n
    offsets = tasks.sparkSession.createDataFrame(before, "_range long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = ranged.join(F.broadcast(offsets), "_range").withColumn("ordinal", place).drop("_at", "_range", "_before")
    out._verdigris_path = ranged._verdigris_path  # so that discard() takes the ranges away
    return out


def select_seeded(tasks: DataFrame, seed: str, limit: int | None, key: str = "task_id") -> DataFrame:
    """The first `limit` tasks in seeded order, numbered from 0. A top-k: each task keeps its own k, then k rows meet. None: all, in ranges."""
    if limit is None:
        return numbered(tasks.withColumn("_order", seeded_order(seed, F.col(key))), ["_order", key]).drop("_order")
    chosen = tasks.withColumn("_order", seeded_order(seed, F.col(key))).orderBy("_order", key).limit(limit)
    ordinal = F.row_number().over(Window.orderBy("_order", key)) - 1  # over the chosen rows only
    return chosen.withColumn("ordinal", ordinal.cast("long")).drop("_order")


def select_ids(tasks: DataFrame, ids: list[str], key: str = "task_id", strict: bool = True) -> DataFrame:
    """The listed tasks in the list's order. strict: an id that no task has is an error."""
    spark = tasks.sparkSession
    wanted = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"ordinal long, {key} string")
    joined = wanted.join(tasks.withColumn(key, F.col(key).cast("string")).withColumn("_there", F.lit(True)), key, "left")
    if strict:
        there = F.when(F.col("_there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown task: "), F.col(key))).cast("boolean"))
        return joined.where(there).drop("_there")
    return joined.where("_there").drop("_there")


def canonical_tasks(source: DataFrame) -> DataFrame:
    """Source tasks as canonical ones: track, grader name, merged provenance; `rejected` tells why a row is not accepted."""
    attachments = F.coalesce(F.size("input.attachments"), F.lit(0)) > 0
    return source.select(
        "task_id",
        "benchmark_id",
        "split",
        track_for(F.col("task_family")).alias("track"),
        "input",
        "expected_output",
        "constraints",
        F.concat("benchmark_id", F.lit(".official")).alias("official_grader"),
        F.array().cast("array<string>").alias("overlay_graders"),
        F.struct("provenance.*", F.col("upstream_task_id")).alias("provenance"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.when(attachments, "attachments are not supported").alias("rejected"),
    )


def public_request(tasks: DataFrame, run_timeout: int) -> DataFrame:
    """What a system under test may see of a task: no gold, no grader; the shorter of both time limits."""
    return tasks.select(
        "task_id",
        F.col("input.prompt").alias("prompt"),
        F.col("input.language").alias("language"),
        F.col("input.as_of").alias("as_of"),
        F.least(F.col("constraints.timeout_seconds"), F.lit(run_timeout)).alias("timeout_seconds"),
    )


def normalize_results(raw: DataFrame) -> DataFrame:
    """Raw results as submissions: one section with the answer, citations renamed by position and by whether they have a URL."""
    rename = lambda c, i: F.struct(
        F.concat(F.lit("citation-"), F.lpad((i + 1).cast("string"), 4, "0")).alias("citation_id"),
        c["text"].alias("display_text"),
        c["url"].alias("visible_url"),
        F.when(F.coalesce(c["url"], F.lit("")) != "", "visible_only").otherwise("unresolvable").alias("collection_status"),
    )
    section = F.struct(F.lit("answer").alias("section_id"), F.lit("").alias("heading"), F.coalesce("answer", F.lit("")).alias("text"))
    return raw.select(
        "run_id", "case_id", "attempt_id", "task_id",
        F.coalesce("answer", F.lit("")).alias("final_answer"),
        F.array(section).alias("sections"),
        F.transform(F.coalesce("citations", F.array().cast("array<struct<text:string,url:string>>")), rename).alias("citations"),
    )


def fixture_answer(task_id: Column, prompt: Column) -> Column:
    """The answer of the deterministic stand-in for a system under test."""
    return F.concat(F.lit("Fixture answer for "), task_id, F.lit(": "), prompt)
