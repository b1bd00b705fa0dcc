"""Where the lines of text files stand: line numbers and ordinals over files that are read in splits.

Spark reads a large file in splits, and no split knows how many lines come before it. So lines are counted by split (one small row
each), the counts are added up in the order of the splits, and a line's number is its place in its split and the lines before.
Nothing but the counts is shuffled, and a line never leaves its task for its number. Small splits share a task, one after another, since
each task sends the driver a few KB, however little it reads.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPLIT = ["file", "_start", "_length"]
#: MB of splits that share a task, and how many of them at most: each costs an opened file.
TASK_MB, TASK_SPLITS = 32, 256


def _bytes(size: str) -> int:
    """Bytes of a size as settings have it: 64, 1k, 128MB, 134217728b."""
    number, unit = re.fullmatch(r"(\d+)([bkmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit)


def _few_tasks(lines: DataFrame) -> DataFrame:
    """lines in fewer tasks where the splits are small, each split whole in one of them; no fewer tasks than the cluster runs at once."""
    spark = lines.sparkSession
    splits = lines.rdd.getNumPartitions()
    together = min(TASK_SPLITS, (TASK_MB << 20) // max(1, _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))))
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-splits // max(1, together)))
    return lines.coalesce(tasks) if tasks < splits else lines


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, ordinal, line) of the lines that aren't blank: line_no counts all lines of a file from 1, ordinal these lines over all files, by path, from 0.

    Line ends are LF, CR LF and CR. If the splits of a second reading are not those that were counted (a cluster that grew
    between the two may cut them otherwise), the job fails rather than give wrong numbers.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.col("_metadata.file_block_length").alias("_length")]
    lines = _few_tasks(spark.read.text(path).select(F.col("value").alias("line"), *meta)).withColumn("_at", F.monotonically_increasing_id())
    filled = lines.where(F.trim("line") != "").withColumn("_row", F.monotonically_increasing_id())
    some = filled.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first_row"))
    counts = lines.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("_lines"), F.min("_at").alias("_first_at")).join(some, SPLIT, "left").na.fill(0, ["_rows"])
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = counts.groupBy("file").agg(F.sum("_rows").alias("_n")).select("file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_file_rows"))
    placed = counts.select("*", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_lines_before"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before")).join(files, "file")
    here = filled.join(placed, SPLIT, "left")
    inside = F.col("_at") - F.col("_first_at")
    known = F.coalesce((inside >= 0) & (inside < F.col("_lines")) & F.col("_row").between(F.col("_first_row"), F.col("_first_row") + F.col("_rows") - 1), F.lit(False))
    line_no = F.when(known, F.col("_lines_before") + inside + 1).otherwise(F.raise_error(F.concat(F.lit("splits have changed while they were read: "), "file")).cast("long"))
    return here.select("file", line_no.alias("line_no"), (F.col("_file_rows") + F.col("_rows_before") + F.col("_row") - F.col("_first_row")).alias("ordinal"), "line")


def where(file: str = "file", line_no: str = "line_no"):
    """file:line, for messages."""
    return F.concat(F.col(file), F.lit(":"), F.col(line_no).cast("string"))


def ordered_parity(left: DataFrame, right: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """Places at which two ordered tables (ordinal, key, file, line_no) don't have the same key: (ordinal, left_key, right_key, left_at, right_at, problem).

    A row that only one table has is missing in the other; keys that differ are an order mismatch. Null keys are equal to each other.
    """
    side = lambda t, name: t.select(ordinal, F.struct(F.col(key).alias("key"), where().alias("at")).alias(name))
    both = side(left, "_l").join(side(right, "_r"), ordinal, "full")
    problem = F.when(F.col("_l").isNull(), "missing_left").when(F.col("_r").isNull(), "missing_right").when(~F.col("_l.key").eqNullSafe(F.col("_r.key")), "order_mismatch")
    rows = both.select(ordinal, F.col("_l.key").alias("left_key"), F.col("_r.key").alias("right_key"), F.col("_l.at").alias("left_at"), F.col("_r.at").alias("right_at"), problem.alias("problem"))
    return rows.where("problem is not null")


def zipped(left: DataFrame, right: DataFrame, left_key: str, right_key: str, ordinal: str = "ordinal") -> DataFrame:
    """Rows of two ordered tables side by side, as structs `left` and `right`, by their ordinals.

    The job fails at a row without a counterpart, and at keys that differ: rows that aren't about the same thing are never put together.
    """
    pack = lambda t, name: t.select(ordinal, F.struct(*t.columns).alias(name))
    both = pack(left, "left").join(pack(right, "right"), ordinal, "full")
    same = F.col("left").isNotNull() & F.col("right").isNotNull() & F.col(f"left.{left_key}").eqNullSafe(F.col(f"right.{right_key}"))
    at = lambda name: F.coalesce(F.concat(F.col(f"{name}.file"), F.lit(":"), F.col(f"{name}.line_no").cast("string")), F.lit("nothing"))
    why = F.concat(F.lit("rows don't belong together: "), at("left"), F.lit(" and "), at("right"))
    return both.where(F.when(same, F.lit(True)).otherwise(F.raise_error(why).cast("boolean")))
