"""Readers of task, gold, result and report files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .positions import numbered_lines


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records with file, line_no and ordinal; broken lines: file, line_no, line). Blank lines are skipped, but counted."""
    full = f"{schema.strip()}, _corrupt string"
    parsed = numbered_lines(spark, path).withColumn("r", F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = parsed.where("r._corrupt is null").select("r.*", "file", "line_no", "ordinal").drop("_corrupt")
    return good, parsed.where("r._corrupt is not null").select("file", "line_no", "line")


def tasks(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Source tasks of one split; a broken or invalid line fails the job, and the first one is named by file and line."""
    good, broken = json_lines(spark, path, schemas.TASK)
    valid, invalid = schemas.validate(good, schemas.task_checks())
    wrong = broken.select("file", "line_no", F.concat(F.lit("not a task: "), F.substring("line", 1, 200)).alias("why"))
    wrong = wrong.unionByName(invalid.select("file", "line_no", F.concat(F.lit("task "), F.coalesce("task_id", F.lit("?")), F.lit(": "), F.array_join("invalid_reason", ", ")).alias("why")))
    first = wrong.orderBy("file", "line_no").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].file}:{first[0].line_no}: {first[0].why}")
    return valid.where(F.col("split") == split).drop("file", "line_no", "ordinal")


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold records, the last of each task in the file's order."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", schemas.GOLD).alias("r"), "_file", "_at").select("r.*", "_file", "_at")
    last = parsed.groupBy("task_id").agg(F.max_by(F.struct(*[c for c in parsed.columns if c not in ("task_id", "_file", "_at")]), F.struct("_file", "_at")).alias("g"))
    return last.select("task_id", "g.*")


def csv_with_mark(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV file with a header, of which a byte order mark is taken off."""
    rows = spark.read.options(header=True, multiLine=True, escape='"', **options).csv(path)
    return rows.toDF(*[c.removeprefix("﻿") for c in rows.columns])


def inference_runs(spark: SparkSession, folder: str) -> DataFrame:
    """<folder>/<model>/infer.jsonl of all models, with the model's name and its first evaluation."""
    rows = spark.read.schema(schemas.INFERENCE).json(f"{folder}/*/infer.jsonl")
    model = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    first = F.get("eval_result", F.lit(0))
    return rows.select(model.alias("model"), "Question", "Answer", first["is_correct"].alias("is_correct"), first["model_extracted_confidence"].alias("confidence"))


def calibration_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CALIBRATION).json(path).select("expected", F.col("verdict.verdict").alias("found"))


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that is one JSON array."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """(report, markdown) of whole Markdown files."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("report"), F.col("value").alias("markdown"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))
