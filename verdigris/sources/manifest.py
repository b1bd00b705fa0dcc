"""What a run has written: a digest and a size for each file, a locked manifest with its environment, and a reader that verifies both."""

import json
import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sha256_text
from ..storage import exists
from .sinks import write_text


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """(path inside the folder, sha256, size_bytes) of its files at any depth; Spark leaves out empty ones, and those whose names start with _ or a dot. A file is read whole, 2 GB at most."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace(F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/"), F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.lit(whole), "^([a-z0-9]+):/+", "$1:/"), r"([.+()\[\]{}^$|?*\\])", r"\\$1"), F.lit("/")), "")
    return found.select(path.alias("path"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"), F.col("length").alias("size_bytes"))


def seal(spark: SparkSession, folder: str, manifest: str) -> None:
    """Write the manifest of a folder, as JSON lines in a folder of its own. A sealed folder is not sealed again."""
    if exists(spark, manifest):
        raise FileExistsError(f"{manifest} is there already")
    files_of(spark, folder).write.json(manifest)


def verify(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """(path, problem) of the files that are missing, changed, or not in the manifest; empty if the folder is as it was sealed."""
    listed = spark.read.schema("path string, sha256 string, size_bytes long").json(manifest).select("path", F.struct("sha256", "size_bytes").alias("was"))
    there = files_of(spark, folder).select("path", F.struct("sha256", "size_bytes").alias("now"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "not listed").when(F.col("was") != F.col("now"), "changed")
    return listed.join(there, "path", "full").select("path", problem.alias("problem")).where("problem is not null")


def environment(spark: SparkSession) -> dict:
    return {"python": platform.python_version(), "spark": spark.version, "platform": platform.system(), "arch": platform.machine(), "timezone": spark.conf.get("spark.sql.session.timeZone")}


def digest(spark: SparkSession, text: str) -> str:
    return spark.range(1).select(sha256_text(F.lit(text))).first()[0]


def lock(spark: SparkSession, path: str, run_id: str, manifest: dict, task_ids: list[str], **more) -> dict:
    """Write a run's locked manifest with its environment and digest. A lock that is there stays: the same manifest gives it back, another one is refused."""
    body = json.dumps({"run_id": run_id, "manifest": manifest, "selected_task_ids": list(task_ids), **more}, ensure_ascii=False, sort_keys=True)
    if exists(spark, path):
        found = locked(spark, path)
        if found["sha256"] != digest(spark, body):
            raise ValueError(f"{path} locks another manifest")
        return found
    out = {"schema_version": "verdigris.run_manifest_lock.v1", **json.loads(body), "environment": environment(spark), "sha256": digest(spark, body)}
    write_text(spark, path, json.dumps(out, ensure_ascii=False, indent=2) + "\n")
    return out


def locked(spark: SparkSession, path: str) -> dict:
    """A locked manifest, or an error if its content is not what its digest says."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    own = {k: v for k, v in found.items() if k not in ("schema_version", "environment", "sha256")}
    if digest(spark, json.dumps(own, ensure_ascii=False, sort_keys=True)) != found.get("sha256"):
        raise ValueError(f"{path} has been changed since it was locked")
    return found
