"""Written intermediates in the folder that the driver and all executors share."""

import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine without that setting, a folder in /tmp."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/verdigris-shared"


@contextmanager
def setting(spark: SparkSession, **values):
    """Session settings (dots as __) that hold inside the block only."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    It cuts the lineage: a lost executor costs a re-read, not a recomputation, and what
    depends on task identity stays fixed. Shuffle files of the finished write are released.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verdigris-{label}-{uuid.uuid4().hex[:12]}"
    with setting(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._verdigris_path = path
    for written in _scratch:
        written.append(path)
    return out


#: For each open scratch() the paths that materialize() has written inside it.
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Delete what materialize() writes inside the block when it ends, but for the tables that are put into the list it yields."""
    written, kept = [], []
    _scratch.append(written)
    try:
        yield kept
    finally:
        _scratch.pop()
        for path in set(written) - {x._verdigris_path for x in kept}:
            delete(spark, path)


def _found(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, for any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _found(spark, path)
    return files.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder."""
    files, where = _found(spark, path)
    return [x.getPath().getName() for x in files.listStatus(where)]


def touch(spark: SparkSession, path: str) -> None:
    """Create an empty file."""
    files, where = _found(spark, path)
    files.create(where, True).close()


def delete(spark: SparkSession, path: str) -> None:
    files, where = _found(spark, path)
    files.delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_verdigris_path", None)
    if path:
        delete(df.sparkSession, path)


@contextmanager
def exclusive(spark: SparkSession, path: str, patience: float = 600, pause: float = 0.2):
    """Hold a lock file: its creation, which the store makes atomic, succeeds for one driver only. A lock that a lost driver left is for a human to delete."""
    files, where = _found(spark, path)
    until = time.time() + patience
    while True:
        try:
            files.create(where, False).close()
            break
        except Py4JJavaError as error:
            if not files.exists(where) and "AlreadyExists" not in str(error):
                raise
            if time.time() > until:
                raise TimeoutError(f"another run holds {path}") from error
            time.sleep(pause)
    try:
        yield
    finally:
        files.delete(where, False)
