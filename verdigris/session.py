"""A local session for tests, the bench and interactive use; a cluster brings its own."""

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows reach Python in Arrow batches of about this size, however long the texts are.
ARROW_BYTES = 4 << 20


def local_session(cpus: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session on this machine in UTC. On a cluster use spark-submit's own settings instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("verdigris")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable_by_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package, whatever folder the driver started in.

    On a cluster the package is installed or comes by --py-files; the extra entry does no harm there.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes for the session: a batch of long texts must not grow with their length."""
    importable_by_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
