"""The input tables: one Parquet file or folder each, read by Spark so that any store works."""

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder, lazily: column pruning and pushed filters reach the Parquet scan."""
    if name not in NAMES:
        raise ValueError(f"no such table: {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
