"""Upserts, partial updates and caches over append-only tables: the latest row wins when it is read."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_object


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. An aggregate, not a window: map-side maxima leave a row for each key and task to shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def patched(current: DataFrame, patch: DataFrame, key: str, always: list[str]) -> DataFrame:
    """current with the values of patch that aren't null; the columns in `always` are taken even so."""
    new = patch.select(F.col(key), F.lit(True).alias("_there"), *[F.col(c).alias(f"_new_{c}") for c in patch.columns if c != key])
    joined = current.join(new, key, "left")

    def merged(c: str) -> Column:
        if c not in patch.columns or c == key:
            return F.col(c)
        if c in always:
            return F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        return F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c)

    return joined.select(*[merged(c) for c in current.columns])


def cache_split(jobs: DataFrame, done: DataFrame, key: str = "cache_key", order: tuple[str, ...] = ("completed_at",)) -> tuple[DataFrame, DataFrame]:
    """(hits with the latest earlier verdict, misses): only the misses have to be judged."""
    prior = latest(done, [key], list(order))
    return jobs.join(prior, key), jobs.join(prior.select(key), key, "left_anti")


def cache_key(*parts: Column) -> Column:
    """The digest of its parts as canonical JSON: nested values in whatever key order give one key. Null parts count as left out."""
    return hash_object(F.to_json(F.struct(*parts)))
