"""Hard negatives by a vector-approximation file.

A vector is a row of whole numbers (floor(scale * x)); the score of two rows is their inner product. For each anchor the
rows of its own label with the highest scores are its positives; for each positive the rows of other labels whose score lies in
a window below the positive's are its hard negatives, highest scores first.

1. Each dimension is cut into cells at quantiles of a bounded sample, the outer cells reaching to the smallest and largest
   value of all rows. The approximation of a row is its cell in each dimension, a byte each; it is written
   beside the row for every row.
2. Rows are dealt into shards and anchors into chunks, both by row number, so sizes don't depend on labels or ids. A
   tile is one shard with one chunk: the stated set of anchors against all rows, in blocks.
3. In a tile, for each anchor a table gives the least and the greatest part that a cell can add to the score; sums looked up for
   all rows bound their scores from below and above. Only rows that the bounds can't rule out are scored
   exactly: for positives, those whose upper bound reaches the k-th lower bound; for negatives, those that may lie in the window
   and whose upper bound reaches the k-th lower bound of those that surely do.
4. Each tile sends its first few rows for each anchor, and these are merged. First positives, then, with their
   scores as windows, negatives. Results are exact: bounds are whole numbers, and only decide what is not scored.

A row with a null id, label or vector, or with a null or non-finite component, takes no part. Shorter vectors count as filled up
with zeros; components beyond +-2^28 count as that. Ties go to the smaller id. An anchor is not its own positive, and
neither is any row that shares its id; an anchor that occurs twice gives its results twice. Extra columns are ignored. An empty
table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize
from .common import bounded_batches

SCALE, ANCHOR_EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: A negative's score in percent of the positive's.
LEAST_PERCENT, MOST_PERCENT = 50, 95
#: Cells of a dimension, and rows of the sample that places them.
CELLS, SAMPLE_ROWS = 64, 4096
#: Anchors of a chunk and rows of a shard at most; a small table has SHARDS shards, of LEAST_ROWS rows about at least.
CHUNK_ANCHORS, SHARD_ROWS, LEAST_ROWS, SHARDS = 4096, 32768, 1024, 24
#: Rows and anchors whose bounds are summed up at once, so that they stay in a core's cache.
AT_ONCE_ROWS, AT_ONCE_ANCHORS = 2048, 16
LARGEST = 1 << 28
LOWEST = np.iinfo(np.int64).min


def whole_numbers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part: vector is little-endian 32-bit whole numbers, `dims` of them."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            good = np.ones(len(flat), bool) if not flat.null_count else flat.is_valid().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            good &= np.isfinite(values)
            row, inside = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out = np.zeros((len(sizes), dims), "<i4")
            out[row[good], inside[good]] = np.clip(np.floor(scale * values[good]), -LARGEST, LARGEST)
            taken = np.ones(len(sizes), bool)
            taken[row[~good]] = False
            at = pa.array(np.flatnonzero(taken))
            packed = pa.array([out[i].tobytes() for i in np.flatnonzero(taken)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), packed], names=["vec_id", "label", "vector"])

    return vectors.mapInArrow(run, "vec_id long, label long, vector binary")


def matrix(column: pa.Array, dims: int, dtype: str = "<i4") -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype).reshape(len(column), dims)


def cell_edges(rows: DataFrame, dims: int, cells: int) -> np.ndarray:
    """For each dimension the first value of each cell, and after them one above the largest: (dims, cells + 1). Cells that no value can be in are empty."""

    def extremes(batches):
        least, most = np.full(dims, LARGEST + 1), np.full(dims, -LARGEST - 1)
        for batch in batches:
            if batch.num_rows and dims:
                x = matrix(batch.column(0), dims)
                least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(least), pa.array(most)], names=["d", "lo", "hi"])

    found = rows.select("vector").mapInArrow(extremes, "d long, lo long, hi long").groupBy("d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow().sort_by("d")
    sample = rows.select("vector", "at").orderBy(F.xxhash64("at")).limit(SAMPLE_ROWS).toArrow()
    if not dims or not sample.num_rows:
        return np.zeros((dims, cells + 1), np.int64)
    inner = np.sort(matrix(sample.column("vector").combine_chunks(), dims), axis=0)[(np.arange(1, cells) * sample.num_rows) // cells]
    lo, hi = (found.column(c).to_numpy() for c in ("lo", "hi"))
    return np.concatenate([lo[None], np.clip(inner, lo, hi), hi[None] + 1]).T.astype(np.int64)


def approximated(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """rows with cells: the byte of each dimension."""
    dims, schema = len(edges), f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, cells binary"
    at = rows.columns.index("vector")

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(at), dims)
            codes = np.empty(x.shape, np.uint8)
            for d in range(dims):
                codes[:, d] = np.searchsorted(edges[d, 1:-1], x[:, d], side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(run, schema)


def bounds(codes: np.ndarray, anchors: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score that a row in these cells can have with each anchor, as (rows, anchors): sums of table look-ups."""
    first, last = edges[:, :-1], np.maximum(edges[:, 1:] - 1, edges[:, :-1])
    a, b = first[:, :, None] * anchors.T[:, None, :], last[:, :, None] * anchors.T[:, None, :]
    least, most = np.minimum(a, b), np.maximum(a, b)  # (dims, cells, anchors)
    low, high = (np.zeros((len(codes), len(anchors)), np.int64) for _ in range(2))
    for i in range(0, len(codes), AT_ONCE_ROWS):
        part = slice(i, i + AT_ONCE_ROWS)
        for d in range(codes.shape[1]):
            cell = codes[part, d]
            low[part] += least[d].take(cell, axis=0)
            high[part] += most[d].take(cell, axis=0)
    return low, high


def kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """Of each column; the lowest number where there are fewer."""
    return np.partition(x, len(x) - k, axis=0)[len(x) - k] if len(x) >= k else np.full(x.shape[1], LOWEST)


def first_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def top_positives(ids, codes, vectors, anchor_ids, anchors, edges, k):
    """Yield (anchor position, ids, scores) of the k best rows of each anchor among these, which have its label."""
    low, high = bounds(codes, anchors, edges)
    own = ids[:, None] == anchor_ids[None, :]
    low[own] = high[own] = LOWEST
    reach = np.maximum(kth_largest(low, k), LOWEST + 1)
    for j in range(len(anchors)):
        some = np.flatnonzero(high[:, j] >= reach[j])
        scores = vectors[some] @ anchors[j]
        best = first_rows(scores, ids[some], k)
        yield j, ids[some][best], scores[best]


def top_negatives(ids, codes, vectors, anchors, windows, edges, k):
    """Yield (anchor position, window position, ids, scores) of the k best rows in each window (least, most) of each anchor."""
    low, high = bounds(codes, anchors, edges)
    for j in range(len(anchors)):
        lo_j, hi_j = low[:, j], high[:, j]
        near = np.flatnonzero((hi_j >= min(w[0] for w in windows[j])) & (lo_j <= max(w[1] for w in windows[j])))
        lo_j, hi_j = lo_j[near], hi_j[near]
        exact = np.full(len(near), LOWEST)
        for at, (least, most) in enumerate(windows[j]):
            sure = lo_j[(lo_j >= least) & (hi_j <= most)]
            reach = max(least, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else least
            some = np.flatnonzero((hi_j >= reach) & (lo_j <= most))
            new = some[exact[some] == LOWEST]
            exact[new] = vectors[near[new]] @ anchors[j]
            scores = exact[some]
            some = some[(scores >= least) & (scores <= most)]
            best = some[first_rows(exact[some], ids[near[some]], k)]
            if len(best):
                yield j, at, ids[near[best]], exact[best]


class Tile:
    """A shard's rows and a chunk's anchors, from the rows of one group."""

    def __init__(self, table: pa.Table, dims: int):
        anchor = table.column("is_anchor").to_numpy()
        rows, self.anchors = table.filter(pa.array(~anchor)), table.filter(pa.array(anchor))
        column = lambda t, c: t.column(c).combine_chunks()
        self.ids, self.labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
        self.codes = matrix(column(rows, "cells"), dims, "u1")
        self.vectors = matrix(column(rows, "vector"), dims).astype(np.int64)
        self.anchor_at, self.anchor_ids, self.anchor_labels = (self.anchors.column(c).to_numpy() for c in ("at", "vec_id", "label"))
        self.anchor_vectors = matrix(column(self.anchors, "vector"), dims).astype(np.int64)

    def by_label(self, same: bool):
        """Yield, for anchors of one label, some at once: their positions, and the positions of the rows of that label, or of the others."""
        for label in np.unique(self.anchor_labels).tolist():
            mine = np.flatnonzero(self.anchor_labels == label)
            rows = np.flatnonzero((self.labels == label) == same)
            for i in range(0, len(mine), AT_ONCE_ANCHORS):
                yield mine[i : i + AT_ONCE_ANCHORS], rows


def tiles(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, extra: str | None = None) -> DataFrame:
    """rows in every chunk and anchors in every shard: one row for each tile that it belongs to."""
    shards = max(1, -(-n_rows // min(SHARD_ROWS, max(LEAST_ROWS, n_rows // SHARDS))))
    chunks = max(1, -(-n_anchors // CHUNK_ANCHORS))
    place = lambda n: F.pmod(F.xxhash64("at"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["at", "vec_id", "label", "vector"]
    more = [F.col(extra)] if extra else []
    none = [F.lit(None).cast(anchors.schema[extra].dataType).alias(extra)] if extra else []
    a = rows.select(place(shards).alias("shard"), every(chunks).alias("chunk"), F.lit(False).alias("is_anchor"), *columns, "cells", *none)
    b = anchors.select(every(shards).alias("shard"), place(chunks).alias("chunk"), F.lit(True).alias("is_anchor"), *columns, F.lit(None).cast("binary").alias("cells"), *more)
    return a.unionByName(b)


def hard_negatives(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT, cells: int = CELLS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); is_anchor is a condition on the column vec_id."""
    bounded_batches(vectors.sparkSession)
    if not 2 <= cells <= 256:
        raise ValueError("cells of a dimension are numbered by a byte")
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")).dropna()
    dims = named.agg(F.max(F.size("vector"))).first()[0] or 0
    rows = materialize(whole_numbers(named, dims, scale).withColumn("at", F.monotonically_increasing_id()), "vectors")
    edges = cell_edges(rows, dims, cells)
    file = materialize(approximated(rows, edges), "approximations")
    chosen = file.where(is_anchor).drop("cells")
    n_rows, n_anchors = file.count(), chosen.count()

    def find_positives(table: pa.Table) -> pa.Table:
        t, out = Tile(table, dims), []
        for mine, among in t.by_label(same=True):
            for j, ids, scores in top_positives(t.ids[among], t.codes[among], t.vectors[among], t.anchor_ids[mine], t.anchor_vectors[mine], edges, positives):
                out += [(int(t.anchor_at[mine[j]]), int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
        return arrow(out, ["at", "id", "score"])

    def find_negatives(table: pa.Table) -> pa.Table:
        t, out = Tile(table, dims), []
        found = t.anchors.column("positives").to_pylist()
        windows = [[(-(-least_percent * p["score"] // 100), most_percent * p["score"] // 100) for p in x] for x in found]
        for mine, among in t.by_label(same=False):
            for j, at, ids, scores in top_negatives(t.ids[among], t.codes[among], t.vectors[among], t.anchor_vectors[mine], [windows[i] for i in mine], edges, negatives):
                out += [(int(t.anchor_at[mine[j]]), at, int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
        return arrow(out, ["at", "positive", "id", "score"])

    def arrow(out: list[tuple], names: list[str]) -> pa.Table:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    def best(found: DataFrame, k: int, *keys: str) -> DataFrame:
        """The k first of each key, in order, as an array of (order, id, score): a key has k from each shard at most."""
        ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "id", "score")))
        return found.groupBy(*keys).agg(F.slice(ordered, 1, k).alias("best"))

    dealt = tiles(file, chosen, n_rows, n_anchors)
    tops = dealt.groupBy("shard", "chunk").applyInArrow(find_positives, "at long, id long, score long")
    asked = materialize(chosen.join(best(tops, positives, "at").withColumnRenamed("best", "positives"), "at"), "positives")
    dealt = tiles(file, asked, n_rows, n_anchors, "positives")
    tops = dealt.groupBy("shard", "chunk").applyInArrow(find_negatives, "at long, positive long, id long, score long")
    ranked = best(tops, negatives, "at", "positive").select("at", "positive", F.posexplode("best").alias("rank", "negative"))
    wins = asked.select("at", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("positive", "of"))
    out = wins.join(ranked, ["at", "positive"]).select(
        "anchor_id", F.col("of.id").alias("positive_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("negative.id").alias("negative_id"),
        F.col("of.score").alias("positive_score"), F.col("negative.score").alias("negative_score"),
    )
    out = materialize(out, "negatives")
    for used in (rows, file, asked):
        discard(used)
    return out


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table.withColumn("label", moved), F.col("vec_id") % ANCHOR_EVERY == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank,
    id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
