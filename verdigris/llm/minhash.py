"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct three-word shingles (A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`; fewer words make one
shingle). Documents are linked if the Jaccard similarity of their full sets is 0.85 or more.

1. Equal sets are one point. A point has MINIMA min-hashes, and a sketch of two bits of each.
2. A tree's root holds all points. A node chooses coordinates by a hash of its path, one, and as often a second
   that the mean is 1 / 0.85; a point goes on to a child by each chosen coordinate's min-hash. So a pair at the threshold
   keeps one common node on average on every level, and a pair that is less alike dies out. TREES independent trees
   repeat this: a pair at 0.85 shares a node on the first level of one tree with 0.87, and on each of the next with 0.78, 0.70,
   0.64: of the twelve trees all miss with less than one in a hundred thousand on the fourth.
3. On the first level each point is compared with the first point of its nodes: this makes one component of most groups of copies at
   a cost of about their size. From then on only nodes with points of several components are of interest.
4. Such nodes of at most SMALL points are compared exhaustively by size and sketch, in arrays. Larger ones branch, level by level.
   What is still large on the last level shares nearly everything (copies of a template, say), and is compared by the
   exact prefix join of simhash.prefix_pairs.
5. Every pair that this brings up is verified on the full sets before it links, and components.py joins the links.

Nodes are rows of a table, one for each point in them, and a level is an aggregate and a join by node: no task holds a
large node, and nothing that grows with the input reaches the driver.

The sketches rule a pair out from OUT differing coordinates on: at 0.85 14.4 of 128 differ with a standard deviation of 3.6.

Null, empty and blank texts have no set, are linked with nothing and are kept. Repeated rows have equal results. Rows with a null id
get their component's smallest id and never name one; a component of null ids alone has a null id and keeps its rows. Extra
columns are ignored. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, materialize
from .common import ROLL, WordHashes, bounded_batches, mix, rolling
from .components import components
from .simhash import MOST_POINTS, SET_COLUMNS, STEP, packed, prefix_pairs, set_name, unpacked, verified, whole_keys

#: The similarity of linked documents, as a fraction, and the words of a shingle.
LEAST, SHINGLE = (17, 20), 3
MINIMA, TREES, LEVELS, SMALL = 128, 12, 4, 48
#: Of MINIMA coordinates, how many may differ in their two bits: six standard deviations over the mean at 0.85.
OUT = 36
#: Points with their nodes that are broadcast at most (about 200 bytes each); more are joined by a shuffle.
MOST_WALKERS = 1 << 17
SKETCH_COLUMNS = [f"b{i}" for i in range(MINIMA // 32)]
EVEN = 0x5555555555555555
ROOTS = mix(np.arange(1, TREES + 1, dtype=np.uint64) * STEP)


def shingles(data: bytes | None, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """The distinct n-word shingles as sorted hashes; fewer words make one shingle, none make none."""
    h = hashes.of((data or b"").lower().split())  # bytes: A-Z only, and ASCII white space
    return np.unique(rolling(h, min(n, len(h))) if len(h) else h)


def minima(x: np.ndarray) -> np.ndarray:
    """MINIMA min-hashes, of 32 bits each, of a set as it is written (unpacked())."""
    ways, x = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * ROLL)[:, None], mix(x)
    parts = [((x[i : i + 2048] ^ ways) * (ways | np.uint64(1))).min(1) for i in range(0, len(x), 2048)]
    return (mix(np.min(parts, axis=0)) >> np.uint64(32)).astype(np.uint32)


def sketched(least: np.ndarray) -> list[int]:
    """Two bits of each min-hash, 32 of them to a (signed) number."""
    bits = (least.astype(np.uint64) & np.uint64(3)).reshape(-1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(bits, axis=1).view(np.int64).tolist()


def differing(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """In how many coordinates sketches differ."""
    out = 0
    for x, y in zip(a, b, strict=True):
        z = x ^ y
        out = out + np.bitwise_count((z | z >> np.uint64(1)) & np.uint64(EVEN)).astype(np.int64)
    return out


def near_sketches(u, v) -> Column:
    """The same for columns: whether OUT coordinates differ or fewer."""
    z = [u(c).bitwiseXOR(v(c)) for c in SKETCH_COLUMNS]
    return sum((F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(EVEN))) for x in z), F.lit(0)) <= OUT


def branches(nodes: np.ndarray, least: np.ndarray, similarity: tuple[int, int] = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(position, child): the children of nodes for points with these min-hashes (a row for each node), by coordinates that the node's hash chooses."""
    h = mix(nodes ^ STEP)
    p, q = similarity
    again = (h >> np.uint64(48)).astype(np.int64) * p < (q - p) << 16  # a second coordinate with q / p - 1
    first = (h % np.uint64(MINIMA)).astype(np.int64)
    second = (first + 1 + (h >> np.uint64(20)).astype(np.int64) % (MINIMA - 1)) % MINIMA
    at, coordinate = np.concatenate([np.arange(len(nodes)), np.flatnonzero(again)]), np.concatenate([first, second[again]])
    return at, mix(mix(nodes[at] * ROLL + coordinate.astype(np.uint64)) ^ least[at, coordinate])


def set_points(docs: DataFrame, doc_id: str, text: str, n: int = SHINGLE) -> DataFrame:
    """(row, doc_id, n_shingles, id0, id1, sketch, keys: the nodes of the first level, shingles) of each row of docs."""
    longs = ["row", "doc_id", "n_shingles", *SET_COLUMNS, *SKETCH_COLUMNS]
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in longs], T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("shingles", T.BinaryType())])

    def run(batches):
        hashes = WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                rows, keys, sets = [], [], []
                for x in batch.column(2):
                    s = shingles(x.as_py(), hashes, n)
                    sets.append(packed(s))
                    m = minima(unpacked(sets[-1])) if len(s) else np.zeros(MINIMA, np.uint32)
                    rows.append((len(s), *set_name(s), *sketched(m)))
                    keys.append(branches(ROOTS, np.broadcast_to(m, (TREES, MINIMA)))[1].view(np.int64) if len(s) else [])
                columns = list(zip(*rows, strict=True)) or [()] * (len(longs) - 2)
                arrays = [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns], pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary")).mapInArrow(run, schema)


def children(large: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(key, node, component) one level below, from rows (key, node, component) and the sets (node, shingles), whose min-hashes are taken anew."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                found = []
                for node, component, keys, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    below = branches(np.array(keys, np.int64).view(np.uint64), np.broadcast_to(minima(unpacked(data)), (len(keys), MINIMA)), similarity)[1].view(np.int64)
                    found.append(np.stack([below, np.full(len(below), node), np.full(len(below), component)]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(found, axis=1)], names=["key", "node", "component"])

    one = large.groupBy("node", "component").agg(F.collect_list("key").alias("keys"))  # a few keys for each tree
    joined = sets.join(F.broadcast(one) if one.count() <= MOST_WALKERS else one, "node").select("node", "component", "keys", "shingles")
    return joined.mapInArrow(run, "key long, node long, component long")


def compared(small: DataFrame, points: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(u, v), u > v: pairs of points of two components in nodes of SMALL points at most (key, node, component) that size and sketch don't rule out."""
    p, q = similarity
    parts, rows_at_once = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_POINTS
    full = small.select("key", "node", "component").join(points.select("node", "n_shingles", *SKETCH_COLUMNS), "node")

    def run(batches):
        for table in whole_keys(batches, rows_at_once):
            key, node, component, n = (table.column(c).to_numpy() for c in ("key", "node", "component", "n_shingles"))
            sketch, found = [table.column(c).to_numpy().view(np.uint64) for c in SKETCH_COLUMNS], []
            a, step = np.arange(len(key)), 0
            while len(a):
                step += 1
                a = a[a + step < len(key)]
                a = a[key[a] == key[a + step]]
                b = a + step
                good = (component[a] != component[b]) & (q * np.minimum(n[a], n[b]) >= p * np.maximum(n[a], n[b]))
                x, y = a[good], b[good]
                near = differing([s[x] for s in sketch], [s[y] for s in sketch]) <= OUT if len(x) else np.zeros(0, bool)
                x, y = node[x[near]], node[y[near]]
                found.append(np.stack([np.maximum(x, y), np.minimum(x, y)]))
            u, v = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return full.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def similar_sets(marked: DataFrame, similarity: tuple[int, int] = LEAST) -> DataFrame:
    """(row, component) for the rows of set_points() that have a set: component is the smallest row reachable over pairs at the similarity or above."""
    some = marked.where("n_shingles > 0")
    named = materialize(some.groupBy(*SET_COLUMNS).agg(F.min("row").alias("node")), "sets")
    first_of = some.join(named.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    points = materialize(first_of.select("node", "n_shingles", *SKETCH_COLUMNS, "keys"), "set-points")
    sets = some.select(F.col("row").alias("node"), "shingles")
    check = lambda pairs: verified(pairs, points, sets, similarity, SKETCH_COLUMNS, near_sketches)

    dealt = points.select("node", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key", "lo")
    held = materialize(dealt.join(shared, "key"), "held")
    tried = materialize(held.where("node > lo").select(F.col("node").alias("u"), F.col("lo").alias("v")).distinct(), "tried")
    links = [check(tried)]
    group = components(links[0])
    level, used = held.select("key", "node").join(group, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), []
    for depth in range(LEVELS):
        level = materialize(level, "level")
        sizes = level.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        mixed = materialize(level.join(sizes.where("lo < hi").select("key", "n"), "key"), "mixed")
        discard(level)
        used.append(mixed)
        few, many = mixed.where(F.col("n") <= SMALL), mixed.where(F.col("n") > SMALL)
        pairs = materialize(compared(few, points, similarity), "compared")
        used.append(pairs)
        if many.isEmpty():
            break
        if depth == LEVELS - 1:
            rest = prefix_pairs(many.select("node", "component").distinct(), sets, similarity)
            used.append(rest)
            break
        level = children(many, sets, similarity)
    brought = [x for x in used if x.columns == ["u", "v"]]
    every = brought[0]
    for x in brought[1:]:
        every = every.unionByName(x)
    links.append(check(every.distinct().join(tried, ["u", "v"], "left_anti")))
    whole = named.join(components(links[0].unionByName(links[1])), "node", "left").select(*SET_COLUMNS, F.coalesce("component", "node").alias("component"))
    out = materialize(some.select("row", *SET_COLUMNS).join(whole, SET_COLUMNS).select("row", "component"), "groups")
    for x in (named, points, held, tried, *links, *used):
        discard(x)
    return out


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = LEAST, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row: the smallest id of its component, and whether that is its own."""
    bounded_batches(docs.sparkSession)
    marked = materialize(set_points(docs, doc_id, text, n), "sketches")
    rows = marked.select("row", "doc_id", "n_shingles").join(similar_sets(marked, similarity), "row", "left").withColumn("component", F.coalesce("component", "row"))
    rows = materialize(rows, "rows")
    discard(marked)
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs)
