"""SimHash near-duplicates by a binary trie self-join.

A fingerprint has a bit for each of 64 positions: whether over half of the feature hashes have
it set. Distinct fingerprints form a binary trie (a sorted array: a node is a range). The
self-join walks pairs of nodes down together, adds an error where the two take different bits,
and drops a pair as soon as its errors exceed the budget k; whole arrays of node pairs take each
level at once.

To share the walk among tasks without sending node pairs around: of k+1 blocks of the bits, one is
equal in any two fingerprints that differ in k or fewer. So the trie is walked once for each
block, with that block's bits on top, where no errors are spent; those levels are then a
partition key. The same argument holds for the remaining bits below, so with very many fingerprints the key
also has one of k+1 sub-blocks: crowded blocks are split exactly, not cut off. A task emits for each set of fingerprints
that it finds linked only the links of a spanning forest, at most one for each fingerprint
that it reads, and components.py joins the forests.

Exact copies share a fingerprint and meet in one group minimum, never as pairs. Null and empty
texts have fingerprint zero and link like any other. Rows with a null id get their group's
component and never name one. Repeated rows have equal results. Extra columns of the input are
ignored. An empty table gives an empty result.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, materialize
from .common import ROLL, WordHashes, bounded_batches, mix, rolling
from .components import components

BITS = 64
#: Fingerprints that may share one block on average before the key takes a sub-block too.
CROWDED = 2000
#: Points that one task walks at once. A key with more is dealt in chunks of half as many, each pair of chunks to a task.
MOST_POINTS = 200_000


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):  # a very long text has its bits unpacked in parts
        ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def shingle_fingerprint(data: bytes | None, n: int = 3, seed: int = 42) -> int:
    """Of the XXH64 of n-word shingles, repeats included; fewer words make one shingle, none make zero."""
    words = (data or b"").lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return digest(b" ".join(words), seed)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return majority(np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(words) - n + 1))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = [signed(shingle_fingerprint(x.as_py(), n, seed)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary")).mapInArrow(run, "doc_id long, fp long")


def blocks(bits: list[int], n: int) -> list[list[int]]:
    """n runs of nearly equal length."""
    ends = [len(bits) * i // n for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def keys(fp: str, k: int, twice: bool) -> Column:
    """Partition keys of a fingerprint: longs of which two fingerprints within k bits share at least one.

    k+1 blocks; or twice, with k+1 sub-blocks of the rest for each, when there are so many
    fingerprints that a block alone would be shared by thousands. Both find the same pairs.
    """
    out, every = [], list(range(BITS))
    for i, top in enumerate(blocks(every, k + 1)):
        rest = [b for b in every if b not in set(top)]
        if not twice:
            out.append(F.xxhash64(F.lit(i), F.col(fp).bitwiseAND(F.lit(signed(sum(1 << b for b in top))))))
            continue
        for j, below in enumerate(blocks(rest, k + 1)):
            mask = signed(sum(1 << b for b in [*top, *below]))
            out.append(F.xxhash64(F.lit(i * (k + 1) + j), F.col(fp).bitwiseAND(F.lit(mask))))
    return F.array(*out)


def pairs_of(run: np.ndarray, label=None):
    """Yield all pairs of the positions in run; with label only those apart, each from the side outside the largest set."""
    if label is None:
        for i, x in enumerate(run.tolist()):
            yield np.full(len(run) - i - 1, x), run[i + 1 :]
        return
    sets, where, sizes = np.unique(label(run), return_inverse=True, return_counts=True)
    for x in run[where != sizes.argmax()].tolist() if len(sets) > 1 else ():
        y = run[label(run) != label(x)]
        yield np.full(len(y), x), y


def walk(key: np.ndarray, fp: np.ndarray, k: int, at_once: int = 1 << 18, label=None):
    """Yield positions (a, b) of the pairs with equal keys and fingerprints within k bits; (key, fp) must be sorted.

    A frontier of over at_once node pairs is walked on in parts, so memory stays bounded in crowded keys.
    label(positions) names the sets that the caller has linked so far: then a pair of nodes that lie in one set
    is dropped whole, since its pairs can link nothing more. Neighbours in the order, and each key's
    first, are yielded before the walk, so a large group of near copies is one set by then and not paired.
    """
    if label is not None and len(key):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        at = np.arange(len(key))
        for before in (np.repeat(first, np.diff(np.append(first, len(key)))), at - 1, at - 2, at - 4, at - 8):
            b = at[(before >= 0) & (before < at)]
            a = before[b]
            near = (key[a] == key[b]) & (np.bitwise_count(fp[a] ^ fp[b]) <= k)
            yield a[near], b[near]
    ones = np.zeros((BITS, len(fp) + 1), np.int32)
    for bit in range(BITS):
        np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), out=ones[bit, 1:])
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    lo, hi = edges[:-1], edges[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    open_pairs = [(BITS - 1, (lo, hi, lo, hi, np.zeros(len(lo), np.int64)))]
    while open_pairs:
        bit, pairs = open_pairs.pop()
        if len(pairs[0]) > at_once:
            for i in range(0, len(pairs[0]), at_once):
                open_pairs.append((bit, tuple(x[i : i + at_once] for x in pairs)))
            continue
        if label is not None and len(pairs[0]):
            now = label(slice(None))
            change = np.concatenate([[0], np.cumsum(now[1:] != now[:-1])])
            a0, a1, b0, b1, _ = pairs
            one_set = (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (now[a0] == now[b0])
            pairs = tuple(x[~one_set] for x in pairs)
        a0, a1, b0, b1, errors = pairs
        if not len(a0):
            continue
        if bit < 0:  # runs of equal fingerprints: distinct fingerprints have none, but guarded points may
            for x0, x1, y0, y1 in zip(a0, a1, b0, b1, strict=True):
                yield from pairs_of(np.arange(x0, x1) if x0 == y0 else np.concatenate([np.arange(x0, x1), np.arange(y0, y1)]), label)
            continue
        one = ones[bit]
        am, bm = a1 - (one[a1] - one[a0]), b1 - (one[b1] - one[b0])
        own = a0 == b0  # a node with itself: its two children meet once
        children = [(a0, am, b0, bm, errors), (am, a1, bm, b1, errors), (a0, am, bm, b1, errors + 1),
                    (am[~own], a1[~own], b0[~own], bm[~own], errors[~own] + 1)]
        a0, a1, b0, b1, errors = (np.concatenate(x) for x in zip(*children, strict=True))
        good = (a1 > a0) & (b1 > b0) & (errors <= k) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, errors = a0[good], a1[good], b0[good], b1[good], errors[good]
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)  # two single fingerprints: their other bits are compared at once
        x, y = a0[leaf], b0[leaf]
        near = np.bitwise_count(fp[x] ^ fp[y]) <= k
        yield x[near], y[near]
        open_pairs.append((bit - 1, (a0[~leaf], a1[~leaf], b0[~leaf], b1[~leaf], errors[~leaf])))


class Forest:
    """Union-find that keeps the pairs which joined two sets."""

    def __init__(self, node: np.ndarray):
        self.ids, self.at = np.unique(node, return_inverse=True)
        self.parent = np.arange(len(self.ids))
        self.kept: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.at[a], self.at[b]
        apart = self.parent[x] != self.parent[y]  # every parent is a root here
        if not apart.any():
            return
        up = self.parent
        for x, y in np.unique(np.stack([x[apart], y[apart]]), axis=1).T.tolist():
            r, s = x, y
            while up[r] != r:
                up[r] = r = up[up[r]]
            while up[s] != s:
                up[s] = s = up[up[s]]
            if r != s:
                up[max(r, s)] = min(r, s)
                self.kept.append((x, y))
        while not np.array_equal(self.parent, flat := self.parent[self.parent]):
            self.parent = flat

    def label(self, positions) -> np.ndarray:
        """The sets of positions, by their roots."""
        return self.parent[self.at[positions]]

    def edges(self) -> pa.RecordBatch:
        kept = np.array(self.kept, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[kept[:, 0]]), pa.array(self.ids[kept[:, 1]])], names=["u", "v"])


def chunked(keyed: DataFrame, most: int) -> DataFrame:
    """keyed with keys of `most` rows about: a row of a larger key goes to a new key for each pair of chunks that its own chunk is in.

    Any two rows of the old key meet in one of the new ones. For c chunks a row is sent c times.
    """
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    chunks = F.ceil(F.col("_n") / (most / 2))
    mine = F.pmod(F.xxhash64("node"), F.col("_chunks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)
    pairs = F.transform(others, lambda c: F.xxhash64("key", F.least(c, "_mine"), F.greatest(c, "_mine")))
    sized = keyed.join(sizes.select("key", chunks.alias("_chunks")), "key", "left").withColumn("_mine", mine)
    return sized.withColumn("key", F.explode(F.when(F.col("_chunks").isNull(), F.array("key")).otherwise(pairs))).select(keyed.columns)


def whole_keys(batches, at_once: int):
    """Yield tables of at_once rows about from batches sorted by key, never a part of a key."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= at_once:  # the last key may go on
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            start = int(np.searchsorted(key, key[-1]))
            if start:
                yield table.slice(0, start)
                held, rows = table.slice(start).to_batches(), table.num_rows - start
    if rows:
        yield pa.Table.from_batches(held)


def links(points: DataFrame, k: int, guards: list[str] = (), within: int = 0) -> DataFrame:
    """(u, v): a spanning forest, for each task, of the pairs of points (node long, fp long, guards long...) that are linked.

    Linked: fp within k bits and, where guards are given, all guards together within `within` bits. Keys are blocks, or with
    very many points blocks and sub-blocks, and keys of more than MOST_POINTS points are dealt in chunks. All three find the same pairs,
    so what is linked doesn't depend on the size of the input.
    """
    bounded_batches(points.sparkSession)
    guards = list(guards)
    n_points = points.count()
    twice = n_points > CROWDED << (BITS // (k + 1))
    wide = points.select("node", "fp", *guards, F.explode(keys("fp", k, twice)).alias("key"))
    if n_points > MOST_POINTS:  # with fewer no key can have more
        wide = chunked(wide, MOST_POINTS)
    rows_at_once, spark = MOST_POINTS, points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def join(table: pa.Table) -> pa.RecordBatch:
        key, fp, node = (table.column(c).to_numpy() for c in ("key", "fp", "node"))
        order = np.lexsort((fp.view(np.uint64), key))
        key, fp, node = key[order], fp[order].view(np.uint64), node[order]
        found = Forest(node)
        sides = [table.column(g).to_numpy()[order].view(np.uint64) for g in guards]
        for a, b in walk(key, fp, k, label=found.label):
            if guards:
                apart = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in sides)
                a, b = a[apart <= within], b[apart <= within]
            if len(a):
                found.add(a, b)
        return found.edges()

    def run(batches):
        for table in whole_keys(batches, rows_at_once):
            yield join(table)

    return wide.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def clusters(marked: DataFrame, k: int, guards: list[str] = (), within: int = 0) -> DataFrame:
    """marked (doc_id, fp, guards...) with component_id: the smallest doc_id reachable over links."""
    columns = ["fp", *guards]
    points = materialize(marked.groupBy(*columns).agg(F.min("doc_id").alias("node")), "points")
    found = components(links(points.where("node is not null"), k, guards, within))
    named = points.join(found, "node", "left").select(*columns, F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, columns)


def near_duplicates(docs: DataFrame, k: int = 2, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: shingles of n words, links at k or fewer bits."""
    return clusters(materialize(fingerprints(docs, doc_id, text, n), "fingerprints"), k)


WORD_TABLES, SHINGLE_TABLES, SKETCH_SHINGLE, SKETCH_K = 6, 4, 5, 4
#: Bits of 256 in which documents of similarity 0.8 differ on average: 256/pi * arccos(2 * 0.8 / 1.8) = 38.8, and one standard deviation more.
SKETCH_WITHIN = 44
#: Min-hash keys of a text, and the minima that make one: two texts of similarity j share a key with 1 - (1 - j**4)**16, 0.9998 at 0.8.
BANDS, BAND_MINIMA = 16, 4

WORD_COLUMNS = [f"w{t}" for t in range(WORD_TABLES)]
SHINGLE_COLUMNS = [f"s{t}" for t in range(SHINGLE_TABLES)]
#: 128 bits that name a set of shingles: texts with equal sets are one point.
SET_COLUMNS = ["id0", "id1"]
STEP = np.uint64(0xD1B54A32D192ED03)
#: Bits of 256 beyond which two sets aren't compared: five standard deviations (5.74) over the mean at similarity 0.8, so that of 3 million such pairs one is lost.
APART = 68
#: Jaccard similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: Ids or pairs of ids that are broadcast at most (8 or 16 MB); more are joined by a shuffle.
MOST_SENT = 1 << 20
#: Sets of one shingle that are compared in one task; more are dealt in pairs of chunks of half as many.
MOST_POSTS = 4096
#: Slots of the table of shingle frequencies, a byte each: its size is fixed, and results don't depend on what it holds.
SLOTS = 1 << 18


def shingle_set(data: bytes | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words, distinct five-word shingles) as sorted hashes; fewer words make one shingle, none make none."""
    h = hashes.of((data or b"").lower().split())
    with np.errstate(over="ignore"):
        shingles = rolling(h, SKETCH_SHINGLE) if len(h) > SKETCH_SHINGLE else rolling(h, len(h)) if len(h) else h
    return np.unique(h), np.unique(shingles)


def set_name(x: np.ndarray) -> list[int]:
    """128 bits of a set of hashes, as two signed numbers."""
    with np.errstate(over="ignore"):
        return [signed(int(mix(mix(x + STEP * np.uint64(101 + i)) ^ ROLL).sum(dtype=np.uint64))) for i in range(2)]


def sketch(words: np.ndarray, shingles: np.ndarray) -> list[int]:
    """The name of the set of shingles, then WORD_TABLES 64-bit SimHashes of the words and SHINGLE_TABLES of the shingles."""
    with np.errstate(over="ignore"):
        return set_name(shingles) + majorities(words, WORD_TABLES) + majorities(shingles, SHINGLE_TABLES)


def majorities(x: np.ndarray, tables: int, at_once: int = 1 << 12) -> list[int]:
    """majority() of the values mixed in so many ways, as signed numbers; a very long text has its values taken in parts."""
    seeds, ones = np.arange(1, tables + 1, dtype=np.uint64)[:, None] * STEP, np.zeros((tables, BITS), np.int64)
    for i in range(0, len(x), at_once):
        part = mix(x[i : i + at_once] + seeds)
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(*part.shape, 8), axis=2).sum(1, dtype=np.int64)
    return np.packbits(2 * ones > len(x), axis=1).view(">i8")[:, 0].tolist()


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys, each of BAND_MINIMA min-hashes of the shingles; no shingles, no keys."""
    if not len(shingles):
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        ways = mix(np.arange(1, BANDS * BAND_MINIMA + 1, dtype=np.uint64) * STEP)[:, None]
        x, parts = mix(shingles), range(0, len(shingles), 1 << 12)
        least = np.min([((x[i : i + (1 << 12)] ^ ways) * (ways | np.uint64(1))).min(1) for i in parts], axis=0)  # one multiplication permutes what is mixed already
        keys = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, BAND_MINIMA).T:
            keys = mix(keys * ROLL + column)
    return keys.view(np.int64)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(row, doc_id, id0, id1, SimHashes, n_shingles, keys, shingles) of each row of docs; row is a key that holds once the result is written."""
    bounded_batches(docs.sparkSession)
    names = SET_COLUMNS + WORD_COLUMNS + SHINGLE_COLUMNS
    longs = [T.StructField(c, T.LongType()) for c in ["row", "doc_id", *names, "n_shingles"]]
    schema = T.StructType([*longs, T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("shingles", T.BinaryType())])

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            rows, keys, sets = [], [], []
            for x in batch.column(2):
                words, shingles = shingle_set(x.as_py(), hashes)
                rows.append((*sketch(words, shingles), len(shingles)))
                keys.append(band_keys(shingles))
                sets.append(packed(shingles))
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
            arrays = [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns], pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    number = F.col(row) if row else F.monotonically_increasing_id()
    return docs.select(number.alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary")).mapInArrow(run, schema)


def packed(x: np.ndarray) -> bytes:
    """A set of sorted 64-bit hashes as the six planes of their upper 48 bits: two of a set of 20,000 are equal in those with 1 in a million."""
    return np.unique(x >> np.uint64(16)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 2:] = planes.T
    return out.view(">u8")[:, 0].astype(np.uint64)


def alike(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = SIMILAR) -> bool:
    """Whether two sorted sets have a Jaccard similarity of `least` (a fraction) or more, in whole numbers."""
    (small, large), (p, q) = sorted((len(a), len(b))), least
    return q * small >= p * large and (p + q) * len(np.intersect1d(a, b, assume_unique=True)) >= p * (small + large)


def near_simhashes(u, v) -> Column:
    """Whether SimHashes of shingles are APART bits apart or fewer."""
    return sum((F.bit_count(u(s).bitwiseXOR(v(s))) for s in SHINGLE_COLUMNS), F.lit(0)) <= APART


def verified(pairs: DataFrame, points: DataFrame, sets: DataFrame, least: tuple[int, int] = SIMILAR, columns: list[str] = SHINGLE_COLUMNS, near_sketches=near_simhashes) -> DataFrame:
    """The pairs (u, v) of nodes (points: n_shingles, sketches) whose sets (node, shingles) are alike, written.

    Pairs whose sizes or sketches (columns; near_sketches says which go together) rule it out are dropped before any set is moved.
    """

    def run(batches):
        for batch in batches:
            a, b = ([unpacked(x.as_py()) for x in batch.column(c)] for c in (2, 3))
            good = pa.array([alike(x, y, least) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["u", "v"]).filter(good)

    p, q = least
    short = lambda c: points.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), *[F.col(s).alias(f"{s}_{c}") for s in columns])
    fits = (q * F.least("n_u", "n_v") >= p * F.greatest("n_u", "n_v")) & near_sketches(*(lambda s, c=c: F.col(f"{s}_{c}") for c in "uv"))
    near = materialize(pairs.join(short("u"), "u").join(short("v"), "v").where(fits).select("u", "v"), "near")
    few = near.count() <= MOST_SENT
    sent = lambda df: F.broadcast(df) if few else df
    one = sets.join(sent(near.withColumnRenamed("u", "node")), "node").select(F.col("node").alias("u"), "v", F.col("shingles").alias("_u"))
    other = sets.join(sent(near.select(F.col("v").alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias("v"), F.col("shingles").alias("_v"))
    out = materialize(one.join(other, "v").select("u", "v", "_u", "_v").mapInArrow(run, "u long, v long"), "links")
    discard(near)
    return out


def slot(x: np.ndarray) -> np.ndarray:
    return (mix(x) % np.uint64(SLOTS)).astype(np.int64)


def levels(sets: DataFrame) -> np.ndarray:
    """By slot, how often its shingles occur in sets (shingles), as the bits of the number."""

    def run(batches):
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(n, slot(unpacked(x.as_py())), 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["slot", "n"])

    found = sets.select("shingles").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[found["slot"].to_numpy()] = np.frexp(found["n"].to_numpy().astype(np.float64))[1]
    return out


def prefixes(sets: DataFrame, level: np.ndarray, least: tuple[int, int] = SIMILAR) -> DataFrame:
    """(token, node, component, n, at) from sets (node, component, shingles): a set's shingles at places 0, 1, ... of one order of
    all shingles, rare ones first, as far as the first one that it shares with a set at similarity `least` can stand."""
    p, q = least
    names, kinds = ["token", "node", "component", "n", "at"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            parts = [(np.empty(0, np.int64),) * 5]
            for node, component, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = unpacked(data)
                first = np.lexsort((x, level[slot(x)]))[: len(x) - -(-p * len(x) // q) + 1]
                parts.append((x[first].view(np.int64), *(np.full(len(first), i) for i in (node, component, len(x))), np.arange(len(first))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k.to_pandas_dtype())) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)], names=names)

    return sets.select("node", "component", "shingles").mapInArrow(run, "token long, node long, component long, n int, at int")


def fitting(key: np.ndarray, n: np.ndarray, at: np.ndarray, component: np.ndarray, least: tuple[int, int]):
    """Yield positions (a, b) of rows with one key, of two components, whose sets can be alike if the key is their first common shingle.

    Rows are sorted by (key, n). As the smaller set, a row is taken only where its place leaves room for a set of its own size.
    """
    p, q = least
    _, rank = np.unique(key, return_inverse=True)
    order = rank << 32 | n
    end = np.searchsorted(order, rank << 32 | q * n // p, side="right")  # what is larger than this is too large
    a, step = np.flatnonzero((p + q) * at <= (q - p) * n), 0
    while len(a):
        step += 1
        a = a[a + step < end[a]]
        b = a + step
        good = (component[a] != component[b]) & ((p + q) * np.minimum(n[a] - at[a], n[b] - at[b]) >= p * (n[a] + n[b]))
        yield a[good], b[good]


def by_length(posts: DataFrame, least: tuple[int, int]) -> DataFrame:
    """posts under keys of their shingle and a partition of set lengths, each as wide as `least` allows: a set goes to its own and to the next."""
    p, q = least
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(q / p))
    return posts.withColumn("key", F.explode(F.array(F.xxhash64("key", part), F.xxhash64("key", part + 1))))


def prefix_pairs(members: DataFrame, sets: DataFrame, least: tuple[int, int] = SIMILAR) -> DataFrame:
    """(u, v), u > v: every pair of members (node, component) of two components whose sets (node, shingles) can be alike; written.

    Two sets of similarity 0.8 share at least 4/9 of the sum of their sizes, and no more than what stands from
    their first common shingle on, in whatever order. In an order with rare shingles first, a passage or a base text that
    many members share stands last: those that have more of their own than 0.8 allows meet no one. Shingles of more than
    MOST_POSTS sets are dealt in chunks, so no task holds one whole; sets far apart in size don't meet.
    """
    mine = materialize(sets.join(F.broadcast(members) if members.count() <= MOST_SENT else members, "node").select("node", "component", "shingles"), "members")
    posts = materialize(prefixes(mine, levels(mine), least), "prefixes")
    out = post_pairs(posts, least)
    discard(mine)
    discard(posts)
    return out


def post_pairs(posts: DataFrame, least: tuple[int, int], parted: bool = False) -> DataFrame:
    """(u, v), u > v, of prefix_pairs() from rows of prefixes(); written. parted: shingles are split by set length first."""
    mixed = posts.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    keyed = posts.join(mixed, "token", "left_semi").withColumnRenamed("token", "key")
    shared = chunked(by_length(keyed, least) if parted else keyed, MOST_POSTS)
    parts, rows_at_once = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_POINTS

    def run(batches):
        for table in whole_keys(batches, rows_at_once):
            key, n, at, component, node = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "at", "component", "node"))
            order = np.lexsort((n, key))
            key, n, at, component, node = key[order], n[order], at[order], component[order], node[order]
            found = [np.stack([np.maximum(node[a], node[b]), np.minimum(node[a], node[b])]) for a, b in fitting(key, n, at, component, least) if len(a)]
            if found:
                u, v = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return materialize(shared.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct(), "prefix-pairs")


def sketch_links(points: DataFrame) -> DataFrame:
    """(u, v): pairs that the trie join finds over the SimHashes of words, near in those of shingles too. A forest: it leaves out pairs."""
    found = None
    for w in WORD_COLUMNS:
        one = links(points.select("node", F.col(w).alias("fp"), *SHINGLE_COLUMNS), SKETCH_K, SHINGLE_COLUMNS, SKETCH_WITHIN)
        found = one if found is None else found.unionByName(one)
    return found


def similar_groups(marked: DataFrame) -> DataFrame:
    """(row, component) for rows of sketches(): the components of all pairs of sets found with a similarity of 0.8 or more.

    Two rounds. The first checks the forest of the trie join, and each min-hash key's rows against the
    key's first and last: that costs about the number of keys, and makes one component of most groups of near copies. The
    second takes all rows of keys whose rows it has not put in one component, and checks every pair of them in two components
    that prefix_pairs() can't rule out. So a pair that shares a key is left out only where it could link nothing more
    or is not alike, and every link is checked exactly.
    """
    named = materialize(marked.groupBy(*SET_COLUMNS).agg(F.min("row").alias("node")), "sets")
    sets = marked.select(F.col("row").alias("node"), "shingles")
    points = materialize(marked.drop("shingles").join(named.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node"), "set-points")
    dealt = points.select("node", F.explode("keys").alias("key"))
    ends = dealt.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    held = materialize(dealt.join(ends, "key"), "held")
    star = held.where("node > lo").select(F.col("node").alias("u"), F.col("lo").alias("v")).unionByName(held.where("node < hi").select(F.col("hi").alias("u"), F.col("node").alias("v")))
    sketched = sketch_links(points)
    ordered = sketched.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    tried = materialize(star.unionByName(ordered).distinct(), "tried")
    first = verified(tried, points, sets)
    group = components(first)
    apart = held.select("key", "node").join(group, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = apart.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    left = materialize(apart.join(mixed, "key", "left_semi"), "apart")
    members = left.select("node", "component").distinct()
    paired = prefix_pairs(members, sets)
    rest = paired.join(tried, ["u", "v"], "left_anti")
    second = verified(rest, points, sets)
    whole = named.join(components(first.unionByName(second)), "node", "left").select(*SET_COLUMNS, F.coalesce("component", "node").alias("component"))
    out = materialize(marked.select("row", *SET_COLUMNS).join(whole, SET_COLUMNS).select("row", "component"), "groups")
    for used in (named, points, held, tried, first, left, paired, second):
        discard(used)
    return out


def near_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id): documents alike in five-word shingles at 0.8 or more, as a near-dedup stage takes them.

    SimHash of five-word shingles is too far apart at 0.8 (about 10 of 64 bits) for any trie budget
    that scales. So candidates are found by the trie join over independent SimHashes of
    their words, at SKETCH_K bits in any of them, and by min-hashes of their shingles; and linked if
    the exact Jaccard similarity of their sets of shingles is 0.8 or more.
    """
    rows = near_rows(sketches(docs, doc_id, text))
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component").select("doc_id", "component_id")


def near_rows(sketched: DataFrame) -> DataFrame:
    """(row, doc_id, component) for each row of sketches()."""
    marked = materialize(sketched, "sketches")
    rows = materialize(marked.select("row", "doc_id").join(similar_groups(marked), "row"), "named")
    discard(marked)
    return rows


def survivors(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(row): of each group of docs (row, columns...) that are alike the one with the least id, null ids last; of equal ids the least hash of columns."""
    groups = near_rows(sketches(docs, row="row")).select("row", "component")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64(*columns).alias("hash"), "row")
    first = docs.select("row", order.alias("order")).join(groups, "row").groupBy("component").agg(F.min("order").alias("order"))
    return first.select("order.row")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
