"""Importance resampling towards a target distribution, over hashed n-gram features.

Features of a text are all runs of 1 to 3 consecutive words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` (A-Z lower-cased), joined
by one space; a feature's bucket is the crc32 of its UTF-8 bytes modulo BUCKETS.

1. Each partition counts its features by bucket (np.bincount over Arrow batches) into one vector, and treeReduce adds up the
   vectors: BUCKETS numbers reach the driver, whatever the corpus. Source and target counts give each bucket a gain.
2. A second pass looks the gains (a broadcast of BUCKETS numbers) up for every feature, and sums them by document with
   bincount weights. Gumbel noise from a hash of the id turns weights into scores, so that the highest scores are a
   draw without replacement in proportion to exp(weight / 1000).
3. Ranks: documents are range-partitioned by score and written; a document's place is its place in its range and the number of
   rows in the ranges before. No task sees more than its range.

The crc32 of a run of words follows from those of its words: crc(a + b) is crc(b) and a linear map of crc(a) that only the
length of b decides, so whole batches of n-grams are table look-ups; nothing is joined or hashed anew.

Null and empty texts have no words, no features and weight 0. A null id hashes as an empty one and comes last among equal scores.
Repeated rows are scored alike and drawn each on its own. Without eligible documents nothing is drawn; an empty table gives an
empty result, and an empty target the same gains as one that knows nothing. Extra columns are ignored.
"""

import hashlib
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize
from .common import bounded_batches

BUCKETS, NGRAMS, LEAST_WORDS, DRAWN_PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Lower-cases A-Z, and makes a space of each byte that is in no word: all ASCII but digits and letters.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words in the cache of a task at most, and words whose n-grams are taken at once.
MOST_WORDS, AT_ONCE = 200_000, 1 << 18


@lru_cache(1024)
def shift_tables(length: int) -> np.ndarray:
    """(4, 256): what each byte of a crc32 becomes when `length` more bytes follow; the four are combined by XOR."""
    zeros = bytes(length)
    none = zlib.crc32(zeros)
    bits = np.array([zlib.crc32(zeros, 1 << b) ^ none for b in range(32)], np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for b in range(32):
        out[b // 8, (np.arange(256) >> b % 8 & 1).astype(bool)] ^= bits[b]
    return out


class Words(dict):
    """Numbers of words; by number the crc32 of the word, that of a space and the word, and the row of tables for its length."""

    def __init__(self):
        super().__init__()
        self.alone, self.after, self.kind, self.kinds, self.tables = [], [], [], {}, []

    def __missing__(self, word: bytes) -> int:
        length = len(word) + 1
        if length not in self.kinds:
            self.kinds[length] = len(self.tables)
            self.tables.append(shift_tables(length))
        self.alone.append(zlib.crc32(word))
        self.after.append(zlib.crc32(b" " + word))
        self.kind.append(self.kinds[length])
        self[word] = n = len(self)
        return n


def features(texts: list[bytes | None], known: Words, n_buckets: int, most: int):
    """Yield (position of the text, bucket) of all features, in parts; then (number of words of each text). Words of a text split
    over parts are taken together with the words before them."""
    split = [(x or b"").translate(TO_WORDS).split() for x in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    if len(known) > MOST_WORDS:
        known.__init__()
        known.clear()
    numbers = np.fromiter((known[w] for ws in split for w in ws), np.int64, counts.sum())
    alone, after, kind = (np.array(x, t) for x, t in ((known.alone, np.uint32), (known.after, np.uint32), (known.kind, np.int64)))
    tables = np.array(known.tables, np.uint32).reshape(-1, 4, 256)
    row = np.repeat(np.arange(len(split)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(row))  # words from here to the text's end
    for i in range(0, len(row), AT_ONCE):
        crc = alone[numbers[i : i + AT_ONCE]]
        start = np.arange(i, i + len(crc))
        yield row[start], crc % np.uint32(n_buckets)
        for n in range(1, most):
            some = left[start] > n
            start, crc = start[some], crc[some]
            follows = numbers[start + n]
            k = kind[follows]
            moved = after[follows]
            for byte in range(4):
                moved ^= tables[k, byte, (crc >> np.uint32(8 * byte)) & np.uint32(255)]
            crc = moved
            yield row[start], crc % np.uint32(n_buckets)
    yield counts


def bucket_counts(docs: DataFrame, text: str = "text", n_buckets: int = BUCKETS, most: int = NGRAMS) -> np.ndarray:
    """How many features of all texts are in each bucket."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        known, n = Words(), np.zeros(n_buckets, np.int64)
        for batch in batches:
            for found in features(batch.column(0).to_pylist(), known, n_buckets, most):
                if isinstance(found, tuple):
                    n += np.bincount(found[1], minlength=n_buckets)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], names=["counts"])

    vectors = docs.select(F.col(text).cast("binary")).mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.int64))
    if not vectors.getNumPartitions():
        return np.zeros(n_buckets, np.int64)
    return vectors.treeReduce(np.add)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the smoothed log ratio of target and source, rounded down."""
    S, T, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(S + n) / (float(s + 1) * float(T + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """A thousand times a Gumbel number from the id's hash, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", most: int = NGRAMS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row."""
    bounded_batches(docs.sparkSession)
    sent, n_buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches):
        known, gain = Words(), sent.value
        for batch in batches:
            total, number = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for found in features(batch.column(1).to_pylist(), known, n_buckets, most):
                if isinstance(found, tuple):
                    total += np.bincount(found[0], gain[found[1]], batch.num_rows)  # whole numbers, exact below 2^53
                    number += np.bincount(found[0], minlength=batch.num_rows)
                else:
                    n_words = found
            weight = total.astype(np.int64)
            score = weight + np.array([noise(x, seed) for x in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (n_words, number, weight, score))], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary")).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", n_buckets: int = BUCKETS, most: int = NGRAMS,
             least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): rank 1, 2, 3... of the documents drawn, null for the others. Written in the shared folder."""
    gain = gains(bucket_counts(docs, text, n_buckets, most), bucket_counts(target, target_text, n_buckets, most))
    scored = materialize(weights(docs, gain, doc_id, text, most, seed), "scores")
    left_out = F.col("n_words") < least_words
    n_eligible = scored.where(~left_out).count()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [left_out.asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranged = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranges")
    discard(scored)
    part, inside = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, rows = 0, []
    for p, n in sorted(map(tuple, ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())):  # a row for each range
        rows.append((p, before))
        before += n
    offsets = F.broadcast(docs.sparkSession.createDataFrame(rows, "part long, before long"))
    place = F.col("before") + inside + 1
    drawn = ~left_out & (place <= percent * n_eligible // 100)
    return ranged.withColumn("part", part).join(offsets, "part").select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, place).alias("rank"))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH RECURSIVE bits(k, i, c) AS (
  SELECT 0, CAST(range AS BIGINT), CAST(range AS BIGINT) FROM range(256)
  UNION ALL
  SELECT k + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), t AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text FROM benchmark),
d AS (
  SELECT r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM texts
), f AS (
  SELECT r, unnest(list_transform(range(1, len(ws) + 2 - n), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS f
  FROM d, (VALUES (1), (2), (3)) AS lengths(n)
), g AS (SELECT r, f, count(*) AS k FROM f GROUP BY r, f),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM g)),
l AS (SELECT f, list_transform(range(0, len(h) // 2), lambda j: (instr('0123456789ABCDEF', h[2*j+1]) - 1) * 16 + instr('0123456789ABCDEF', h[2*j+2]) - 1) AS l FROM h),
b AS (SELECT f, xor(list_reduce(l, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b FROM l, t),
n AS (SELECT r, b, CAST(sum(k) AS BIGINT) AS k FROM g JOIN b USING (f) GROUP BY r, b),
c AS (SELECT b, coalesce(sum(k) FILTER (r > 0), 0) AS s, coalesce(sum(k) FILTER (r < 0), 0) AS t FROM n GROUP BY b),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM c),
gains AS (SELECT b, floor(1000 * ln(CAST(c.t + 1 AS DOUBLE) * (z.s + 10000) / (CAST(c.s + 1 AS DOUBLE) * (z.t + 10000)))) AS gain FROM c, z),
w AS (SELECT r, CAST(sum(k) AS BIGINT) AS n_features, CAST(sum(k * gain) AS BIGINT) AS weight FROM n JOIN gains USING (b) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(ws) >= 20 AS eligible, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (r) WHERE r > 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY eligible) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 5 * n // 100 THEN place END AS rank FROM ranked
"""
