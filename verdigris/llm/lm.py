"""Language-model scores with stupid backoff, from n-gram counts of the whole corpus.

S(w | context) = c(context w) / c(context) for the longest n-gram that the model has, times ALPHA for each
word of context given up; for a single word c(w) / N. An n-gram of two or more words is in the
model if it occurs MIN_COUNT times or more (one that occurs once is only its own evidence). At
the start of a document the context is what there is.

The relations: each block of documents (a few MB, one written row) is exploded to its distinct
n-grams with counts, keyed by 64-bit hash; the count tables are partitioned by hash into buckets,
where the blocks' counts are summed; each block is joined with the totals of its n-grams, and
the scores are summed by document. An n-gram crosses the network once for each block that has it, pre-counted, so
"of the" loads its bucket with one entry for each block and not for each document. Totals return in the
order sent, without keys.

Null and empty texts have no words and a score of null (logprob 0). Repeated rows are scored alike
and count as often as they occur. An empty table gives an empty result. Extra columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize, setting
from .common import ARROW_BYTES, WordHashes, bounded_batches, dealt_by_bucket, mix, rolling, text_bytes
from .substring import Words, as_bytes, batch_of, blocks

ORDER, ALPHA, MIN_COUNT = 2, 0.4, 2
#: About how many distinct n-grams one bucket gets.
BUCKET_ROWS = 2_000_000


def ngrams(words: Words, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length 1..order: the position of the last word of each n-gram, and its hash."""
    ends, hashes = [], []
    for n in range(1, order + 1):
        starts = words.windows(n)
        ends.append(starts + n - 1)
        hashes.append(mix(rolling(words.h, n)[starts] + np.uint64(n)) if len(starts) else np.empty(0, np.uint64))
    return ends, hashes


def small(x: np.ndarray) -> bytes:
    """Counts as a byte each, with the few large ones after them."""
    large = np.flatnonzero(x > 254)
    body = np.minimum(x, 255).astype(np.uint8)
    return np.array([len(x)], "<i8").tobytes() + body.tobytes() + x[large].astype("<i8").tobytes()


def read_small(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=8 + n)
    return out


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_backoff, logprob): the natural logarithms of S, summed over each document, and how many words backed off."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_bytes = text_bytes(docs)
    total = docs.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    bits = max(0, int(n_bytes / 6 * order / BUCKET_ROWS).bit_length())
    cut = blocks(docs, "text", None, n_bytes)

    def distinct(words: Words):
        ends, hashes = ngrams(words, order)
        keys, where, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        return ends, np.split(where, np.cumsum([len(x) for x in ends])[:-1]), keys, counts

    def send(batches):
        cache = WordHashes()
        names, kinds = ["bucket", "block", "keys", "counts"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        with np.errstate(over="ignore"):
            for batch in batches:
                for block, texts in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                    _, _, keys, counts = distinct(Words(texts, cache))
                    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                    present, starts = np.unique(bucket, return_index=True)
                    for b, start, end in zip(present.tolist(), starts.tolist(), np.append(starts, len(keys))[1:].tolist(), strict=True):
                        x = slice(start, end)
                        yield batch_of([(b, block, keys[x].astype("<u8").tobytes(), small(counts[x]))], names, kinds)

    def count(batches):
        held: list[tuple] = []

        def answer():
            keys = [np.frombuffer(r[2], "<u8") for r in held]
            _, where = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.zeros(where.max() + 1, np.int64)
            np.add.at(sums, where, np.concatenate([read_small(r[3]) for r in held]))
            found = np.split(sums[where], np.cumsum([len(x) for x in keys])[:-1])
            for r, x in zip(held, found, strict=True):
                yield batch_of([(r[1], r[0], small(x))], ["block", "bucket", "totals"], [pa.int64(), pa.int32(), pa.binary()])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and row[0] != held[0][0]:
                    yield from answer()
                    held = []
                held.append(row)
        if held:
            yield from answer()

    def score(batches):
        cache, back = WordHashes(), math.log(alpha)
        with np.errstate(over="ignore"):
            for batch in batches:
                for ids, texts, told in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    words = Words(texts, cache)
                    ends, where, keys, _ = distinct(words)
                    told = sorted(told or [], key=lambda x: x["bucket"])
                    totals = np.concatenate([read_small(x["totals"]) for x in told]) if told else np.empty(0, np.int64)
                    assert len(totals) == len(keys)
                    count_of = np.zeros((order + 1, words.n), np.int64)
                    for n in range(order):
                        count_of[n + 1, ends[n]] = totals[where[n]]
                    logs = np.log(np.maximum(count_of[1], 1) / max(1, total))
                    used = np.ones(words.n, np.int64)
                    for n in range(2, order + 1):
                        has = np.flatnonzero(count_of[n] >= min_count)
                        logs[has] = np.log(count_of[n, has] / count_of[n - 1, has - 1])
                        used[has] = n
                    given_up = np.minimum(order, words.inside + 1) - used
                    logs += back * given_up
                    sums, less = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                    some = words.counts > 0
                    if some.any():
                        sums[some] = np.add.reduceat(logs, words.starts[some])
                        less[some] = np.add.reduceat((given_up > 0).astype(np.int64), words.starts[some])
                    columns = [pa.array(ids, pa.int64()), pa.array(words.counts), pa.array(less), pa.array(sums)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_backoff", "logprob"])

    with setting(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(ARROW_BYTES), spark__sql__execution__arrow__maxRecordsPerBatch="64"):
        exploded = cut.select("block", "text").mapInArrow(send, "bucket int, block long, keys binary, counts binary")
        tables = dealt_by_bucket(exploded, bits)
        totals = materialize(tables.mapInArrow(count, "block long, bucket int, totals binary"), "totals")
        by_block = totals.groupBy("block").agg(F.collect_list(F.struct("bucket", "totals")).alias("told"))
        joined = cut.join(by_block, "block", "left").select("doc_id", "text", "told")
        out = materialize(joined.mapInArrow(score, "doc_id long, n_words long, n_backoff long, logprob double"), "scores")
    discard(totals)
    discard(cut)
    return out


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    per_word = F.when(F.col("n_words") > 0, F.round(F.col("logprob") / F.col("n_words"), 5))
    return scores(docs).select("doc_id", "n_words", "n_backoff", F.round("logprob", 3).alias("logprob"), per_word.alias("logprob_per_word"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d
), b AS (
  SELECT x.doc_id, x.i, x.w, y.w AS v FROM w x LEFT JOIN w y ON x.doc_id = y.doc_id AND x.i = y.i + 1
), c1 AS (SELECT w, count(*) AS c FROM w GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY v, w),
n AS (SELECT count(*) AS n FROM w),
s AS (
  SELECT b.doc_id, b.v IS NOT NULL AND c2.c < 2 AS back,
    CASE WHEN c2.c >= 2 THEN ln(c2.c / cv.c) WHEN b.v IS NULL THEN ln(cw.c / n.n) ELSE ln(0.4) + ln(cw.c / n.n) END AS l
  FROM b JOIN c1 cw ON b.w = cw.w LEFT JOIN c1 cv ON b.v = cv.w LEFT JOIN c2 ON b.v = c2.v AND b.w = c2.w, n
), g AS (SELECT doc_id, count(*) AS k, count_if(back) AS nb, sum(l) AS l FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_words, CAST(coalesce(nb, 0) AS BIGINT) AS n_backoff,
  round(coalesce(l, 0.0), 3) AS logprob, round(l / k, 5) AS logprob_per_word
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
