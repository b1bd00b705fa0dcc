"""Exact substring dedup by fixed-block anchors.

A window is `window` (20) consecutive words of one document; a word goes if a window over it
also starts earlier (smaller doc_id, or same document and earlier start).

1. Documents, in order of doc_id, are cut into blocks of a few MB, one row each, written in the
   shared folder. A block is the unit that later steps read again.
2. Anchors. With B = window // 2, every window holds a whole reference block of B words that
   starts at a multiple of B in its document. Each block of documents sends the distinct rolling
   hashes of all its B-word windows, marked where one is a reference block, to buckets of hashes. A
   bucket answers which of them occur in more than one place with a reference block among them: the hits.
3. Extension. Only windows over a hit can repeat. Each block sends one 96-bit hash for each
   distinct such window, with its first place. A bucket answers all but the first in order.
4. Removal. In each block the windows that repeat inside it and those answered are merged to
   maximal exact repeats, and these are cut out of the texts.

A hash is sent once for each block of documents however often it occurs there, so a passage that a
third of all documents share loads its bucket with one entry for each block. Nothing is paired:
a group of copies costs its size. Answers are lists of places, and no step sends text but the
joins of a block with its answers. 32 hash bits inside a bucket suffice for the anchors, since a false hit only
adds a window to step 3; what decides there has 96 bits and those of the bucket.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text, unchanged; null text has none and stays null.
Rows with equal doc_id are ordered as they come; null ids come first. An empty table gives an
empty result. Extra columns are carried along; those named like an output are replaced.
"""

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, materialize, setting
from .common import ARROW_BYTES, NON_WORD, WordHashes, bounded_batches, dealt_by_bucket, mix, parts_for, rolling, text_bytes

WINDOW = 20
#: Text of one block of documents, and about how many hashes one bucket gets.
BLOCK_BYTES, BUCKET_ROWS = 4 << 20, 2_000_000
SECOND = np.uint64(0xD6E8FEB86659FD93)


def blocks(docs: DataFrame, text: str, order: str | None, n_bytes: int) -> DataFrame:
    """One row for each block, written: block long (ascending with `order`, if any), and each column of docs as a list."""
    schema = T.StructType(
        [T.StructField("block", T.LongType())] + [T.StructField(f.name, T.ArrayType(f.dataType)) for f in docs.schema.fields]
    )
    arrow_names, at = docs.columns, docs.columns.index(text)

    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def pack(rows: pa.Table):
            columns = [x.combine_chunks() for x in rows.columns]
            columns = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in columns]
            ends = pa.array([0, rows.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in columns]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), *lists], names=["block", *arrow_names])

        for batch in batches:
            lengths = [len(x) if x else 0 for x in batch.column(at).to_pylist()]
            start = 0
            for i, n in enumerate(lengths):
                size += n
                if size >= BLOCK_BYTES:
                    held.append(batch.slice(start, i + 1 - start))
                    yield pack(pa.Table.from_batches(held))
                    held, size, start, seq = [], 0, i + 1, seq + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield pack(pa.Table.from_batches(held))

    ordered = docs if order is None else docs.repartitionByRange(parts_for(n_bytes), order).sortWithinPartitions(order)
    return materialize(ordered.mapInArrow(run, schema), "blocks")


def as_bytes(column: pa.Array) -> list[list[bytes | None]]:
    """Lists of texts as bytes."""
    return column.cast(pa.list_(pa.binary())).to_pylist()


class Words:
    """The words of one block: their hashes, and where each document starts."""

    def __init__(self, texts: list[bytes | None], hashes: WordHashes):
        self.split = [(x or b"").split() for x in texts]
        self.counts = np.fromiter(map(len, self.split), np.int64, len(self.split))
        self.starts = np.cumsum(self.counts) - self.counts
        flat = list(chain.from_iterable(self.split))
        self.n = len(flat)
        self.h = hashes.of(flat)
        self.inside = np.arange(self.n) - np.repeat(self.starts, self.counts)  # position in its document
        self.left = np.repeat(self.counts, self.counts) - self.inside  # words from here to its end

    def windows(self, n: int) -> np.ndarray:
        """Starts of the n-word windows."""
        return np.flatnonzero(self.left >= n)


def groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal values together, and the start of each group in it. Within a group the order is open."""
    order = np.argsort(h)
    s = h[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)


def pair_groups(h: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """groups() of pairs of values: by the first alone, unless the second tells apart what the first has as equal."""
    order, first = groups(h)
    m = more[order]
    inside = np.ones(len(order), bool)
    inside[first] = False
    if len(order) and (m[1:] != m[:-1])[inside[1:]].any():
        order = np.lexsort((more, h))
        s, m = h[order], more[order]
        first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (m[1:] != m[:-1])]))
    return order, first


def all_but_least(place: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Members (as indices) of the groups, without the one of the least place in each."""
    p = place[order]
    least = np.minimum.reduceat(p, first) if len(p) else p
    return order[p != np.repeat(least, np.diff(np.append(first, len(p))))]


def three(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^24 as three bytes each."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])


def wide(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = data.reshape(-1, 3)
    return out.reshape(-1).view("<u4").astype(np.int64)


def places(x: np.ndarray) -> bytes:
    """Numbers as bytes: one byte for the width, then three or four bytes each."""
    return b"\x03" + three(x).tobytes() if not len(x) or x.max() < 1 << 24 else b"\x04" + x.astype("<u4").tobytes()


def read_places(data: bytes) -> np.ndarray:
    body = np.frombuffer(data, np.uint8, offset=1)
    return wide(body) if data[0] == 3 else body.view("<u4").astype(np.int64)


SENT = "bucket int, block long, keys binary, more binary, places binary"


def sent(block: int, h: np.ndarray, place: np.ndarray, bits: int, more: np.ndarray | None = None) -> list[tuple]:
    """Rows of SENT: hashes (distinct, ascending) by their top bits; the next 32 bits are kept as key."""
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    key = (h >> np.uint64(32 - bits)).astype("<u4")
    present, starts = np.unique(bucket, return_index=True)
    out = []
    for b, start, end in zip(present.tolist(), starts.tolist(), np.append(starts, len(h))[1:].tolist(), strict=True):
        x = slice(start, end)
        out.append((b, block, key[x].tobytes(), b"" if more is None else more[x].astype("<u8").tobytes(), places(place[x])))
    return out


def batch_of(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def anchors(words: Words, n: int):
    """The distinct hashes of all n-word windows: the windows' starts, their order and group starts by hash; and for
    each group its hash, its first start, whether it holds a reference block, and its size."""
    at = words.windows(n)
    h = mix(rolling(words.h, n)[at]) if len(at) else np.empty(0, np.uint64)
    order, first = groups(h)
    sorted_at = at[order]
    rep = np.minimum.reduceat(sorted_at, first) if len(at) else at
    reference = np.maximum.reduceat((words.inside[sorted_at] % n == 0), first) if len(at) else np.empty(0, bool)
    return sorted_at, first, h[order[first]], rep, reference, np.diff(np.append(first, len(at)))


def hit_windows(words: Words, answered: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of 2n words over a hit: an anchor that is answered, or repeats here with a reference block."""
    sorted_at, _, _, rep, reference, size = anchors(words, n)
    if not len(rep):
        return rep
    told = np.zeros(words.n, bool)
    told[answered] = True
    hit = (reference & (size > 1)) | told[rep]
    marked = np.zeros(words.n + 1, np.int64)
    marked[sorted_at[np.repeat(hit, size)] + 1] = 1
    total = np.cumsum(marked)
    starts = words.windows(2 * n)
    return starts[total[starts + n + 1] > total[starts]]


def window_hashes(words: Words, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the n-word windows at starts, from word values mixed in two ways and two multipliers."""
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return mix(rolling(words.h, n)[starts]), mix(rolling(mix(words.h + SECOND), n, SECOND)[starts])


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_out(data: bytes, spans: list[list[int]]) -> bytes:
    """data without the words of each span [from, to). Of the white space on both sides of a span the one with more line breaks stays."""
    at = [m.span() for m in WORD.finditer(data)]
    out, kept_to = [], 0
    for first, last in spans:
        before = data[at[first - 1][1] if first else 0 : at[first][0]]
        after = data[at[last - 1][1] : at[last][0] if last < len(at) else len(data)]
        out += [data[kept_to : at[first][0] - len(before)], before if before.count(b"\n") >= after.count(b"\n") else after]
        kept_to = at[last - 1][1] + len(after)
    return b"".join([*out, data[kept_to:]])


def answered(table: DataFrame) -> DataFrame:
    return table.groupBy("block").agg(F.collect_list("places").alias("_answers"))


def bucket_rows(batches):
    """All rows of each bucket in turn, from batches sorted by bucket."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def repeats(docs: DataFrame, text: str = "text", order: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """docs with the repeated passages cut out of `text`, and n_words, n_removed, removed_spans (word ranges). What stays keeps its white space.

    Written in the shared folder; so are the blocks until it is done.
    """
    if window % 2:
        raise ValueError("window must be even")
    spark, n = docs.sparkSession, window // 2
    bounded_batches(spark)
    docs = docs.select([c for c in docs.columns if c not in ("n_words", "n_removed", "removed_spans")])
    n_bytes = text_bytes(docs, text)
    cut = blocks(docs, text, order, n_bytes)
    bits = max(0, int(n_bytes / 6 / BUCKET_ROWS).bit_length())
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["bucket", "block", "keys", "more", "places"]
    answer = "block long, places binary"

    def send_anchors(batches):
        hashes = WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                for block, texts in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                    _, _, h, rep, reference, _ = anchors(Words(texts, hashes), n)
                    for row in sent(block, h, rep * 2 + reference, bits):
                        yield batch_of([row], names, kinds)

    def find_hits(batches):
        for rows in bucket_rows(batches):
            keys = [np.frombuffer(r[2], "<u4") for r in rows]
            marks = [read_places(r[4]) for r in rows]
            owner = np.repeat(np.arange(len(rows)), [len(x) for x in keys])
            key, mark = np.concatenate(keys), np.concatenate(marks)
            order_, first = groups(key)
            size = np.diff(np.append(first, len(key)))
            hit = (size > 1) & (np.maximum.reduceat(mark[order_] & 1, first) > 0)
            chosen = np.sort(order_[np.repeat(hit, size)])
            yield from replies(rows, owner[chosen], mark[chosen] >> 1)

    def replies(rows, owner, place):
        ends = np.searchsorted(owner, np.arange(len(rows) + 1))
        for i, row in enumerate(rows):
            if ends[i + 1] > ends[i]:
                yield batch_of([(row[1], places(place[ends[i] : ends[i + 1]]))], ["block", "places"], [pa.int64(), pa.binary()])

    def send_windows(batches):
        hashes = WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                for block, texts, told in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    words = Words(texts, hashes)
                    known = np.concatenate([read_places(x) for x in told]) if told else np.empty(0, np.int64)
                    starts = hit_windows(words, known, n)
                    if len(starts):
                        h, h2 = window_hashes(words, starts, window)
                        order_, first = pair_groups(h, h2)
                        rep = order_[first]
                        for row in sent(block, h[rep], np.minimum.reduceat(starts[order_], first), bits, h2[rep]):
                            yield batch_of([row], names, kinds)

    def find_later(batches):
        for rows in bucket_rows(batches):
            rows.sort(key=lambda r: r[1])
            keys = [np.frombuffer(r[2], "<u4") for r in rows]
            owner = np.repeat(np.arange(len(rows)), [len(x) for x in keys])
            key = np.concatenate(keys)
            more = np.concatenate([np.frombuffer(r[3], "<u8") for r in rows])
            place = np.concatenate([read_places(r[4]) for r in rows])
            order_, first = pair_groups(key.astype(np.uint64) << np.uint64(32) | more >> np.uint64(32), more)
            chosen = np.sort(all_but_least(owner << 40 | place, order_, first))
            yield from replies(rows, owner[chosen], place[chosen])

    columns = docs.columns
    out_schema = T.StructType([
        *docs.schema.fields,
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ])
    text_at = columns.index(text)

    def remove(batches):
        hashes = WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                for i in range(batch.num_rows):
                    lists = [batch.column(j + 1).slice(i, 1).flatten() for j in range(len(columns))]
                    told = batch.column(len(columns) + 1)[i].as_py()
                    texts = lists[text_at].cast(pa.binary()).to_pylist()
                    words = Words(texts, hashes)
                    drop = np.zeros(words.n + 1, np.int64)
                    starts = words.windows(window)
                    if len(starts):
                        where = starts[all_but_least(starts, *pair_groups(*window_hashes(words, starts, window)))]
                        if told:
                            where = np.union1d(where, np.concatenate([read_places(x) for x in told]))
                        where = np.unique(where)
                        drop[where] += 1
                        drop[where + window] -= 1
                    gone = np.cumsum(drop[:-1]) > 0
                    kept, removed, spans = [], [], []
                    for t, start, count in zip(texts, words.starts.tolist(), words.counts.tolist(), strict=True):
                        mask = gone[start : start + count]
                        removed.append(int(mask.sum()))
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))) if removed[-1] else np.empty(0, np.int64)
                        spans.append(edge.reshape(-1, 2).tolist())
                        kept.append(cut_out(t, spans[-1]) if removed[-1] else t)
                    if any(removed):
                        lists[text_at] = pa.array([None if x is None else x.decode("utf-8", "replace") for x in kept], pa.string())
                    extra = [pa.array(words.counts), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
                    yield pa.RecordBatch.from_arrays([*lists, *extra], names=[*columns, "n_words", "n_removed", "removed_spans"])

    with setting(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(ARROW_BYTES), spark__sql__execution__arrow__maxRecordsPerBatch="64"):
        hits = materialize(dealt_by_bucket(cut.select("block", text).mapInArrow(send_anchors, SENT), bits).mapInArrow(find_hits, answer), "hits")
        told = cut.select("block", text).join(answered(hits), "block", "left").select("block", text, "_answers")
        later = materialize(dealt_by_bucket(told.mapInArrow(send_windows, SENT), bits).mapInArrow(find_later, answer), "later")
        told = cut.join(answered(later), "block", "left").select("block", *columns, "_answers")
        out = materialize(told.mapInArrow(remove, out_schema), "kept")
    for table in (hits, later, cut):
        discard(table)
    return out


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = repeats(docs)
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), NON_WORD, " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))
