"""Packing into fixed-length sequences: shortest-pack-first over the length histogram.

Every document's ids (with a closing id) are cut into full pieces of `size` tokens and one shorter
rest. Only the histogram of piece lengths, at most `size` numbers whatever the corpus, reaches
the driver. There the lengths are placed longest first, each into the pack with the most room
left (the shortest pack), updating counts of packing patterns rather than packs; patterns are
split where counts differ. When no pack has room, as many are opened as the pieces of that length fill. The patterns are
then joined back to the pieces: the r-th piece of a length takes the r-th slot of that length. Ranks need no global sort:
each task counts the lengths it writes, and the tasks' counts are summed up by length.

A length opens patterns once and splits one of them at most, so there are at most twice as many patterns as lengths, each of at most
64 different lengths (their sum is the size): that bounds what the driver holds and broadcasts, whatever the corpus.

Null text is empty: one piece, the closing id alone. Repeated rows are packed as often as they
occur. An empty table gives an empty result. Other columns of the documents are not carried.
"""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import chunks
from ..storage import materialize
from .common import bounded_batches

SIZE, CLOSING = 2048, 1

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("rank_in_part", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])


def pieces(docs: DataFrame, path: str, size: int = SIZE, closing: int = CLOSING, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """The cut documents, written in the shared folder: ids are packed as little-endian unsigned 32-bit integers.

    ids_crc32 is their checksum; without ids, it alone is written.
    """
    bounded_batches(docs.sparkSession)
    last = np.array([closing], "<u4").tobytes()
    schema = PIECES if with_ids else T.StructType(PIECES.fields[:-1])

    def run(batches):
        table, seen, part = chunks(path), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc, packed in zip(batch.column(0).to_pylist(), table.of(batch.column(1).to_pylist()), strict=True):
                packed += last
                total = len(packed) // 4
                for start in range(0, total, size):
                    length = min(size, total - start)
                    ids = packed[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, total, part, seen[length], zlib.crc32(ids), ids)[: len(schema)])
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            types = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types[: len(schema)], strict=True)], names=schema.names)

    found = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(run, schema)
    return materialize(found, "pieces")


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packs: longest lengths first, each into the packs with the most room; new packs are as few as hold what is left."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by what is left
    roomiest = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while roomiest and not room[roomiest]:
                roomiest -= 1
            if roomiest >= length:
                count, pack = room[roomiest].pop()
                used, free = min(count, left), roomiest
                if count > used:
                    room[free].append((count - used, pack))
            else:
                used, free, pack = -(-left // (size // length)), size, ()
            room[free - length].append((used, (*pack, length)))
            roomiest = max(roomiest, free - length)
            left -= used
    return [x for free in sorted(room) for x in room[free]]


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> tuple[list[tuple], list[tuple]]:
    """For each length and pattern the range of ranks [first, last) that takes its places there: (length, block, first, last, sequence, offset, times),
    and (length, width). Ranks go in blocks of `width`, about as many as the length has ranges, so a rank finds its range among a few: a range has a row for each block that it reaches into."""
    ranges, sequence = defaultdict(list), 0
    for count, pack in packs:
        at = 0
        for length, times in Counter(pack).items():  # longest first, as they were placed
            first = ranges[length][-1][1] if ranges[length] else 0
            ranges[length].append((first, first + count * times, sequence, at, times))
            at += length * times
        sequence += count
    widths = [(length, -(-found[-1][1] // len(found))) for length, found in ranges.items()]
    rows = [(length, block, *x) for length, width in widths for x in ranges[length] for block in range(x[0] // width, (x[1] - 1) // width + 1)]
    return rows, widths


def assign(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """cut (pieces() or some of its columns) with sequence_id and offset; any other columns pass through."""
    spark = cut.sparkSession
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    rows, widths = slots(patterns(histogram, size))
    placed = F.broadcast(spark.createDataFrame(rows, "length long, _block long, _first long, _last long, _sequence long, _offset long, _times long"))
    wide = F.broadcast(spark.createDataFrame(widths, "length long, _width long"))
    ranked = cut.join(bases, ["part", "length"]).join(wide, "length").withColumn("_rank", F.col("_base") + F.col("rank_in_part"))
    found = ranked.withColumn("_block", F.expr("_rank div _width")).join(placed, ["length", "_block"]).where("_rank >= _first and _rank < _last")
    return found.select(
        *[c for c in cut.columns if c not in ("part", "rank_in_part")],
        F.expr("_sequence + (_rank - _first) div _times").alias("sequence_id"),
        F.expr("_offset + (_rank - _first) % _times * length").alias("offset"),
    )


def op1_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign(pieces(docs, path, with_ids=False)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
