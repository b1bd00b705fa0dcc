"""Which of many strings stand in which texts: one pass over whole texts with an automaton of the strings' beginnings.

The strings are read in parts that are small enough to be broadcast, by a size that is counted first; each part is one pass over the texts.
A part's automaton (Aho-Corasick) holds the first PREFIX characters of its strings, so its size follows their number and not their
length; where a beginning is found, the whole string is compared. Texts stay where they are: nothing is exploded or shuffled.
"""

import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_batches

PREFIX = 64
#: Bytes of strings, and characters of their beginnings (a state of the automaton each), in one part about.
PART_BYTES, PART_STATES = 16 << 20, 2_000_000

_built: dict[str, ahocorasick.Automaton] = {}


def automaton(strings: list[str]) -> ahocorasick.Automaton:
    """Of the strings' beginnings; the value of one is its length and the (string, rows) that start so."""
    rows: dict[str, list[int]] = {}
    for i, s in enumerate(strings):
        rows.setdefault(s, []).append(i)
    starts: dict[str, list] = {}
    for s, at in rows.items():
        starts.setdefault(s[:PREFIX], []).append((s, at))
    out = ahocorasick.Automaton()
    for start, whole in starts.items():
        out.add_word(start, (len(start), whole))
    out.make_automaton()
    return out


def held(token: str, table: pa.Table) -> ahocorasick.Automaton:
    """The automaton of a part, built once in a worker; a worker holds one."""
    if token not in _built:
        _built.clear()
        _built[token] = automaton(table.column("pattern").to_pylist())
    return _built[token]


def rows_found(machine: ahocorasick.Automaton, text: str) -> list[int]:
    found = set()
    for end, (length, whole) in machine.iter(text):
        for string, rows in whole:
            if text.startswith(string, end - length + 1):
                found.update(rows)
    return sorted(found)


def parts(strings: DataFrame, part_bytes: int, part_states: int):
    """Yield the strings (item, pattern) in parts of about these sizes, as tables; equal strings share a part."""
    sizes = strings.agg(F.sum(F.octet_length("pattern")).alias("b"), F.sum(F.least(F.length("pattern"), F.lit(PREFIX))).alias("s")).first()
    n = max(1, -(-(sizes.b or 0) // part_bytes), -(-(sizes.s or 0) // part_states))
    for i in range(n):
        table = strings.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == i).toArrow()
        if table.num_rows:
            yield table


def contained(texts: DataFrame, strings: DataFrame, text: str, item: str, pattern: str, *keys: str, part_bytes: int = PART_BYTES, part_states: int = PART_STATES) -> DataFrame:
    """(keys..., item) for each row of texts and each row of strings whose pattern stands in the text, code point by code point.

    Null and empty patterns stand nowhere, and nothing stands in a null text. Repeated rows on either side give repeated results.
    """
    spark = texts.sparkSession
    bounded_batches(spark)
    some = strings.select(F.col(item).alias("item"), F.col(pattern).cast("string").alias("pattern")).where(F.length("pattern") > 0)
    schema = T.StructType([*[T.StructField(k, texts.schema[k].dataType) for k in keys], T.StructField(item, strings.schema[item].dataType)])
    out = spark.createDataFrame([], schema)
    for table in parts(some, part_bytes, part_states):
        out = out.unionByName(texts.select(*keys, F.col(text).alias("_text")).mapInArrow(scan(spark.sparkContext.broadcast(table), schema.names), schema))
    return out


def scan(sent, names: list[str]):
    """The pass over batches of (keys..., text) with one part."""
    token = uuid.uuid4().hex

    def run(batches):
        machine, items = held(token, sent.value), sent.value.column("item").combine_chunks()
        for batch in batches:
            row, at = [], []
            for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if t:
                    found = rows_found(machine, t)
                    row += [i] * len(found)
                    at += found
            where = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(where) for c in batch.columns[:-1]), items.take(pa.array(at, pa.int64()))], names=names)

    return run
