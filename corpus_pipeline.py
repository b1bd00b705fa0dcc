"""The corpus pipeline: quality rules, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and returns a
DataFrame; all but the last have the columns of `documents`. run() writes each stage's result as
Parquet in the shared folder and reads it again for the next, and deletes what no later stage reads: only the last
stage's table stays, for the caller.

Null, empty and short texts fail the quality rules. Two rows that share an id are two documents: each stage keeps or drops them
by their texts. Of near copies the least id stays, null ids last, and of equal ids the least hash of the row; of rows equal in
all columns one. Very long texts are read whole, and packed in as many pieces as it takes. Columns besides those of
`documents` are left out at the start. An empty table gives an empty result.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import packing, quality, simhash, substring
from verdigris.storage import discard, materialize, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.judge(docs).where("kept").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that are alike in five-word shingles, the one with the smallest id; null ids come last, and ids name no group."""
    numbered = materialize(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    return numbered.join(simhash.survivors(numbered, COLUMNS), "row", "left_semi").select(COLUMNS)


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 and more words that occur earlier; those that nothing is left of go."""
    kept = substring.repeats(docs).where("n_words > n_removed or n_words = 0")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, each at its place in a sequence."""
    import public_tokenizers

    return packing.assign(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_substrings),
    ("packing", pack),
]
#: SimHash sketches and the tokenizer's merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES:
        before = docs
        with scratch(spark) as kept:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(docs)
        discard(before)
    return docs
