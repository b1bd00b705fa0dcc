"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

At each anchor (a common word of the languages below) the next CHAIN content words (no anchors)
form, with the anchor, a spot signature. Tables, lists and texts in other languages have hardly any
common words, so one word in HASHED, chosen by its hash, is an anchor as well, of the next CHAIN
words of any kind. (On the 0.01 tables 51 % of the anchors are common words.) The 32-bit hashes of the signatures, distinct and sorted, are the fingerprint, written in base64.
A text with fewer than FEW signatures also takes every chain of CHAIN + 1 words, or of all its
words if it has fewer. Equal texts have equal fingerprints.

Likeness is the Jaccard similarity of the sets. Two sets can only reach a likeness t if the
smaller has at least t times as many signatures as the larger: `alike` prunes a pair on its
lengths before it compares the sets, and `near_pairs` (the query spotsigs_classes) partitions texts by set length so that only equal and
neighbouring partitions meet. The contract of op10 asks for exact likenesses of stated pairs, which nothing can prune.

Null text is empty; empty texts have an empty fingerprint; two empty fingerprints have likeness 1,
an empty and another 0. Rows with a null id come before all others; rows that tie on the id are
ordered by text. An empty table gives an empty result. Extra columns are ignored.
"""

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize
from .common import WordHashes, bounded_batches, mix, parts_for, text_bytes
from .components import components
from .simhash import MOST_SENT, SET_COLUMNS, levels, packed, post_pairs, prefixes, set_name, verified

CHAIN, HASHED, FEW = 2, 4, 8
#: Common words of English, French, German and Spanish.
ANCHORS = frozenset(
    """the of and to in a is that it for on was be with as by this at are an from or not but have has
    le la les de des du un une et en que qui est pour dans par sur au aux ne pas il elle
    der die das und den von zu ist mit sich ein eine nicht auf dem des im für als auch
    el los las y del que en un una por con para se su al lo como más no es""".split()
)
ANCHOR_BYTES = frozenset(x.encode() for x in ANCHORS)
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EMPTY = np.empty(0, np.uint32)
#: 256 bits of a set, as columns: each signature turns one of them over.
BITMAP_COLUMNS = [f"b{i}" for i in range(4)]


def signatures(data: bytes | None, hashes: WordHashes) -> np.ndarray:
    """The distinct 32-bit spot signatures of a text, ascending."""
    words = (data or b"").lower().translate(None, PUNCTUATION).split()
    n = len(words)
    if not n:
        return EMPTY if not (data or b"").split() else np.array([hashes[data] >> 32], np.uint32)
    h = hashes.of(words)
    anchor = np.fromiter((w in ANCHOR_BYTES for w in words), bool, n)
    content, spots = np.flatnonzero(~anchor), np.flatnonzero(anchor)
    nth = np.searchsorted(content, spots)
    spots, nth = spots[nth + CHAIN <= len(content)], nth[nth + CHAIN <= len(content)]
    found = h[spots]
    for j in range(CHAIN):
        found = mix(found) + h[content[nth + j]]
    also = np.flatnonzero(h % np.uint64(HASHED) == 0)
    also = also[also + CHAIN < n]
    more = h[also] + np.uint64(1)
    for j in range(CHAIN):
        more = mix(more) + h[also + j + 1]
    out = np.unique((mix(np.concatenate([found, more])) >> np.uint64(32)).astype(np.uint32))
    if len(out) < FEW:
        size = min(CHAIN + 1, n)
        chain = h[: n - size + 1]
        for j in range(1, size):
            chain = mix(chain) + h[j : j + n - size + 1]
        out = np.union1d(out, (mix(chain + np.uint64(1)) >> np.uint64(32)).astype(np.uint32))
    return out


def alike(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity, or 0 if the lengths show, or the comparison, that it is under `least`."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    found = both / (small + large - both)
    return found if found >= least else 0.0


def bitmap(x: np.ndarray) -> np.ndarray:
    """256 bits of a set, each the parity of its signatures that fall on it."""
    with np.errstate(over="ignore"):
        at = (mix(x) % np.uint64(256)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=256) & 1).astype(np.uint8)).view(np.int64)


def may_be_alike(least: tuple[int, int]):
    """Whether two sets' bitmaps allow the likeness `least`, for verified(): a bit in which they differ needs a signature that only one set has,
    and alike sets have (q - p) / (p + q) of the sum of their sizes of those at most. So what it drops is never alike."""
    p, q = least

    def test(u, v):
        apart = sum((F.bit_count(u(b).bitwiseXOR(v(b))) for b in BITMAP_COLUMNS), F.lit(0))
        return (p + q) * apart <= (q - p) * (u("n") + v("n"))

    return test


def encoded(x: np.ndarray) -> str:
    return base64.b64encode(x.astype("<u4").tobytes()).decode()


def decoded(x: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(x or ""), "<u4")


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many characters from the start of the following text, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, bucket, own), dealt by ranges of doc_id and sorted so that each document follows the one that is next to it in descending order.

    The first document of a range needs the last of the range below (the very first: the very last).
    Those, one for each range, are dealt twice: own is 0 where a row only lends its text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"))
    parts = parts_for(text_bytes(docs), mb=16)  # bounded: the ranges' bounds and last ids are all that reaches the driver
    steps = [i / parts for i in range(1, parts)]
    bounds = np.array(sorted(set(ids.agg(F.percentile_approx("i", steps, max(10_000, 20 * parts)).alias("b")).first()["b"] or [])) if steps else [], np.int64)

    @F.pandas_udf("int")
    def bucket_of(i):
        return pd.Series(np.searchsorted(bounds, i.to_numpy(), side="left").astype(np.int32))

    # one id for each range reaches the driver: their number is a parameter of the layout, MOST_PARTS at most
    last = sorted((r.b, r.m) for r in ids.groupBy(bucket_of("i").alias("b")).agg(F.max("i").alias("m")).collect())
    order = {b: i for i, (b, _) in enumerate(last)}
    lends = [(m, (order[b] + 1) % len(last)) for b, m in last]
    ranges = F.broadcast(spark.createDataFrame(lends, "_i long, next_part int"))
    one = lambda part, own: F.struct(F.col(part).alias("bucket"), F.lit(own).alias("own"))
    parted = docs.withColumn("_i", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(ranges, "_i", "left")
    place = F.broadcast(spark.createDataFrame([(b, i) for b, i in order.items()], "_b int, own_part int"))
    numbered = parted.withColumn("_b", bucket_of("_i")).join(place, "_b")
    targets = F.filter(F.array(one("own_part", 1), F.when(F.col("next_part").isNotNull(), one("next_part", 0))), lambda t: t.isNotNull())
    dealt = numbered.select("doc_id", "text", F.explode(targets).alias("t")).select("doc_id", "text", "t.*")
    return dealt.repartitionById(max(1, len(last)), "bucket").sortWithinPartitions("bucket", "own", "doc_id", "text")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) for each document."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        hashes, before = WordHashes(), ("", EMPTY)
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = []
                for doc, body, _, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    mine = signatures(body.encode(), hashes)
                    if own:
                        other = edited(body, before[0])
                        theirs = signatures(other.encode(), hashes)
                        rows.append((doc, len(body), other, encoded(mine), encoded(theirs), alike(mine, theirs), alike(mine, before[1])))
                    before = (body, mine)
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return with_neighbours(docs, doc_id, text).mapInArrow(run, schema)


def near_pairs(docs: DataFrame, least: tuple[int, int] = (4, 5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) of documents whose fingerprints reach the likeness `least` (a fraction), in connected classes.

    Equal fingerprints are one point. Sets of likeness t share one of their first len - ceil(t * len) + 1 signatures in an order with rare ones first.
    A first round compares each set with the first one under each of these signatures, where their lengths and places allow it: that makes one class of most groups
    of near copies. A second joins the sets of different classes by signature and partition of set length (simhash.post_pairs: rows carry no sets, hot signatures are
    split), pruned by length and place. Of both, pairs go on only if their bitmaps allow the likeness (may_be_alike: exact, no link is lost), and then their sets are compared.

    Null, empty and blank texts have an empty fingerprint and are alike. Rows with a null id get their class's smallest id and never name one: a class of null
    ids alone has none. Repeated rows have equal results. Extra columns are ignored. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def sketch(batches):
        hashes = WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = [signatures(x, hashes).astype(np.uint64) << np.uint64(32) for x in batch.column(2).to_pylist()]
                names = np.array([set_name(x) for x in sets], np.int64).reshape(-1, 2)
                bits = np.array([bitmap(x) for x in sets], np.int64).reshape(-1, 4)
                columns = [batch.column(0), batch.column(1), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([len(x) for x in sets], pa.int64()), pa.array([packed(x) for x in sets], pa.binary()), *(pa.array(bits[:, i]) for i in range(4))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", *SET_COLUMNS, "n_shingles", "shingles", *BITMAP_COLUMNS])

    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary"))
    p, q = least
    schema = "row long, doc_id long, id0 long, id1 long, n_shingles long, shingles binary, " + ", ".join(f"{c} long" for c in BITMAP_COLUMNS)
    marked = materialize(base.mapInArrow(sketch, schema), "spots")
    named = materialize(marked.groupBy(*SET_COLUMNS).agg(F.min("row").alias("node")), "spot-points")
    firsts = marked.withColumnRenamed("row", "node").join(named.select("node"), "node", "left_semi")
    points, sets = firsts.select("node", "n_shingles", *BITMAP_COLUMNS), marked.select(F.col("row").alias("node"), "shingles")
    check = lambda pairs: verified(pairs, points, sets, least, BITMAP_COLUMNS, may_be_alike(least))
    posts = materialize(prefixes(firsts.select("node", F.col("node").alias("component"), "shingles"), levels(marked), least), "spot-posts")
    place = F.struct("node", "n", "at")
    lows = posts.groupBy("token").agg(F.min(place).alias("low"), F.max("node").alias("_hi")).where("low.node < _hi").select("token", "low.node", "low.n", "low.at").toDF("token", "v", "_n", "_at")
    held = materialize(posts.drop("component").join(lows, "token"), "spot-held")  # what no other set begins with is gone
    fits = (q * F.least("n", "_n") >= p * F.greatest("n", "_n")) & ((p + q) * F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at")) >= p * (F.col("n") + F.col("_n")))
    tried = materialize(held.where((F.col("node") > F.col("v")) & fits).select(F.col("node").alias("u"), "v").distinct(), "spot-tried")
    first = check(tried)
    linked = materialize(components(first), "spot-linked")
    known = held.select("token", "node", "n", "at").join(F.broadcast(linked) if linked.count() <= MOST_SENT else linked, "node", "left")
    paired = post_pairs(known.withColumn("component", F.coalesce("component", "node")), least, parted=True)
    second = check(paired.join(tried, ["u", "v"], "left_anti"))
    classes = named.join(components(first.unionByName(second)), "node", "left").select(*SET_COLUMNS, F.coalesce("component", "node").alias("component"))
    rows = materialize(marked.select("row", "doc_id", *SET_COLUMNS).join(classes, SET_COLUMNS).select("doc_id", "component"), "spot-classes")
    for used in (marked, named, posts, held, tried, first, linked, paired, second):
        discard(used)
    return rows.join(rows.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("doc_id", "component_id")


def spotsigs_classes(spark, sf_dir: str) -> DataFrame:
    """Classes of all documents by fingerprints of likeness 0.8 and more."""
    return near_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op10_spotsigs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprints(docs).select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
