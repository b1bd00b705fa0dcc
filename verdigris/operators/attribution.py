"""Attribution of report sentences to their sources, from Markdown.

Which citation marks count where marks overlap goes by precedence and place; that alone is a row helper (`marks`).
Paragraphs, sentences, the numbering of sources, labels and the sharing of
sources backwards are DataFrame operations, all partitioned by report.
"""

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import bounded_batches

#: Citation markup, in the order of precedence.
REFERENCE = r"^\[([^\]]+)\]:\s*(<[^>\s]+>|\S+)"
INLINE = r"""(!?)\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)"""
AUTOLINK = r"<(https?://[^>\s]+)>"
SPAN = r"\[(\d+)\s*-\s*(\d+)\]"
NUMBER = r"\[(\d+)\]"
FOOTNOTE = r"\[\^([^\]]+)\]"
#: The mark of fenced code, the end of a paragraph, and what stands between two sentences.
FENCE = r"(?:`{3,}|~{3,})"
PARAGRAPH_END = r"\n\s*\n"
SENTENCE_GAP = r"(?:(?<=[.!?])|(?<=\]))\s+(?=[A-Z0-9\"“'(\[])"
WIDEST_SPAN = 50

MARKS = [(kind, re.compile(p, re.M)) for kind, p in (("definition", REFERENCE), ("inline", INLINE), ("autolink", AUTOLINK), ("span", SPAN), ("number", NUMBER), ("footnote", FOOTNOTE))]
MARK_SCHEMA = "key string, kind string, place int, labels array<string>, url string"


def body(markdown: Column) -> Column:
    """The text that counts: line ends as \\n, no blanks at line ends, no fenced code. A fence is closed by the same character, or never."""
    x = F.regexp_replace(F.coalesce(markdown, F.lit("")), r"\r\n?", "\n")
    x = F.regexp_replace(x, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    x = F.concat(F.regexp_replace(x, r"(?U)\A\s+|\s+\z", ""), F.lit("\n"))
    closed = "|".join(rf"^ {{0,3}}{c}{{3,}}[^\n]*\n(?:.*?\n)?? {{0,3}}{c}{{3,}}[^\n]*(?:\n|\z)" for c in "`~")
    return F.regexp_replace(F.regexp_replace(x, f"(?dms){closed}", ""), rf"(?dms)(?:\A|\n) {{0,3}}{FENCE}.*\z", "")


def web_url(x: str) -> str | None:
    """The URL without brackets, closing punctuation and fragment, if it is one of the web."""
    x = x.strip().strip("<>").strip(".,);").partition("#")[0]
    return x if re.match(r"(?i)https?://[^/?#]", x) else None


def numbers(a: int, b: int) -> list[str]:
    a, b = min(a, b), max(a, b)
    return [str(a), str(b)] if b - a > WIDEST_SPAN else [str(i) for i in range(a, b + 1)]


def read_mark(kind: str, m: re.Match) -> tuple[list[str], str | None]:
    """Labels and URL of one mark; no labels where it names nothing."""
    match kind:
        case "definition":
            return [m[1].strip()], web_url(m[2])
        case "inline":
            url = None if m[1] else web_url(m[3])
            return [m[2].strip() or url] if url else [], url
        case "autolink":
            url = web_url(m[1])
            return [url] if url else [], url
        case "span":
            return numbers(int(m[1]), int(m[2])), None
    return [m[1]], None


def marks(text: str) -> list[tuple[str, int, list[str], str | None]]:
    """(kind, place, labels, url) of the marks that count, by place.

    All candidates are tried in the order of precedence, then place. One that overlaps a mark taken before
    is dropped; definitions and images take their place even so, and an image names nothing.
    """
    taken, found = bytearray(len(text)), []
    for kind, pattern in MARKS:
        for m in pattern.finditer(text):
            labels, url = read_mark(kind, m)
            image = kind == "inline" and bool(m[1])
            if kind != "definition" and not image and (not labels or 1 in taken[m.start() : m.end()]):
                continue
            taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
            if not image and not (kind == "definition" and url is None):
                found.append((kind, m.start(), labels, url))
    return sorted(found, key=lambda x: x[1])


def mark_rows(bodies: DataFrame) -> DataFrame:
    """MARK_SCHEMA rows of (key, body)."""
    bounded_batches(bodies.sparkSession)
    names = [x.split()[0] for x in MARK_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [(k, *r) for k, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True) for r in marks(text)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return bodies.select("key", "body").mapInArrow(run, MARK_SCHEMA)


def parts(rows: DataFrame, text: str, gap: str, at: str, out: str, window: list[str]) -> DataFrame:
    """A row for each part of `text` between gaps, with its number, start and stop (offsets from `at`); blank parts are left out."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s){gap}|.+?(?={gap}|\z)"), F.lit(0))  # gaps too, so that lengths add up to offsets
    before = Window.partitionBy(*window).orderBy(f"{out}_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col(at) + F.coalesce(F.sum(F.length(out)).over(before), F.lit(0)).cast("int")
    each = rows.select("*", F.posexplode(pieces).alias(f"{out}_no", out)).withColumn(f"{out}_start", start)
    return each.withColumn(f"{out}_stop", F.col(f"{out}_start") + F.length(out)).where(F.col(out).rlike(r"(?U)\S"))


def without_markup(x: Column) -> Column:
    """The sentence without its marks; a link leaves its text, an image nothing."""
    link = INLINE.removeprefix("(!?)")
    x = F.regexp_replace(x, f"!{link}|{link}", "$3")
    for pattern in (AUTOLINK, SPAN, NUMBER, FOOTNOTE):
        x = F.regexp_replace(x, pattern, "")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def sources(found: DataFrame) -> DataFrame:
    """(key, url, label, number, seen): each label of each source; sources are numbered, and labels ordered, as they are first seen.

    Seen first are definitions (of one label the last holds, at the place of the first), then links that give a
    label its first source, inline ones before bare ones, then all other links.
    """
    by_label = Window.partitionBy("key", "label")
    named = found.where("url is not null").withColumn("label", F.get("labels", F.lit(0)))
    defined = F.max((F.col("kind") == "definition").cast("int")).over(by_label) == 1
    rank = F.when(F.col("kind") == "definition", 0).when(F.col("kind") == "inline", 1).otherwise(2)
    new = F.row_number().over(by_label.orderBy("rank", "place")) == 1
    ranked = named.withColumn("rank", rank).withColumn("defined", defined).withColumn("new", new)
    definitions = ranked.where("rank = 0").groupBy("key", "label").agg(F.max_by("url", "place").alias("url"), F.struct(F.lit(0).alias("rank"), F.min("place").alias("place")).alias("seen"))
    order = F.struct(F.when(F.col("new") & ~F.col("defined"), F.col("rank")).otherwise(3).alias("rank"), "place")
    links = ranked.where("rank > 0").select("key", "label", "url", order.alias("seen"))
    once = definitions.unionByName(links).groupBy("key", "url", "label").agg(F.min("seen").alias("seen"))
    first = once.withColumn("first", F.min("seen").over(Window.partitionBy("key", "url")))
    return first.withColumn("number", F.dense_rank().over(Window.partitionBy("key").orderBy("first"))).drop("first")


def resolved(found: DataFrame, known: DataFrame) -> DataFrame:
    """(key, place, nth, label, number): what each link and each label of the other marks means; number is null where nothing does.

    A label means the source that the last link before it gives, else the last link of all, else its definition.
    """
    uses = found.where("kind != 'definition'").select("key", "place", "url", F.posexplode("labels").alias("nth", "label"))
    by_label = Window.partitionBy("key", "label").orderBy("place", "nth")
    before = F.last("url", ignorenulls=True).over(by_label.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    of_all = F.last("url", ignorenulls=True).over(by_label.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    defined = found.where("kind = 'definition'").groupBy("key", F.get("labels", F.lit(0)).alias("label")).agg(F.max_by("url", "place").alias("_defined"))
    named = uses.withColumn("_linked", F.coalesce("url", before, of_all)).join(defined, ["key", "label"], "left").withColumn("url", F.coalesce("_linked", "_defined"))
    return named.join(known.select("key", "url", "number").distinct(), ["key", "url"], "left").select("key", "place", "nth", "label", "number")


def attributions(reports: DataFrame, key: str, markdown: str) -> DataFrame:
    """Rows (key, kind, position, text, span_start, span_end, citation_ids, url, labels) of each report: its sources (citation),
    its sentences with what they cite (attribution), and its labels without a source (note).

    Null and empty reports give no rows. Reports with equal keys are read as one key's; extra columns are ignored.
    """
    bodies = reports.select(F.col(key).cast("string").alias("key"), body(F.col(markdown)).alias("body"))
    found = mark_rows(bodies)
    known = sources(found)
    name = lambda n: F.concat(F.lit("c"), n.cast("string"))
    nothing = lambda kind: F.lit(None).cast(kind)

    paragraphs = parts(bodies.withColumn("zero", F.lit(0)), "body", PARAGRAPH_END, "zero", "paragraph", ["key"])
    sentences = parts(paragraphs.select("key", "paragraph_no", "paragraph_start", "paragraph"), "paragraph", SENTENCE_GAP, "paragraph_start", "sentence", ["key", "paragraph_no"])
    sentences = sentences.select("key", "paragraph_no", F.col("sentence_start").alias("place"), "sentence_stop", "sentence")
    uses = resolved(found, known)
    both = sentences.withColumn("nth", F.lit(-1)).unionByName(uses, allowMissingColumns=True)
    so_far = Window.partitionBy("key").orderBy("place", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("start", F.last(F.when(F.col("nth") < 0, F.col("place")), ignorenulls=True).over(so_far))
    cited = F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("place", "nth", "number"))))
    first_of = lambda c: F.first(F.when(F.col("nth") < 0, F.col(c)), ignorenulls=True).alias(c)
    by_sentence = inside.groupBy("key", "start").agg(first_of("paragraph_no"), first_of("sentence_stop"), first_of("sentence"), F.array_distinct(F.transform(cited, lambda x: name(x["number"]))).alias("cited"))
    shared = by_sentence.withColumn("citation_ids", backward(F.when(F.size("cited") > 0, F.col("cited")), ["key", "paragraph_no"], ["start"])).where("citation_ids is not null")
    at = lambda *order: F.row_number().over(Window.partitionBy("key").orderBy(*order)).alias("position")
    attributed = shared.select("key", F.lit("attribution").alias("kind"), at("start"), without_markup(F.col("sentence")).alias("text"), F.col("start").alias("span_start"), F.col("sentence_stop").alias("span_end"), "citation_ids", nothing("string").alias("url"), nothing("array<string>").alias("labels"))
    of_source = known.groupBy("key", "number", "url").agg(F.array_sort(F.collect_list(F.struct("seen", "label"))).alias("_labels"))
    cited_rows = of_source.select("key", F.lit("citation").alias("kind"), F.col("number").alias("position"), nothing("string").alias("text"), nothing("int").alias("span_start"), nothing("int").alias("span_end"), F.array(name(F.col("number"))).alias("citation_ids"), "url", F.transform("_labels", lambda x: x["label"]).alias("labels"))
    notes = uses.where("number is null").select("key", F.lit("note").alias("kind"), at("place", "nth"), F.concat(F.lit("unresolved_citation_label:"), "label").alias("text"), *[nothing(k).alias(c) for c, k in (("span_start", "int"), ("span_end", "int"), ("citation_ids", "array<string>"), ("url", "string"), ("labels", "array<string>"))])
    return cited_rows.unionByName(attributed).unionByName(notes)


def pairs(parsed: DataFrame, fetched: DataFrame, relevance: Column | None = None, support: Column | None = None) -> DataFrame:
    """One row for each attribution and source: link_works, and the two judged dimensions where the link works.

    fetched: url, link_works. relevance and support see the columns text and url; without a judge they are null.
    """
    at = parsed.where("kind = 'attribution'").select("key", F.col("position").alias("attribution"), "text", F.explode("citation_ids").alias("citation_id"))
    named = parsed.where("kind = 'citation'").select("key", F.get("citation_ids", F.lit(0)).alias("citation_id"), "url")
    joined = at.join(named, ["key", "citation_id"]).join(fetched, "url", "left").withColumn("link_works", F.coalesce("link_works", F.lit(0)))
    judged = lambda c: F.when(F.col("link_works") == 1, c if c is not None else F.lit(None)).cast("int")
    return joined.select("key", "attribution", "citation_id", "url", "text", "link_works", judged(relevance).alias("relevant"), judged(support).alias("supported"))


def rates(pair_rows: DataFrame, key: str = "key") -> DataFrame:
    """Null-skipping rates of the three dimensions; they are never mixed."""
    return pair_rows.groupBy(key).agg(*[F.avg(c).alias(f"{c}_rate") for c in ("link_works", "relevant", "supported")], F.count(F.lit(1)).alias("pairs"))


def backward(value: Column | str, group: list[str], order: list[str]) -> Column:
    """The next value that isn't null at or behind each row of its group."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(0, Window.unboundedFollowing))
