"""WARC derivatives: responses become linked metadata and plain-text conversion records, in DataFrame operations only.

`responses` makes response records of fetched pages: an id, the HTTP headers and the payload. `derive`
turns each response into two records that refer to it:

  metadata    (application/warc-fields) title, language, number of links, the source's HTTP headers and digests
  conversion  (text/plain) the visible text

Both keep WARC-Refers-To (the response's record id), its target URI and date, and the digest of the
source payload; each has a digest of its own block. A response's id is derived from its page, URL, date and payload digest, so
two captures of one URL differ; the derived ids from it and the record type. So a task that runs again writes the same ids. `serialize` makes the record as
it stands in a file, and `write_warc` and `read_warc` are sink and source: Spark's text files
with the record separator as the line separator, so every task writes its own part and commits it.

One scan, no shuffle. Null html is an empty payload; null URLs give an empty target. Repeated rows
give repeated records. An empty table gives an empty result. Extra columns are ignored.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages carry no date of their own: the date of the crawl is a parameter.
DATE = "2024-01-01T00:00:00Z"
VERSION, CRLF = "WARC/1.1", "\r\n"
#: Tags that end a line of text.
BREAKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
#: Named entities, in the order they are resolved; the ampersand comes last, so that no entity is resolved twice.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def record_id(*parts: Column) -> Column:
    """A name-based uuid: the same parts give the same id."""
    h = F.md5(F.concat_ws("\x1f", *parts))
    cuts = [F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record_id, target_uri, date, http_headers, payload, payload_digest) of pages (page_id, url, html)."""
    payload, uri = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    headers = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(payload).cast("string"), F.lit(CRLF),
    )
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri, F.lit(date), digest(payload)).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("http_headers"),
        payload.alias("payload"),
        digest(payload).alias("payload_digest"),
    )


def plain_text(html: Column) -> Column:
    """Scripts, styles and comments go, block tags end lines, other tags go, entities are resolved once, white space is collapsed."""
    x = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    x = F.regexp_replace(x, rf"(?i)</?({BREAKS})(\s[^>]*)?/?>", "\n")
    x = F.regexp_replace(x, r"<[!/a-zA-Z][^>]*>", "")
    for name, char in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    x = F.regexp_replace(x, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(x, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def derive(source: DataFrame) -> DataFrame:
    """Two rows for each response: page_id, warc_type, record_id, refers_to, target_uri, date, content_type, source_digest, block, block_digest."""
    title = F.regexp_replace(F.trim(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1)), r"\s+", " ")
    language = F.regexp_extract("payload", r"(?i)<html[^>]*\slang=\"([^\"]*)\"", 1)
    links = F.regexp_count("payload", F.lit(r"(?i)<a\s[^>]*href="))
    fields = F.concat(
        F.lit("title: "), title, F.lit(CRLF + "language: "), language, F.lit(CRLF + "outlinks: "), links.cast("string"),
        F.lit(CRLF + "source-payload-digest: "), F.col("payload_digest"),
        F.lit(CRLF + "source-headers: "), F.replace(F.rtrim(F.replace("http_headers", F.lit(CRLF), F.lit("\n")), F.lit("\n")), F.lit("\n"), F.lit(CRLF + " ")), F.lit(CRLF),
    )
    one = lambda kind, content, block: F.struct(F.lit(kind).alias("warc_type"), F.lit(content).alias("content_type"), block.alias("block"))
    both = F.explode(F.array(one("metadata", "application/warc-fields", fields), one("conversion", "text/plain; charset=utf-8", plain_text(F.col("payload")))))
    return (
        source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("payload_digest").alias("source_digest"), both.alias("r"))
        .select("page_id", "r.*", "refers_to", "target_uri", "date", "source_digest")
        .withColumn("record_id", record_id(F.col("warc_type"), F.col("refers_to")))
        .withColumn("block_digest", digest(F.col("block")))
    )


def serialize(records: DataFrame) -> DataFrame:
    """records with `record`: header and block as in a file, up to the last line break, which the sink adds. Line breaks in a URL are percent-encoded."""
    one_line = lambda x: F.replace(F.replace(x, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), one_line(value), F.lit(CRLF))
    record = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Refers-To-Target-URI", F.col("target_uri")), line("WARC-Refers-To-Date", F.col("date")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Source-Payload-Digest", F.col("source_digest")),
        line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF), F.col("block"), F.lit(CRLF),
    )
    return records.withColumn("record", record)


def write_warc(records: DataFrame, path: str, **options) -> None:
    """Write derived records as WARC files, one for each task."""
    serialize(records).select("record").write.options(lineSep=CRLF, **options).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(warc_type, headers map, block) of the records in WARC files of UTF-8 text.

    Files are cut at the version line; a block that holds a version line itself is not supported by this
    source, and its record fails the length check: `whole` is false where the length doesn't agree.
    """
    raw = spark.read.option("lineSep", VERSION + CRLF).text(path).where(F.length("value") > 0)
    head = F.substring_index("value", CRLF + CRLF, 1)
    # map entries: "name: value" lines; a value may hold further colons
    pairs = F.transform(F.split(head, CRLF), lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.substr(x, F.length(F.substring_index(x, ": ", 1)) + 3).alias("v")))
    rest = F.substr("value", F.length(head) + 5)
    out = raw.select(F.map_from_entries(pairs).alias("headers"), F.substr(rest, F.lit(1), F.length(rest) - 4).alias("block"))
    whole = F.octet_length("block") == F.col("headers")["Content-Length"].cast("long")
    return out.select(F.col("headers")["WARC-Type"].alias("warc_type"), "headers", "block", whole.alias("whole"))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return derive(responses(pages)).select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "source_digest", "block_digest",
        F.length("block").cast("long").alias("block_chars"),
    )


def _sql_uuid(x: str) -> str:
    return f"'<urn:uuid:' || substr({x}, 1, 8) || '-' || substr({x}, 9, 4) || '-' || substr({x}, 13, 4) || '-' || substr({x}, 17, 4) || '-' || substr({x}, 21, 12) || '>'"


def _sql_text(x: str) -> str:
    x = f"regexp_replace({x}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '', 'g')"
    x = f"regexp_replace({x}, '(?i)</?({BREAKS})(\\s[^>]*)?/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[!/a-zA-Z][^>]*>', '', 'g')"
    for name, char in ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    x = f"regexp_replace({x}, '[ \\t\\r\\f]+', ' ', 'g')"
    return f"trim(regexp_replace({x}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


OP4_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
i AS (SELECT *, md5(concat_ws(chr(31), 'response', coalesce(CAST(page_id AS VARCHAR), ''), target_uri, '{DATE}', 'sha256:' || sha256(payload))) AS h FROM p),
r AS (
  SELECT *, {_sql_uuid("h")} AS refers_to, 'sha256:' || sha256(payload) AS source_digest, chr(13) || chr(10) AS nl FROM i
), b AS (
  SELECT page_id, target_uri, refers_to, source_digest, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    'title: ' || regexp_replace(trim(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1)), '\s+', ' ', 'g')
    || nl || 'language: ' || regexp_extract(payload, '(?i)<html[^>]*\slang="([^"]*)"', 1)
    || nl || 'outlinks: ' || len(regexp_extract_all(payload, '(?i)<a\s[^>]*href=')) || nl || 'source-payload-digest: ' || source_digest
    || nl || 'source-headers: HTTP/1.1 200 OK' || nl || ' Content-Type: text/html; charset=utf-8' || nl || ' Content-Length: '
    || strlen(payload) || nl AS block FROM r
  UNION ALL
  SELECT page_id, target_uri, refers_to, source_digest, 'conversion', 'text/plain; charset=utf-8', {_sql_text("payload")} FROM r
), k AS (SELECT *, md5(concat_ws(chr(31), warc_type, refers_to)) AS h FROM b)
SELECT page_id, warc_type, {_sql_uuid("h")} AS record_id, refers_to, target_uri, content_type, source_digest,
  'sha256:' || sha256(block) AS block_digest, length(block) AS block_chars FROM k
"""
