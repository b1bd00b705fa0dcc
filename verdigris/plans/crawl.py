"""Queries over crawled responses and over records as JSON text. Each has its DuckDB SQL beside it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence
from ..sources import records
from ..tables import table
from .texts import _html


def _crawl(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Citations and responses of pages: each page stands behind page_id % 8 redirects, written as paths, as whole URLs and as relative ones.

    Some walks end in a circle, at a private address or at another scheme; some pages are missing, forbidden, too large or without a title.
    """
    n = F.pmod("page_id", F.lit(8))
    page = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?id="), F.col("page_id").cast("string"))
    pages = table(spark, sf_dir, "pages").select("page_id", "html", n.alias("hops"), page.alias("page"))
    hop = lambda k: F.concat(F.lit("https://GO.example.com:443/r/"), F.col("page_id").cast("string"), F.lit("/"), k.cast("string"))
    by = lambda m, r=0: F.pmod("page_id", F.lit(m)) == r
    k = F.col("k")
    onward = F.when(k % 3 == 0, hop(k + 1)).when(k % 3 == 1, F.concat(F.lit("../"), F.col("page_id").cast("string"), F.lit("/./"), (k + 1).cast("string"))).otherwise((k + 1).cast("string"))
    end = F.when(by(9), F.lit("0")).when(by(11), F.lit("//127.0.0.1/x")).when(by(13), F.lit("ftp://x.example/y")).otherwise(F.col("page"))
    moved = pages.where("hops > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hops") - 1)))
    none = F.lit(None)
    away = moved.select(hop(k).alias("url"), F.lit(302).alias("status_code"), F.when(k + 1 < F.col("hops"), onward).otherwise(end).alias("location"),
                        none.cast("string").alias("content_type"), none.cast("long").alias("content_length"), none.cast("string").alias("body"))
    code = F.when(by(10, 3), 404).when(by(10, 4), 403).when(by(10, 5), 402).otherwise(200)
    kind, size = F.when(by(6), "text/plain").otherwise("text/html; charset=utf-8"), F.when(by(19), 6_000_000).otherwise(100)
    there = pages.where(~by(17)).select(F.col("page").alias("url"), code.alias("status_code"), none.cast("string").alias("location"), kind.alias("content_type"), size.cast("long").alias("content_length"), F.col("html").alias("body"))
    cited = pages.select("page_id", F.when(by(23), "").when(F.col("hops") == 0, F.col("page")).otherwise(hop(F.lit(0))).alias("url"))
    return cited, away.unionByName(there)


def evidence_redirects(spark, sf_dir) -> DataFrame:
    cited, responses = _crawl(spark, sf_dir)
    found = evidence.resolve(cited, responses)
    return found.select("page_id", "status", F.col("http_status").cast("string").alias("http_status"), "resolved_url", F.size("redirect_chain").cast("long").alias("redirects"), "cycle", "title", "publisher", "sha256",
                        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("text_chars"), "error_code", "link_works", F.sha2("url_content", 256).alias("content_sha256"), "link_error")


#: Ways to break a submission, by doc_id % 9, with what is found: a change of its JSON text.
BREAKS = {
    1: ('"track":"short_fact"', '"track":"poem"', "$.track: not an allowed value"),
    2: ('"end":9}', '"end":-1}', "$.claims[0].source_span.end: out of range; $.claims[0]: source_span.end comes before source_span.start"),
    3: ('"citation_id":"s2"', '"citation_id":"s1"', "$: citations.citation_id is not unique; $: claims.citation_ids names no citations.citation_id: s2"),
    4: ('"citation_ids":["s1"', '"citation_ids":["s9"', "$: claims.citation_ids names no citations.citation_id: s9"),
    5: ('{"schema_version"', '{"extra":1,"schema_version"', "$: unknown field extra"),
    6: ('"run_id":"r"', '"run_id":12', "$.run_id: not a string"),
    7: ('"case_id":"c",', "", "$.case_id: missing"),
    8: ('"sections":', '"sections"', "$: not JSON"),
}


def record_validation(spark, sf_dir) -> DataFrame:
    """Documents as submissions with claims and citations, eight of nine broken in one way each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lit, none, digest = F.lit, F.lit(None).cast("string"), F.concat(F.lit("sha256:"), F.sha2("text", 256))
    claim = lambda name, *cited: F.struct(lit(name).alias("claim_id"), lit("some claim").alias("text"), F.struct(lit(0).alias("start"), lit(9).alias("end")).alias("source_span"), lit("major").alias("importance"),
                                          lit("opinion").alias("verifiability"), F.array(*map(lit, cited)).alias("citation_ids"))
    cited = lambda name: F.struct(lit(name).alias("citation_id"), *[none.alias(x) for x in ("display_text", "visible_url", "resolved_url", "quoted_text")], F.array(lit("k1")).alias("claim_ids"), lit("resolved").alias("collection_status"))
    whole = F.struct(
        lit("verdigris.research_submission.v1").alias("schema_version"), lit("r").alias("run_id"), lit("c").alias("case_id"), lit("a").alias("attempt_id"), F.col("doc_id").cast("string").alias("task_id"), lit("short_fact").alias("track"),
        F.col("text").alias("final_answer"), F.array(F.struct(lit("x").alias("section_id"), none.alias("heading"), F.col("text").alias("text"))).alias("sections"),
        F.array(claim("k1", "s1", "s2"), claim("k2")).alias("claims"), F.array(cited("s1"), cited("s2")).alias("citations"), F.array().cast("array<string>").alias("attachments"),
        F.struct(lit("n").alias("normalizer_id"), lit("1").alias("normalizer_version"), digest.alias("source_artifact_sha256"), lit("collected").alias("citation_collection_status")).alias("normalization"),
    )
    line = F.to_json(whole, {"ignoreNullFields": "false"})
    # the first claim alone is changed: each pattern stands there first
    changed = line
    for k, (old, new, _) in BREAKS.items():
        at = F.locate(old, line)
        changed = F.when(F.pmod("doc_id", lit(9)) == k, F.overlay(line, lit(new), at, lit(len(old)))).otherwise(changed)
    lines = docs.select("doc_id", changed.alias("line"))
    found = records.with_faults(lines, "line", records.RECORDS["research_submission"])
    return found.select("doc_id", F.array_join("faults", "; ").alias("faults"))


QUERIES = {"evidence_redirects": evidence_redirects, "record_validation": record_validation}

ORACLES = {
    "record_validation": "SELECT doc_id, CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN '{why}'" for k, (_, _, why) in BREAKS.items()) + " ELSE '' END AS faults FROM documents",
    "evidence_redirects": f"""
WITH RECURSIVE p AS (
  SELECT page_id, html, page_id % 8 AS hops, regexp_replace(url, '[?#].*$', '') || '?id=' || page_id AS page, page_id % 9 = 0 AS circle FROM pages
), e AS (
  SELECT page_id, k, CASE WHEN k + 1 < hops THEN CAST(k + 1 AS VARCHAR) WHEN circle THEN '0' WHEN page_id % 11 = 0 THEN 'private' WHEN page_id % 13 = 0 THEN 'scheme' ELSE 'page' END AS onward
  FROM (SELECT *, unnest(range(hops)) AS k FROM p)
), w(page_id, n, here, seen) AS (
  SELECT page_id, 0, CASE WHEN hops = 0 THEN 'page' ELSE '0' END, CAST([] AS VARCHAR[]) FROM p
  UNION ALL
  SELECT w.page_id, n + 1, onward, list_append(seen, here) FROM w JOIN e ON w.page_id = e.page_id AND w.here = CAST(e.k AS VARCHAR) WHERE n <= 5 AND NOT list_contains(seen, here)
), l AS (
  SELECT page_id, arg_max(n, n) AS n, arg_max(here, n) AS here, arg_max(list_contains(seen, here), n) AS cycle FROM w GROUP BY page_id
), r AS (
  SELECT p.*, l.n, coalesce(l.cycle, false) AND page_id % 23 <> 0 AS cycle,
    CASE WHEN page_id % 23 = 0 THEN 'EVIDENCE_URL_MISSING' WHEN here = 'private' AND n <= 6 THEN 'EVIDENCE_PRIVATE_HOST' WHEN here = 'scheme' AND n <= 6 THEN 'EVIDENCE_UNSAFE_SCHEME'
      WHEN cycle OR n > 5 THEN 'EVIDENCE_TOO_MANY_REDIRECTS' WHEN page_id % 17 = 0 THEN 'EVIDENCE_UNREACHABLE' WHEN page_id % 19 = 0 THEN 'EVIDENCE_TOO_LARGE' END AS error_code,
    CASE page_id % 10 WHEN 3 THEN 404 WHEN 4 THEN 403 WHEN 5 THEN 402 ELSE 200 END AS code, page_id % 6 <> 0 AS is_html
  FROM p JOIN l USING (page_id)
), t AS (SELECT *, CASE WHEN is_html THEN {_html("html")} ELSE html END AS body FROM r),
s AS (
  SELECT *, CASE WHEN error_code IS NOT NULL THEN 'error' WHEN code = 402 OR regexp_matches(substr(body, 1, 20000), '(?i)paywall|subscribe to continue') THEN 'paywalled'
    WHEN code = 403 THEN 'blocked' WHEN code = 404 THEN 'not_found' ELSE 'fetched' END AS status, error_code IS NULL AND code < 400 AS works FROM t
)
SELECT page_id, status, CASE WHEN error_code IS NULL THEN CAST(code AS VARCHAR) END AS http_status, CASE WHEN error_code IS NULL THEN page END AS resolved_url,
  CASE WHEN error_code IS NULL THEN hops ELSE 0 END AS redirects, cycle,
  CASE WHEN error_code IS NULL AND is_html THEN trim(regexp_replace(regexp_extract_all(html, '(?is)<title[^>]*>(.*?)</title>', 1)[1], '\\s+', ' ', 'g')) END AS title,
  CASE WHEN error_code IS NULL THEN lower(regexp_extract(page, '^[a-z]+://([^/?#]+)', 1)) END AS publisher, CASE WHEN error_code IS NULL THEN 'sha256:' || sha256(body) END AS sha256,
  CASE WHEN status = 'fetched' THEN length(body) ELSE 0 END AS text_chars, error_code, CAST(works AS INT) AS link_works,
  sha256(CASE WHEN works THEN substr(html, 1, 5000) ELSE '' END) AS content_sha256, CASE WHEN error_code IS NOT NULL THEN error_code WHEN NOT works THEN 'http_' || code END AS link_error
FROM s"""
}
