"""URL filters: host and path rules, then a blocked Bloom filter before an exact join, in DataFrame operations only.

Rules decide first: of those that fit a URL (its host or a parent domain, a prefix of its path)
the longest wins. URLs that no rule decides are looked up in a list by canonical form. A
blocked Bloom filter of the list (one 256-bit block for each URL, eight bits in it) settles nearly all that aren't
listed without moving them. Up to MOST_BLOCKS rows of five longs (under 6 MB) it is broadcast; a longer list has more
blocks, so the filter stays as sparse, and they are joined by a shuffle on the block. What passes is a possible hit and goes through an exact
hash join with the list, which removes the false positives.

Canonical form: no scheme, host in lower case without `www.` or `m.`, no port, no fragment, no
tracking parameters (utm_*, ref), no `/` at the end of the path.

Null URLs and those without `://` have an empty host and path, no canonical form, and are allowed.
Repeated rows get equal verdicts. An empty list blocks nothing. Other columns pass through; those
named like an output are replaced.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 2^17 blocks of 32 bytes: at 16 bits for each URL the filter is sparse up to 2 million URLs.
MOST_BLOCKS, URLS_PER_BLOCK, BITS_PER_URL = 1 << 17, 16, 8

#: Fixed values of the query: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Hosts whose pages make up the query's list.
LISTED_HOSTS = r"^(.*\.)?spam-farm\."


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(None).cast("string"))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Null where there is no `://`."""
    rest = after_scheme(url)
    name = F.regexp_replace(F.regexp_replace(host(url), r"^(www|m)\.", ""), r":[0-9]*$", "")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)")), "&")
    where = F.concat(name, F.regexp_replace(path(url), r"/+$", ""))
    return F.when(rest.isNull(), None).otherwise(F.when(kept != "", F.concat(where, F.lit("?"), kept)).otherwise(where))


def rule_of(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null. The rules are a parameter, so their number is the caller's."""
    fitting = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        fitting = F.when(fits, found) if fitting is None else fitting.when(fits, found)
    return fitting if fitting is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def masks(url: str, n_blocks: Column) -> tuple[Column, list[Column]]:
    """The block of a canonical URL, and its bits in the block's four longs."""
    place, bits = F.xxhash64(url), F.xxhash64(url, F.lit(1))
    words = []
    for w in range(4):
        one = [F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(xxhash64({url}, 1), {6 * (2 * w + j)}) & 63 AS INT))") for j in range(2)]
        words.append(one[0].bitwiseOR(one[1]))
    return F.pmod(place, n_blocks), words


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w3) of the canonical URLs in column `canonical`."""
    block, words = masks("canonical", F.lit(n_blocks))
    bits = listed.select(block.alias("block"), *[x.alias(f"w{i}") for i, x in enumerate(words)])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def blocks_for(n: int) -> int:
    return 1 << (n // URLS_PER_BLOCK).bit_length()


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; listed has the canonical URLs to block in column `canonical`."""
    pages = pages.select([c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "canonical")])
    listed = materialize(listed.select("canonical").where("canonical is not null").distinct(), "listed")  # derived once
    n_blocks = blocks_for(listed.count())
    sieve = bloom(listed, n_blocks)
    split = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url)), "canonical": canonical(F.col(url))})
    ruled = split.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    block, words = masks("canonical", F.lit(n_blocks))
    probe = ruled.withColumn("_block", F.when(F.col("_rule").isNull(), block))
    met = probe.join(F.broadcast(sieve) if n_blocks <= MOST_BLOCKS else sieve, F.col("_block") == F.col("block"), "left")
    in_all = F.lit(True)
    for i, x in enumerate(words):
        in_all = in_all & (F.col(f"w{i}").bitwiseAND(x) == x)
    met = met.withColumn("_possible", F.coalesce(F.col("_block").isNotNull() & in_all, F.lit(False))).drop("block", "_block", "w0", "w1", "w2", "w3")
    exact = met.where("_possible").join(listed.withColumn("_listed", F.lit(True)), "canonical", "left")
    rest = met.where("not _possible").withColumn("_listed", F.lit(None).cast("boolean"))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_listed"), "block").otherwise("allow"))
    return exact.unionByName(rest).select(*pages.columns, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "canonical")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    canon = canonical(F.col("url"))
    elsewhere = F.concat(canon, F.lit("/gone"))  # as many that are on no page
    listed = pages.select(F.explode(F.array(F.when(host(F.col("url")).rlike(LISTED_HOSTS), canon), elsewhere)).alias("canonical"))
    return judge(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT *, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    array_to_string(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)')), '&') AS kept
  FROM p
), c AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':[0-9]*$', '')
    || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM h
), listed AS (
  SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '^(.*\.)?spam-farm\.') UNION SELECT canonical || '/gone' FROM c
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM c
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
