"""Queries over texts and pages. Each has its DuckDB SQL beside it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cipher, urls, verdicts
from ..functions import text as t
from ..operators import attribution, citations, judging, leaks
from ..session import bounded_batches
from ..tables import table

SPACE, LOWER = t.SPACE, "abcdefghijklmnopqrstuvwxyz"


def answer_normalize_match(spark, sf_dir) -> DataFrame:
    """Answers with blanks and a closing mark against their upper-case references."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("head"))
    answer, reference = F.concat(F.lit(" "), "head", F.lit(" 。")), F.translate(F.replace("head", F.lit(" "), F.lit("　")), LOWER, LOWER.upper())
    bounded_batches(spark)
    found = docs.select("doc_id", t.normalize_answer(answer).alias("normalized"), t.normalize_answer(reference).alias("reference"))
    return found.select("doc_id", "normalized", (F.col("normalized") == F.col("reference")).alias("equal"))


def last_marked_answer(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("最终答案： first\n"), "text", F.lit("\n最终答案:\n "), F.substring("text", 1, 20), F.lit(" \nExact answer: x")).alias("x"))
    return rows.select("conv_id", "turn", t.last_marked_answer(F.col("x")).alias("last_answer"), t.first_marked_answer(F.col("x")).alias("first_answer"))


def page_text(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit(" \t"), F.replace("text", F.lit(". "), F.lit(". \r\n\n\n\n ")), F.lit("\n复制\n")).alias("x"), "role")
    clean = t.page_text(F.col("x"))
    answer = t.fallback_answer(F.col("x"), F.col("role"), F.substring("x", 1, 10))
    return rows.select("conv_id", "turn", F.sha2(clean, 256).alias("clean_sha256"), F.length(clean).cast("long").alias("clean_chars"), F.length(answer).cast("long").alias("answer_chars"))


def path_segments(spark, sf_dir) -> DataFrame:
    bounded_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", t.path_segment(F.col("url")).alias("unicode_segment"), t.safe_segment(F.concat(F.lit(".."), "url")).alias("safe_segment"), t.pad_id(F.col("page_id")).alias("padded"), t.pad_id(F.col("url"), sanitize=True).alias("sanitized"))


def claim_extract(spark, sf_dir) -> DataFrame:
    rows = citations.claims(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "piece", F.sha2("text", 256).alias("claim_sha256"), "importance", "verifiability")
    return rows


def claim_citation_map(spark, sf_dir) -> DataFrame:
    """Markers put behind the line breaks of documents, resolved against three citations."""
    marked = F.concat(F.replace("text", F.lit("\n"), F.lit("[2]【9】[1]\n")), F.lit(" [0][3][3]"))
    docs = table(spark, sf_dir, "documents").select("doc_id", marked.alias("answer"), F.array(F.lit("c1"), F.lit("c2"), F.lit("c3")).alias("cited"))
    rows = citations.claims(docs, "doc_id", "answer", "cited")
    return rows.select("doc_id", "piece", F.array_join("citation_ids", ",").alias("citation_ids"))


def html_to_text(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    body = t.html_text(F.col("html"))
    return pages.select("page_id", F.sha2(body, 256).alias("text_sha256"), F.length(body).cast("long").alias("text_chars"), t.html_title(F.col("html")).alias("title"))


def page_metadata(spark, sf_dir) -> DataFrame:
    """Publication dates put into pages by their number."""
    dated = F.concat(F.lit('<meta property="article:published_time" content="2024-0'), (F.pmod("page_id", F.lit(9)) + 1).cast("string"), F.lit('-01">'), "html")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.pmod("page_id", F.lit(3)) > 0, dated).otherwise(F.col("html")).alias("html"))
    return pages.select("page_id", t.html_published(F.col("html")).alias("published_at"), urls.publisher(F.col("url")).alias("publisher"))


HOSTS = ["127.0.0.1", "172.16.0.9", "172.15.0.1", "224.0.0.1", "8.8.8.8", "localhost", "a.localhost", "www.nih.gov", "data.gov.uk", "who.int", "de.wikipedia.org", "medium.com"]


def _on_hosts(spark, sf_dir) -> DataFrame:
    """Each page's URL on its own host and on each of HOSTS, with credentials for some and another scheme for others."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    own = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    hosts = pages.withColumn("host", F.explode(F.array(own, *[F.lit(h) for h in HOSTS])))
    scheme = F.when(F.pmod("page_id", F.lit(5)) == 0, "ftp").otherwise("https")
    user = F.when(F.pmod("page_id", F.lit(7)) == 0, "u:p@").otherwise("")
    return hosts.withColumn("variant", F.concat(scheme, F.lit("://"), user, "host", F.lit("/x")))


def url_guard(spark, sf_dir) -> DataFrame:
    return _on_hosts(spark, sf_dir).select("page_id", "host", urls.url_guard(F.col("variant")).alias("error_code"))


def source_quality(spark, sf_dir) -> DataFrame:
    return _on_hosts(spark, sf_dir).groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.max(urls.source_quality(F.col("host"))).alias("quality"))


def access_status(spark, sf_dir) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in (200, 204, 301, 401, 402, 403, 404, 410, 429, 500)])
    body = F.when(F.pmod("page_id", F.lit(4)) == 0, "Please SUBSCRIBE to continue").otherwise("text")
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(codes).alias("code"), body.alias("body"))
    return pages.select("page_id", "code", urls.access_status(F.col("code"), F.col("body")).alias("status"))


def url_clean(spark, sf_dir) -> DataFrame:
    raw = F.concat(F.lit(" <"), "url", F.lit("#part>."))
    pages = table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"))
    clean = urls.clean_url(F.col("raw"))
    return pages.select("page_id", clean.alias("clean"), urls.is_http(clean).alias("http"))


def as_of_dates(spark, sf_dir) -> DataFrame:
    day = lambda f: F.date_format("ts", f)
    chinese = F.concat(F.lit("截至"), F.year("ts").cast("string"), F.lit("年"), F.month("ts").cast("string"), F.lit("月"), F.dayofmonth("ts").cast("string"), F.lit("日"))
    kinds = [F.concat(F.lit("As of "), day("yyyy-MM-dd")), chinese, F.concat(F.lit("2023-12-31, then "), day("yyyy-MM-dd")), F.lit("March 2025 and june 2025"), F.lit("no date")]
    prompt = F.element_at(F.array(*kinds), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", prompt.alias("prompt"))
    return rows.select("event_id", t.as_of_chinese(F.col("prompt")).alias("as_of_a"), t.as_of_english(F.col("prompt"), "2026-02-11").alias("as_of_b"), t.language_of(F.col("prompt")).alias("language"))


def judge_text_parse(spark, sf_dir) -> DataFrame:
    yes = F.col("quality") == 1
    chinese = F.concat(F.lit("最终答案: a"), F.col("doc_id").cast("string"), F.when(yes, "\n解释： r\n结论：正确").otherwise("\n结论: 错误"))
    english = F.concat(F.lit("reasoning: because\ncorrect: "), F.when(yes, "Yes").when(F.col("toxic") == 1, "maybe").otherwise("no"))
    rows = table(spark, sf_dir, "labels").select("doc_id", verdicts.chinese_verdict(chinese).alias("c"), verdicts.english_verdict(english).alias("e"))
    return rows.select("doc_id", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("extracted_answer", "conclusion", "rationale")], *[F.col(f"e.{x}").alias(f"e_{x}") for x in ("extracted_answer", "conclusion", "rationale")])


def binary_score_parse(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    forms = [F.concat(F.lit('{"score": '), (k / 100).cast("string"), F.lit("}")), F.concat(F.lit("Score = "), F.pmod(k, F.lit(2)).cast("string")), F.concat(F.lit("maybe 1, rather "), F.pmod(k, F.lit(2)).cast("string")), F.lit("none")]
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*forms), (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("x"))
    return rows.select("event_id", verdicts.binary_score(F.col("x")).alias("score"))


def answer_leak_scan(spark, sf_dir) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return leaks.corpus_leaks(docs, items, "doc_id", "text", "item_id", "text")


def answer_in_prompt(spark, sf_dir) -> DataFrame:
    """Answers cut out of the document itself for even numbers, and out of the one before for odd ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = F.substring("text", 5, 12).alias("answer")
    even = docs.where(F.pmod("doc_id", F.lit(2)) == 0).select(F.explode(F.array("doc_id", F.col("doc_id") + 1)).alias("doc_id"), cut)
    answers = even
    return leaks.answer_in_prompt(docs, answers, "text", "answer", "doc_id").select("doc_id", "answer")


def id_parity(spark, sf_dir) -> DataFrame:
    return leaks.id_parity(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


def leaked_keys(spark, sf_dir) -> DataFrame:
    raw = F.when(F.col("quality") == 0, F.to_json(F.struct("doc_id", F.lit("x").alias("answer"), F.when(F.col("toxic") == 0, "y").alias("canary")))).otherwise(F.to_json(F.struct("doc_id", F.lit("x").alias("answers"))))
    found = leaks.leaked_keys(table(spark, sf_dir, "labels").withColumn("raw", raw), "raw", "doc_id")
    return found.select("doc_id", F.array_join(F.array_sort("leaked"), ",").alias("leaked"))


def canonical_hashes(spark, sf_dir) -> DataFrame:
    """One object for each document in two spellings: keys in another order at every depth, blanks, numbers with zeros at their end."""
    n = F.col("doc_id").cast("string")
    inner = F.expr("substring(to_json(array(lang)), 2, length(to_json(array(lang))) - 2)")
    one = F.concat(F.lit('{"b": {"y": [1, {"n": null, "m": '), inner, F.lit('}, "z"], "x": 1.50}, "a": '), n, F.lit("}"))
    two = F.concat(F.lit('{"a":'), n, F.lit('.0,"b":{"x":1.5,"y":[1.0,{"m":'), inner, F.lit(',"n":null},"z"]}}'))
    docs = table(spark, sf_dir, "documents").select("doc_id", one.alias("one"), two.alias("two"))
    return docs.select("doc_id", t.hash_object(F.col("one")).alias("hash"), (t.hash_object(F.col("one")) == t.hash_object(F.col("two"))).alias("same"))


def leaked_markers(spark, sf_dir) -> DataFrame:
    """Whole documents, some with markers at their end, in their middle, or cut short."""
    n = F.pmod("doc_id", F.lit(6))
    raw = F.when(n == 0, F.concat("text", F.lit(' {"reference_answer": 1, "JUDGE_PROMPT": ""}'))).when(n == 1, F.replace("text", F.lit(" "), F.lit("reference_steps"))).when(n == 2, F.concat("text", F.lit("extracted_final_answe"))).otherwise(F.col("text"))
    return leaks.leaked_markers(table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")), "raw", "doc_id")


def backward_attribution(spark, sf_dir) -> DataFrame:
    cited = F.when(F.col("role") == "assistant", F.concat(F.lit("c"), F.col("turn").cast("string")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", cited.alias("cited"))
    return rows.withColumn("attributed", attribution.backward("cited", ["conv_id"], ["turn"])).where("attributed is not null").select("conv_id", "turn", "attributed")


def _reports(spark, sf_dir) -> DataFrame:
    sources = F.lit("\n\n[1]: https://a.example/x#p\n[2]: <https://b.example/y>\n")
    body = F.concat(F.replace("text", F.lit("."), F.lit(" [1-2].")), F.lit(" See [site](https://c.example/z). Tail [9]."), sources)
    return table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("report"), body.alias("markdown"))


def markdown_attribution(spark, sf_dir) -> DataFrame:
    return attribution.attributions(_reports(spark, sf_dir), "report", "markdown")


def attribution_rates(spark, sf_dir) -> DataFrame:
    parsed = attribution.attributions(_reports(spark, sf_dir), "report", "markdown")
    fetched = spark.createDataFrame([("https://a.example/x", 1), ("https://b.example/y", 0)], "url string, link_works int")
    return attribution.rates(attribution.pairs(parsed, F.broadcast(fetched), support=F.when(F.length("text") > 40, 1).otherwise(0)))


def judged_attributions(spark, sf_dir) -> DataFrame:
    """Turns as sentences with one citation each, to pages that say the same, that say something else, or can't be reached; judged for relevance and support."""
    turns = table(spark, sf_dir, "conversations").where("text is not null and text <> ''").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.col("turn").alias("attribution"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    n = F.pmod("attribution", F.lit(3))
    url = F.concat(F.lit("https://a.example/"), F.col("key"))
    cited = turns.select("key", "attribution", F.lit("c1").alias("citation_id"), url.alias("url"), "text", F.when(n < 2, 1).otherwise(0).alias("link_works"))
    fetched = cited.select("url", F.when(n == 0, F.concat(F.lit("It says: "), "text")).otherwise(F.concat(F.substring("text", 1, 12), F.lit(" and no more"))).alias("url_content"))
    found = judging.judged_pairs(cited, fetched, judging.fixture_pair_judge)
    return found.select("key", "link_works", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("relevant", "supported")])


def xor_roundtrip(spark, sf_dir) -> DataFrame:
    from ..session import bounded_batches

    bounded_batches(spark)
    items = table(spark, sf_dir, "benchmark").withColumn("pw", F.concat(F.lit("pw"), F.col("item_id").cast("string")))
    cell = cipher.encrypt_cell(F.col("text"), F.col("pw"))
    back = cipher.decrypt_cell(cell, F.col("pw"))
    twice = cipher.xor_with_key(cipher.xor_with_key(F.encode("text", "UTF-8"), "key"), "key")
    return items.select("item_id", cell.alias("cell"), F.sha2(back, 256).alias("cell_sha256"), F.sha2(twice, 256).alias("bytes_sha256"))


QUERIES = {f.__name__: f for f in (
    answer_normalize_match, last_marked_answer, page_text, path_segments, claim_extract, claim_citation_map, html_to_text, page_metadata,
    url_guard, source_quality, access_status, url_clean, as_of_dates, judge_text_parse, binary_score_parse, answer_leak_scan,
    answer_in_prompt, id_parity, leaked_keys, leaked_markers, canonical_hashes, backward_attribution, markdown_attribution, attribution_rates, judged_attributions, xor_roundtrip,
)}


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _norm(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({x}, '[{SPACE}]+', '', 'g'), '[，。；;,.]$', ''))"


def _page(x: str) -> str:
    x = f"regexp_replace(regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '(?m)^[ \\t]+|[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return _trim(x)


def _html(x: str) -> str:
    for tag in ("script", "style"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, char in t.PAGE_ENTITIES:
        x = f"regexp_replace({x}, '(?i)&{name};', '{char}', 'g')"
    return _trim(f"regexp_replace({x}, '[{SPACE}]+', ' ', 'g')")


_claims = lambda answer: f"""
p AS (SELECT doc_id, unnest(m) AS raw, unnest(range(len(m))) AS piece FROM (SELECT doc_id, regexp_extract_all({answer}, '{citations.CLAIM}', 1) AS m FROM documents)),
c AS (SELECT doc_id, piece, {_trim("raw")} AS claim FROM p),
k AS (SELECT *, min(piece) OVER (PARTITION BY doc_id) AS first_piece FROM c WHERE length(claim) >= 8)"""  # noqa: E731

_noise = ", ".join(f"'{x}'" for x in t.UI_NOISE_LINES)
_hosts = ", ".join(f"'{h}'" for h in HOSTS)
_variants = f"""
h AS (SELECT page_id, unnest(list_concat([regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)], [{_hosts}])) AS host FROM pages)"""
_gold = ", ".join(f"'{x}'" for x in leaks.GOLD_KEYS)

ORACLES = {
    "answer_normalize_match": f"""
WITH d AS (SELECT doc_id, text AS head FROM documents),
n AS (SELECT doc_id, {_norm("' ' || head || ' 。'")} AS normalized, {_norm(f"translate(replace(head, ' ', chr(12288)), '{LOWER}', '{LOWER.upper()}')")} AS ref FROM d)
SELECT doc_id, normalized, normalized = ref AS equal FROM n""",
    "last_marked_answer": f"""
WITH x AS (SELECT conv_id, turn, '最终答案： first' || chr(10) || text || chr(10) || '最终答案:' || chr(10) || ' ' || substr(text, 1, 20) || ' ' || chr(10) || 'Exact answer: x' AS x FROM conversations)
SELECT conv_id, turn, {_trim(f"regexp_extract_all(x, '最终答案[{SPACE}]*[:：][{SPACE}]*([^\\n]+)', 1)[-1]")} AS last_answer,
  {_trim(f"regexp_extract_all(x, '(?i)(?:Exact Answer|最终答案)[{SPACE}]*[:：][{SPACE}]*([^\\n]+)', 1)[1]")} AS first_answer FROM x""",
    "page_text": f"""
WITH r AS (SELECT conv_id, turn, role, ' ' || chr(9) || replace(text, '. ', '. ' || chr(13) || repeat(chr(10), 4) || ' ') || chr(10) || '复制' || chr(10) AS x FROM conversations),
c AS (SELECT conv_id, turn, {_page("x")} AS clean, {_page("substr(x, 1, 10)")} AS old, {_page("role")} AS asked FROM r),
l AS (SELECT *, list_filter(list_transform(string_split(clean, chr(10)), lambda s: {_trim("s")}), lambda s: s <> '' AND s <> asked AND s NOT IN ({_noise})
  AND NOT list_contains(list_transform(string_split(old, chr(10)), lambda o: {_trim("o")}), s)) AS kept FROM c)
SELECT conv_id, turn, sha256(clean) AS clean_sha256, length(clean) AS clean_chars, length({_page("array_to_string(kept, chr(10))")}) AS answer_chars FROM l""",
    "path_segments": r"""
SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(url, '[^\p{L}\p{N}._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 96), ''), 'task') AS unicode_segment,
  coalesce(nullif(regexp_replace(regexp_replace('..' || url, '[^a-zA-Z0-9._-]', '_', 'g'), '^\.+', ''), ''), 'task') AS safe_segment,
  CASE WHEN length(CAST(page_id AS VARCHAR)) < 6 THEN lpad(CAST(page_id AS VARCHAR), 6, '0') ELSE CAST(page_id AS VARCHAR) END AS padded,
  regexp_replace(trim(url), '[^A-Za-z0-9_.-]+', '_', 'g') AS sanitized FROM pages""",
    "claim_extract": f"""
WITH {_claims("text")} SELECT doc_id, piece, sha256(claim) AS claim_sha256,
  CASE WHEN length(claim) >= 80 OR piece = first_piece THEN 'major' ELSE 'minor' END AS importance,
  CASE WHEN regexp_matches(claim, '{t.VERIFIABLE}') THEN 'externally_verifiable' ELSE 'non_verifiable' END AS verifiability FROM k""",
    "claim_citation_map": f"""
WITH {_claims("replace(text, chr(10), '[2]【9】[1]' || chr(10)) || ' [0][3][3]'")},
g AS (SELECT doc_id, piece, list_transform(regexp_extract_all(claim, '(?:\\[[0-9]+\\]|【[0-9]+】)', 0), lambda m: CAST(regexp_replace(m, '[^0-9]', '', 'g') AS INT)) AS n FROM k),
f AS (SELECT doc_id, piece, list_filter(n, lambda x: x BETWEEN 1 AND 3) AS n FROM g)
SELECT doc_id, piece, array_to_string(list_transform(list_filter(n, lambda x, i: list_position(n, x) = i), lambda x: 'c' || x), ',') AS citation_ids FROM f""",
    "html_to_text": f"""
WITH b AS (SELECT page_id, {_html("html")} AS body, regexp_extract_all(html, '(?is)<title[^>]*>(.*?)</title>', 1)[1] AS title FROM pages)
SELECT page_id, sha256(body) AS text_sha256, length(body) AS text_chars, {_trim(f"regexp_replace(title, '[{SPACE}]+', ' ', 'g')")} AS title FROM b""",
    "page_metadata": """
WITH d AS (SELECT page_id, url, CASE WHEN page_id % 3 > 0 THEN '<meta property="article:published_time" content="2024-0' || (page_id % 9 + 1) || '-01">' || html ELSE html END AS html FROM pages)
SELECT page_id, regexp_extract_all(html, '(?i)(?:article:published_time|datePublished)[^>]+content=["'']([^"'']+)', 1)[1] AS published_at,
  lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS publisher FROM d""",
    "url_guard": f"""
WITH {_variants} SELECT page_id, host, CASE WHEN page_id % 5 = 0 THEN 'EVIDENCE_UNSAFE_SCHEME' WHEN page_id % 7 = 0 THEN 'EVIDENCE_URL_CREDENTIALS_FORBIDDEN'
  WHEN host IN ('localhost', 'a.localhost', '127.0.0.1', '172.16.0.9', '224.0.0.1') THEN 'EVIDENCE_PRIVATE_HOST' END AS error_code FROM h""",
    "source_quality": f"""
WITH {_variants} SELECT host, count(*) AS pages, CASE WHEN regexp_matches(host, '{urls.OFFICIAL}') THEN 1.0::DOUBLE
  WHEN regexp_matches(host, '{urls.OPEN_EDIT}') THEN 0.5 ELSE 0.75 END AS quality FROM h GROUP BY host""",
    "access_status": """
WITH c AS (SELECT page_id, unnest([200, 204, 301, 401, 402, 403, 404, 410, 429, 500]) AS code FROM pages)
SELECT page_id, code, CASE WHEN code = 401 THEN 'login_required' WHEN code = 402 OR page_id % 4 = 0 THEN 'paywalled' WHEN code IN (403, 429) THEN 'blocked'
  WHEN code IN (404, 410) THEN 'not_found' WHEN code BETWEEN 200 AND 299 THEN 'fetched' ELSE 'error' END AS status FROM c""",
    "url_clean": """
SELECT page_id, regexp_replace(url || '#part', '#.*$', '') AS clean, regexp_matches(url, '^(?i)https?://[^/?#]+') AS http FROM pages""",
    "as_of_dates": """
SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS as_of_a,
  CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN '2025-06' ELSE '2026-02-11' END AS as_of_b,
  CASE event_id % 5 WHEN 1 THEN 'zh-CN' ELSE 'en' END AS language FROM events""",
    "judge_text_parse": """
SELECT doc_id, 'a' || doc_id AS c_extracted_answer, CASE quality WHEN 1 THEN 'correct' ELSE 'incorrect' END AS c_conclusion,
  CASE quality WHEN 1 THEN 'r' ELSE 'Official-compatible Judge response.' END AS c_rationale, 'None' AS e_extracted_answer,
  CASE WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN NULL ELSE 'incorrect' END AS e_conclusion, 'because' AS e_rationale FROM labels""",
    "binary_score_parse": """
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN k >= 50 WHEN 1 THEN k % 2 WHEN 2 THEN k % 2 ELSE 0 END AS INT) AS score FROM e""",
    "answer_leak_scan": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE regexp_matches(b.text, '[^ \\t-\\r]')",
    "answer_in_prompt": """
SELECT d.doc_id, substr(e.text, 5, 12) AS answer FROM documents d JOIN documents e ON e.doc_id = d.doc_id - d.doc_id % 2
WHERE length(substr(e.text, 5, 12)) >= 8 AND contains(d.text, substr(e.text, 5, 12))""",
    "id_parity": """
SELECT d.doc_id, 1::BIGINT AS in_tasks, 0::BIGINT AS in_gold, 'missing_gold' AS problem FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 0, 1, 'missing_task' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "canonical_hashes": """
SELECT doc_id, 'sha256:' || sha256('{"a":' || doc_id || ',"b":{"x":1.5,"y":[1,{"m":"' || lang || '","n":null},"z"]}}') AS hash, true AS same FROM documents""",
    "leaked_markers": f"""
WITH r AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text || ' {{"reference_answer": 1, "JUDGE_PROMPT": ""}}' WHEN 1 THEN replace(text, ' ', 'reference_steps') WHEN 2 THEN text || 'extracted_final_answe' ELSE text END AS raw FROM documents)
SELECT doc_id, marker FROM r, (SELECT unnest({leaks.MARKERS}) AS marker) m WHERE contains(raw, marker)""",
    "leaked_keys": "SELECT doc_id, CASE toxic WHEN 0 THEN 'answer,canary' ELSE 'answer' END AS leaked FROM labels WHERE quality = 0",
    "backward_attribution": """
WITH a AS (SELECT conv_id, turn, first_value(CASE WHEN role = 'assistant' THEN 'c' || turn END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS attributed FROM conversations)
SELECT * FROM a WHERE attributed IS NOT NULL""",
    "judged_attributions": """
WITH t AS (SELECT conv_id || '/' || turn AS key, turn % 3 AS n, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM conversations WHERE text <> ''),
c AS (SELECT *, CASE n WHEN 0 THEN 'It says: ' || text ELSE substr(text, 1, 12) || ' and no more' END AS content FROM t)
SELECT key, CAST(n < 2 AS INT) AS link_works, CASE WHEN n < 2 THEN CAST(contains(content, substr(text, 1, 12)) AS INT) ELSE -1 END AS relevant,
  CASE WHEN n < 2 THEN CAST(contains(content, text) AS INT) ELSE -1 END AS supported FROM c""",
    "xor_roundtrip": """
WITH h AS (SELECT item_id, text, hex(encode(text)) AS t, sha256('pw' || item_id) AS k FROM benchmark),
b AS (SELECT *, list_transform(range(0, length(t) // 2), lambda i: printf('%02X', xor(('0x' || substr(t, 2 * i + 1, 2))::INT, ('0x' || substr(k, 2 * (i % 32) + 1, 2))::INT))) AS x FROM h)
SELECT item_id, to_base64(unhex(array_to_string(x, ''))) AS cell, sha256(text) AS cell_sha256, sha256(text) AS bytes_sha256 FROM b""",
}
