"""Queries over grades: graders, overlays, calibration, repeats and costs. Each has its DuckDB SQL beside it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import VERIFIABLE
from ..operators import citations, grading, metrics, selection
from ..tables import table
from .texts import LOWER, _claims, _norm


def task_gold_join(spark, sf_dir) -> DataFrame:
    tasks = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 3000, "report_research").otherwise("multi_hop_research").alias("family"))
    joined = tasks.join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("lang", selection.track_for(F.col("family")).alias("track")).agg(F.count(F.lit(1)).alias("tasks"), F.sum("quality").alias("good"))


def public_request(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tasks = docs.select(
        F.col("doc_id").alias("task_id"),
        F.struct(F.col("text").alias("prompt"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("as_of")).alias("input"),
        F.struct(F.least("n_chars", F.lit(1800)).alias("timeout_seconds")).alias("constraints"),
    )
    return selection.public_request(tasks, 900)


def normalize_results(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.pmod("page_id", F.lit(4)) > 0, F.col("url")).alias("url"))
    cited = F.array(F.struct(F.lit("t").alias("text"), F.col("url").alias("url")), F.struct(F.lit("u").alias("text"), F.lit("").alias("url")))
    one = lambda x: x.cast("string")
    raw = pages.select(F.lit("r").alias("run_id"), one(F.col("page_id")).alias("case_id"), F.lit("1").alias("attempt_id"), one(F.col("page_id")).alias("task_id"), F.lit("answer").alias("answer"), cited.alias("citations"))
    rows = selection.normalize_results(raw).select("case_id", F.explode("citations").alias("c"))
    return rows.select("case_id", "c.*")


def short_fact_grades(spark, sf_dir) -> DataFrame:
    """Documents as references; answers are marked right, unmarked, or wrong, by quality labels."""
    head = F.col("text")
    answer = F.when(F.col("toxic") == 1, F.concat(F.lit("I think "), head)).when(F.col("quality") == 1, F.concat(F.lit("最终答案： "), F.translate(head, LOWER, LOWER.upper()), F.lit("。"))).otherwise("最终答案: other")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("task_id"), answer.alias("final_answer"), F.when(F.col("source") != "src3", head).alias("reference_answer"))
    return grading.short_fact(rows, grading.fixture_judge).select("task_id", "exact", "conclusion", "error")


def long_form_scores(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), (F.col("p_size") / 5).alias("quality"), F.when(F.col("p_size") > 10, F.round(F.lit(1) / F.col("p_size"), 6)).alias("fact_ratio"))
    return grading.long_form_scores(rows)


def nonempty_score(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.lit("　\n")).otherwise(F.col("text")).alias("answer"))
    return rows.select("conv_id", "turn", grading.nonempty_score(F.col("answer")).alias("score"))


def accuracy_by_source(spark, sf_dir) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(metrics.rate(F.col("quality") == 1), 6).alias("accuracy"), F.round(metrics.rate(F.col("quality") == 1, F.col("toxic") == 0), 6).alias("clean_accuracy"))


def citation_overlay_metrics(spark, sf_dir) -> DataFrame:
    """Documents as answers with markers; pages as evidence, three for each document that has any."""
    marked = F.concat("text", F.lit(" is so [1]"))
    docs = table(spark, sf_dir, "documents").select("doc_id", marked.alias("answer"), F.array(F.lit("c1"), F.lit("c2")).alias("cited"), "lang")
    codes = F.element_at(F.array(F.lit(200), F.lit(404), F.lit(200), F.lit(401)), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    host = F.when(F.pmod("page_id", F.lit(5)) == 0, "www.nih.gov").when(F.pmod("page_id", F.lit(5)) == 1, "de.wikipedia.org").otherwise("example.com")
    published = F.when(F.pmod("page_id", F.lit(3)) > 0, F.concat(F.lit("2024-0"), (F.pmod("page_id", F.lit(9)) + 1).cast("string"), F.lit("-01")))
    from ..functions.urls import access_status

    evidence = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 3).alias("doc_id"), access_status(codes, F.lit("text")).alias("status"), host.alias("publisher"), published.alias("published_at"))
    counts = evidence.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_citations"))
    verdicts = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, F.col("quality").cast("double")).alias("score"))
    as_of = F.when(F.col("lang") == "en", "2024-05-15").when(F.col("lang") == "de", "unknown")
    status = F.when(F.col("lang") == "fr", "adapter_failed").when(F.col("lang") == "es", "not_observable").otherwise("product_absent")
    submissions = docs.join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), (F.col("lang") != "de").alias("citation_required"), as_of.alias("as_of"), status.alias("citation_collection_status"))
    rows = citations.overlay(submissions, citations.claims(docs, "doc_id", "answer", "cited"), evidence, verdicts, "doc_id")
    return rows.withColumn("value", F.round("value", 6))


def judge_kappa(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    found = metrics.kappa(rows.withColumn("found", 1 - F.col("toxic")), "quality", "found", "lang")
    return found.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("agreement", "expected_agreement", "kappa")], "eligible")


def calibration_error(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    correct = F.when(F.pmod(k, F.lit(3)) == 0, "Yes").when(F.pmod(k, F.lit(3)) == 1, "no").otherwise("None")
    confidence = F.when(F.pmod(k, F.lit(11)) == 0, "x").when(F.pmod(k, F.lit(11)) == 1, F.concat(F.lit("-"), k.cast("string"), F.lit("%"))).otherwise(F.concat((k + 5).cast("string"), F.lit("%")))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), correct.alias("is_correct"), confidence.alias("confidence"))
    return metrics.calibration(rows, "model", "is_correct", "confidence")


def _answers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("repeat"), F.col("l_returnflag").alias("answer"), F.col("l_discount").alias("score"), F.col("l_tax").alias("cost"), F.col("l_quantity").alias("seconds"))


def best_of_n(spark, sf_dir) -> DataFrame:
    return metrics.repeats(_answers(spark, sf_dir)).withColumn("average", F.round("average", 6))


def majority_vote(spark, sf_dir) -> DataFrame:
    return metrics.majority_vote(_answers(spark, sf_dir), "question_id", "answer").drop("share")


def wide_repeat_pivot(spark, sf_dir) -> DataFrame:
    rows = _answers(spark, sf_dir).withColumn("repeat", F.col("repeat") - 1)
    return metrics.wide_repeats(rows, "question_id", "repeat", ["answer", "score"], 7)


def results_table(spark, sf_dir) -> DataFrame:
    """Orders as questions, their lines as repeats."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.col("l_orderkey").alias("question_id"), (F.col("l_linenumber") - 1).alias("repeat"), F.concat_ws("-", F.col("l_partkey").cast("string"), "l_returnflag").alias("response"), F.col("l_returnflag").alias("extracted_answer"),
        F.col("l_discount").alias("score"), F.concat(F.lit("tax "), F.col("l_tax").cast("string")).alias("score_reason"), (F.col("l_quantity") > 40).cast("string").alias("exceed_length"), (F.col("l_quantity") < 3).cast("string").alias("content_filter"),
        F.when(F.col("l_discount") == 0, "empty").alias("error"), F.col("l_tax").alias("cost"), F.col("l_quantity").alias("seconds"),
    )
    questions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderstatus").alias("answer"))
    gold = questions.select("question_id", F.when(F.col("answer") == "O", "N").otherwise(F.col("answer")).alias("extracted_answer"))
    found = metrics.results_table(questions, rows, gold, n=7)
    return found.withColumn("average", F.round("average", 6)).na.fill(-1, ["average", "best_of_n", "mean_cost", "mean_seconds", "majority_vote_score", *[f"score_{r}" for r in range(1, 8)]])


def api_cost(spark, sf_dir) -> DataFrame:
    prices = spark.createDataFrame([("A", 0.5, 1.5), ("N", 2.0, 8.0), ("R", 1.0, 4.0)], "model string, rate_in double, rate_out double")
    calls = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("model"), (F.col("l_quantity") * 1000).alias("tokens_in"), F.floor("l_extendedprice").alias("tokens_out"))
    cost = metrics.api_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("rate_in"), F.col("rate_out"), 7.123457)
    return calls.join(F.broadcast(prices), "model").select("l_orderkey", "l_linenumber", cost.alias("cost"))  # a row for each model: calls aren't dealt by so few keys


def top_model(spark, sf_dir) -> DataFrame:
    """Of each segment the nation with the highest mean balance."""
    means = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    return means.groupBy("c_mktsegment").agg(F.max_by("c_nationkey", "m").alias("best"), F.round(F.max("m"), 4).alias("mean"))


def temporal_validity(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    inside = F.col("ts") <= F.lit("2024-01-15").cast("timestamp")
    return rows.groupBy("event_type").agg(F.count("ts").alias("dated"), F.round(metrics.rate(inside), 6).alias("temporal_validity"))


def dataset_counts(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("dataset"), F.col("lang").alias("split"))
    turns = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("dataset"), F.col("role").alias("split"))
    return docs.unionByName(turns).groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("tasks"))


QUERIES = {f.__name__: f for f in (
    task_gold_join, public_request, normalize_results, short_fact_grades, long_form_scores, nonempty_score, accuracy_by_source,
    citation_overlay_metrics, judge_kappa, calibration_error, best_of_n, majority_vote, wide_repeat_pivot, results_table, api_cost, top_model,
    temporal_validity, dataset_counts,
)}


ORACLES = {
    "task_gold_join": """
SELECT lang, CASE WHEN n_chars > 3000 THEN 'long_form' ELSE 'short_fact' END AS track, count(*) AS tasks, CAST(sum(quality) AS BIGINT) AS good
FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""",
    "public_request": """
SELECT doc_id AS task_id, text AS prompt, lang AS language, CAST(NULL AS VARCHAR) AS as_of, least(n_chars, 1800, 900) AS timeout_seconds FROM documents""",
    "normalize_results": """
SELECT CAST(page_id AS VARCHAR) AS case_id, 'citation-0001' AS citation_id, 't' AS display_text, CASE WHEN page_id % 4 > 0 THEN url END AS visible_url,
  CASE WHEN page_id % 4 > 0 THEN 'visible_only' ELSE 'unresolvable' END AS collection_status FROM pages
UNION ALL SELECT CAST(page_id AS VARCHAR), 'citation-0002', 'u', '', 'unresolvable' FROM pages""",
    "short_fact_grades": f"""
WITH r AS (SELECT doc_id AS task_id, quality, toxic, text AS head, source FROM documents JOIN labels USING (doc_id)),
m AS (SELECT *, {_norm(f"regexp_extract('最终答案： ' || translate(head, '{LOWER}', '{LOWER.upper()}') || '。', '最终答案[:：][ \\n]*([^\\n]+)', 1)")} = {_norm("head")} AS same FROM r),
x AS (SELECT task_id, source = 'src3' AS missing, source <> 'src3' AND toxic = 0 AND quality = 1 AND same AS exact, toxic, quality, head FROM m)
SELECT task_id, exact, CASE WHEN missing THEN NULL WHEN exact THEN 'correct'
  WHEN contains(CASE WHEN toxic = 1 THEN 'I think ' || head WHEN quality = 1 THEN '最终答案： ' || translate(head, '{LOWER}', '{LOWER.upper()}') || '。' ELSE '最终答案: other' END, head) THEN 'correct' ELSE 'incorrect' END AS conclusion,
  CASE WHEN missing THEN 'gold has no reference answer' END AS error FROM x""",
    "long_form_scores": """
SELECT p_partkey AS task_id, 'quality' AS metric_id, p_size / 5 AS value, 'scored' AS status FROM part
UNION ALL SELECT p_partkey, 'fact_ratio', CASE WHEN p_size > 10 THEN round(1 / p_size, 6) END, CASE WHEN p_size > 10 THEN 'scored' ELSE 'not_observable' END FROM part""",
    "nonempty_score": "SELECT conv_id, turn, CASE WHEN role = 'user' OR trim(text) = '' THEN 0.0::DOUBLE ELSE 1.0 END AS score FROM conversations",
    "accuracy_by_source": """
SELECT source, count(*) AS n, round(avg(CAST(quality = 1 AS INT)), 6) AS accuracy, round(avg(CAST(quality = 1 AS INT)) FILTER (WHERE toxic = 0), 6) AS clean_accuracy
FROM documents JOIN labels USING (doc_id) GROUP BY source""",
    "citation_overlay_metrics": f"""
WITH {_claims("text || ' is so [1]'")},
c2 AS (SELECT doc_id, (length(claim) >= 80 OR piece = first_piece) AND regexp_matches(claim, '{VERIFIABLE}') AS major, contains(claim, '[1]') OR contains(claim, '[2]') AS mapped FROM k),
bc AS (SELECT doc_id, count_if(major) AS major, count_if(major AND mapped) AS mapped FROM c2 GROUP BY doc_id),
ev AS (SELECT page_id // 3 AS doc_id, [true, false, true, false][page_id % 4 + 1] AS fetched,
  CASE page_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.75 END AS q, CASE WHEN page_id % 3 > 0 THEN CAST('2024-0' || (page_id % 9 + 1) || '-01' AS DATE) END AS pub FROM pages),
d AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN DATE '2024-05-15' END AS lim, lang IN ('en', 'de') AS has_as_of FROM documents),
bs AS (SELECT doc_id, count(*) AS n, avg(CAST(fetched AS INT)) AS valid, avg(q) FILTER (WHERE fetched) AS quality, count(pub) AS dated, count_if(coalesce(pub <= lim, false)) AS in_time FROM ev JOIN d USING (doc_id) GROUP BY doc_id),
v AS (SELECT doc_id, avg(CASE WHEN toxic = 0 THEN quality END) AS correct FROM labels GROUP BY doc_id),
o AS (SELECT d.*, coalesce(bs.n, 0) AS n, valid, quality, dated, in_time, major, mapped, correct FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN bc USING (doc_id) LEFT JOIN v USING (doc_id)),
m AS (
  SELECT doc_id, 'citation_validity' AS metric_id, CASE WHEN n > 0 THEN valid WHEN lang NOT IN ('fr', 'es') THEN 0 END AS value,
    CASE WHEN n > 0 THEN 'scored' WHEN lang = 'fr' THEN 'failed' WHEN lang = 'es' THEN 'not_observable' ELSE 'scored' END AS status FROM o
  UNION ALL SELECT doc_id, 'citation_correctness', CASE WHEN n > 0 THEN correct END, CASE WHEN n > 0 AND correct IS NOT NULL THEN 'scored' ELSE 'not_observable' END FROM o
  UNION ALL SELECT doc_id, 'citation_completeness', CASE WHEN n > 0 AND major > 0 THEN mapped / major WHEN n = 0 AND lang <> 'de' THEN 0 END,
    CASE WHEN n > 0 THEN CASE WHEN major > 0 THEN 'scored' ELSE 'not_observable' END WHEN lang <> 'de' THEN 'scored' ELSE 'not_applicable' END FROM o
  UNION ALL SELECT doc_id, 'source_quality', CASE WHEN n > 0 THEN quality END, CASE WHEN n > 0 AND quality IS NOT NULL THEN 'scored' ELSE 'not_observable' END FROM o
  UNION ALL SELECT doc_id, 'temporal_validity', CASE WHEN n > 0 AND has_as_of AND dated > 0 THEN in_time / dated END,
    CASE WHEN NOT has_as_of THEN 'not_applicable' WHEN n > 0 AND dated > 0 THEN 'scored' ELSE 'not_observable' END FROM o)
SELECT doc_id, metric_id, round(CAST(value AS DOUBLE), 6) AS value, status FROM m""",
    "judge_kappa": """
WITH r AS (SELECT lang, quality AS e, 1 - toxic AS f FROM labels JOIN documents USING (doc_id)),
t AS (SELECT lang, count(*) AS n, avg(CAST(e = f AS INT)) AS agreement, (sum(e) * sum(f) + sum(1 - e) * sum(1 - f)) / (count(*) * count(*)) AS x FROM r GROUP BY lang),
k AS (SELECT *, CASE WHEN x = 1 THEN 1.0 ELSE (agreement - x) / (1 - x) END AS kappa FROM t)
SELECT lang, n, round(agreement, 6) AS agreement, round(x, 6) AS expected_agreement, round(kappa, 6) AS kappa, n >= 30 AND kappa >= 0.8 AS eligible FROM k""",
    "calibration_error": """
WITH e AS (SELECT event_type AS model, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
r AS (SELECT model, CASE k % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'none' END AS a, CASE k % 11 WHEN 0 THEN 0 WHEN 1 THEN -k ELSE k + 5 END AS c FROM e),
b AS (SELECT model, CASE WHEN c < 0 THEN 4 - (-c - 1) // 20 ELSE least(c // 20, 4) END AS bin, count(*) AS n, count_if(a = 'yes') AS y, count_if(a = 'no') AS w, sum(c) AS s FROM r GROUP BY 1, 2)
SELECT model, CAST(sum(n) AS BIGINT) AS total, CAST(sum(y) AS BIGINT) AS correct, CAST(sum(w) AS BIGINT) AS wrong, CAST(sum(n) - sum(y) - sum(w) AS BIGINT) AS "none",
  round(sum(y) / sum(n) * 100, 4) AS accuracy_pct, round(sum(abs(y / n - s / n / 100) * n) / sum(n) * 100, 4) AS calibration_error_pct FROM b GROUP BY model""",
    "best_of_n": """
SELECT l_orderkey AS question_id, round(avg(l_discount), 6) AS average, max(l_discount) AS best_of_n, round(avg(l_tax), 6) AS mean_cost, round(avg(l_quantity), 3) AS mean_seconds FROM lineitem GROUP BY 1""",
    "majority_vote": """
WITH c AS (SELECT l_orderkey AS question_id, l_returnflag AS majority, count(*) AS votes FROM lineitem GROUP BY 1, 2)
SELECT question_id, votes, majority FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, majority) AS n FROM c) WHERE n = 1""",
    "wide_repeat_pivot": "SELECT l_orderkey AS question_id, "
    + ", ".join(f"max(CASE WHEN l_linenumber = {r + 1} THEN {c} END) AS {v}_{r}" for r in range(7) for v, c in (("answer", "l_returnflag"), ("score", "l_discount")))
    + " FROM lineitem GROUP BY 1",
    "results_table": "WITH c AS (SELECT l_orderkey AS k, l_returnflag AS a, count(*) AS n FROM lineitem GROUP BY 1, 2), v AS (SELECT k, arg_min(a, struct_pack(x := -n, y := a)) AS a FROM c GROUP BY k), "
    + "w AS (SELECT l_orderkey AS question_id, round(avg(l_discount), 6) AS average, max(l_discount) AS best_of_n, round(avg(l_tax), 6) AS mean_cost, round(avg(l_quantity), 3) AS mean_seconds, "
    + ", ".join(f"max(CASE WHEN l_linenumber = {r} THEN {x} END) AS {c}_{r}" for r in range(1, 8) for c, x in (
        ("response", "l_partkey || '-' || l_returnflag"), ("extracted_answer", "l_returnflag"), ("score", "l_discount"), ("score_reason", "'tax ' || l_tax"), ("exceed_length", "CAST(l_quantity > 40 AS VARCHAR)"),
        ("content_filter", "CAST(l_quantity < 3 AS VARCHAR)"), ("error", "CASE WHEN l_discount = 0 THEN 'empty' END")))
    + " FROM lineitem GROUP BY 1) SELECT o_orderkey AS question_id, o_orderstatus AS answer, w.* EXCLUDE (question_id) REPLACE (coalesce(average, -1) AS average, coalesce(best_of_n, -1) AS best_of_n, coalesce(mean_cost, -1) AS mean_cost, coalesce(mean_seconds, -1) AS mean_seconds, "
    + ", ".join(f"coalesce(score_{r}, -1) AS score_{r}" for r in range(1, 8))
    + "), v.a AS majority_vote_answer, CASE WHEN v.a IS NULL THEN -1 ELSE CAST(coalesce(v.a = CASE WHEN o_orderstatus = 'O' THEN 'N' ELSE o_orderstatus END, false) AS INT) END AS majority_vote_score"
    + " FROM orders LEFT JOIN w ON o_orderkey = question_id LEFT JOIN (SELECT k, a FROM v) v ON o_orderkey = v.k",
    "api_cost": """
SELECT l_orderkey, l_linenumber, round((l_quantity * 1000 * i * 7.123457::DOUBLE + floor(l_extendedprice) * o * 7.123457::DOUBLE) / 1e6, 6) AS cost
FROM lineitem JOIN (VALUES ('A', 0.5::DOUBLE, 1.5::DOUBLE), ('N', 2.0, 8.0), ('R', 1.0, 4.0)) p(m, i, o) ON l_returnflag = m""",
    "top_model": """
WITH m AS (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1, 2)
SELECT c_mktsegment, arg_max(c_nationkey, m) AS best, round(max(m), 4) AS mean FROM m GROUP BY 1""",
    "temporal_validity": "SELECT event_type, count(ts) AS dated, round(avg(CAST(ts <= TIMESTAMP '2024-01-15' AS INT)), 6) AS temporal_validity FROM events GROUP BY 1",
    "dataset_counts": """
SELECT 'documents' AS dataset, lang AS split, count(*) AS tasks FROM documents GROUP BY lang UNION ALL SELECT 'conversations', role, count(*) FROM conversations GROUP BY role""",
}
