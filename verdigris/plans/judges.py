"""Queries over pages of chat products and over judges: each has its DuckDB SQL beside it."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pages as p
from ..operators import citations, grading, judging, metrics, state
from ..session import bounded_batches
from ..storage import delete, materialize, shared_dir
from ..tables import table
from .judge_store import VERDICTS, JudgeLedger

OWN = ["spam-farm.com", "www.example.com"]


def best_answer_block(spark, sf_dir) -> DataFrame:
    """Conversations as pages, their turns as blocks; the user's first turn is the prompt, and every third turn is of the answer's kind."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("order"), F.coalesce("text", F.lit("")).alias("text"), F.pmod("turn", F.lit(2)).alias("links"), (F.pmod("turn", F.lit(3)) == 2).alias("specific"))
    asked = turns.where("order = 0").groupBy("conv_id").agg(F.min("text").alias("prompt"))
    best = p.best_answers(turns.join(asked, "conv_id"), "conv_id")
    return best.select("conv_id", F.sha2("answer", 256).alias("answer_sha256"), F.length("answer").cast("long").alias("answer_chars"))


def external_links(spark, sf_dir) -> DataFrame:
    """Pages as links of sites of ten pages each, every link twice."""
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 10).alias("site"), "page_id", "url")
    twice = pages.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("order", F.col("page_id") * 2 + F.col("k"))
    return p.external_links(twice, OWN, "site").select("site", "citation_id", "url")


def page_states(spark, sf_dir) -> DataFrame:
    """Notes put on turns by number: error notes, prompts with blanks in them, hosts and paths."""
    bounded_batches(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    note = F.when(F.pmod("conv_id", F.lit(4)) == 0, "…请稍后重试。服务异常").when(F.pmod("conv_id", F.lit(4)) == 1, "操作过于频繁").otherwise("")
    asked = F.when(F.pmod("turn", F.lit(2)) == 0, F.regexp_replace("text", " ", " ​ \n")).otherwise(F.concat("text", F.lit("?!no")))
    code = F.element_at(F.array(*[F.lit(x) for x in (*p.STATUS_OF, "LOGIN_REQUIRED")]), (F.pmod("conv_id", F.lit(4)) + 1).cast("int"))
    path = F.concat(F.lit("/chat/"), F.when(F.pmod("turn", F.lit(3)) > 0, F.concat(F.lit("local_"), "turn")).otherwise(""))
    return rows.select(
        "conv_id", "turn", p.provider_error(F.concat("text", note)).alias("error_note"), p.prompt_on_page(F.concat(F.lit("x "), "text"), asked).alias("has_prompt"),
        p.execution_status(code).alias("status"), p.is_conversation_path(path).alias("in_conversation"), p.allowed_host(F.lower("text"), OWN).alias("own_host"),
    )


def _answers(spark, sf_dir) -> DataFrame:
    """Answers by label: right and marked, right in the judge's eyes, wrong, or without a reference."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    reference = F.concat(F.lit("ref "), F.col("doc_id").cast("string"))
    answer = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("最终答案: Ref "), F.col("doc_id").cast("string"), F.lit("。"))).when(F.col("quality") == 1, F.concat(F.lit("it is "), reference)).otherwise("no idea")
    return docs.select(F.col("doc_id").alias("task_id"), answer.alias("final_answer"), F.when(F.col("toxic") == 0, reference).alias("reference_answer"))


def _silent_judge(rows: DataFrame) -> DataFrame:
    """The stand-in, which says nothing of use about answers whose number ends in 7."""
    return grading.fixture_judge(rows).withColumn("judge_text", F.when(F.col("final_answer").endswith("7"), "no verdict").otherwise(F.col("judge_text")))


def cached_grades(spark, sf_dir) -> DataFrame:
    """Answers graded with a cache that has every second task judged wrong before, and once judged right before that."""
    rows = _answers(spark, sf_dir)
    parts = ["task_id", "reference_answer", "final_answer"]
    from ..operators import ledger

    old = rows.where(F.pmod("task_id", F.lit(2)) == 0).withColumn("cache_key", ledger.cache_key(F.lit("g").alias("grader"), F.lit("m").alias("profile"), *parts))
    done = old.withColumn("e", F.explode(F.array(F.struct(F.lit(1).alias("t"), F.lit("结论: 正确").alias("x")), F.struct(F.lit(2).alias("t"), F.lit("结论: 错误").alias("x"))))).select("cache_key", F.col("e.t").alias("completed_at"), F.col("e.x").alias("judge_text"))
    graded = grading.short_fact(rows, judging.cached(_silent_judge, done, "g", "m"))
    return graded.select("task_id", "exact", "conclusion", "error")


def judge_ledger(spark, sf_dir) -> DataFrame:
    """Two runs over one ledger: first every second task, then every row twice; half of the verdicts come from the first run, and every key is asked for once."""
    store = f"{shared_dir(spark)}/verdigris-judges-{uuid.uuid4().hex[:12]}"
    rows = _answers(spark, sf_dir).where("reference_answer is not null")
    asked = JudgeLedger(spark, store, "g", "m")
    asked.ask(rows.where(F.pmod("task_id", F.lit(2)) == 0), _silent_judge, "first")
    second = asked.ask(rows.unionByName(rows), _silent_judge, "second")
    calls = asked._table("verdicts", VERDICTS).groupBy("cache_key").agg(F.count(F.lit(1)).alias("calls"))
    jobs = asked.jobs().groupBy(F.col("task").cast("long").alias("task_id")).agg(F.count(F.lit(1)).alias("jobs"), F.count("cache_source_job_id").alias("from_cache"))
    found = second.groupBy("task_id", "cache_key").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("cache_hit").alias("hits"), F.max("judge_text").alias("judge_text"))
    out = materialize(found.join(calls, "cache_key").join(jobs, "task_id").select("task_id", "n_rows", "hits", "calls", "jobs", "from_cache", F.sha2("judge_text", 256).alias("text_sha256")), "judged")
    delete(spark, store)
    return out


def citation_entailment(spark, sf_dir) -> DataFrame:
    """Turns as answers that name two sources: the turn itself without its last sentence, and one that is too short."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("report"), "text")
    answers = turns.select("report", F.concat(F.lit("In 2024 it held. "), F.replace("text", F.lit("."), F.lit("!")), F.lit("\nAccording to 12 reports[1][2]")).alias("answer"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("cited"))
    evidence = turns.select("report", F.explode(F.array(F.struct(F.lit("a").alias("citation_id"), F.concat(F.lit("so: According to 12 reports[1][2]. "), "text").alias("text")), F.struct(F.lit("b").alias("citation_id"), F.lit("short").alias("text")))).alias("e")).select("report", "e.*")
    found = judging.entailment(citations.claims(answers, "report", "answer", "cited"), evidence, judging.fixture_entailment, "report")
    return found.groupBy("report").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("verdict") == "supported").alias("supported"), F.count("score").alias("scored"), F.round(F.avg("score"), 6).alias("score"), F.count("error").alias("errors"))


def question_grades(spark, sf_dir) -> DataFrame:
    k = F.pmod("doc_id", F.lit(5))
    name = F.col("doc_id").cast("string")
    response = F.when(k == 0, F.lit(None)).when(k == 1, F.concat(F.lit("so\n最终答案: "), name)).otherwise(F.concat(F.lit("最终答案: x"), name))
    said = F.when(k == 2, F.lit(None)).when(F.col("quality") == 1, F.concat(F.lit("最终答案: "), name, F.lit("\n解释: same\n结论: 正确"))).otherwise("结论:错误\n解释 none")
    rows = table(spark, sf_dir, "labels").withColumn("g", judging.question_grade(response.cast("string"), name, said.cast("string")))
    return rows.select("doc_id", "g.*")


def four_line_form(spark, sf_dir) -> DataFrame:
    name = F.col("doc_id").cast("string")
    text = F.concat(F.lit("**extracted_final_answer**: a"), name, F.lit("\nreasoning: because\nof it\n**correct**: "), F.when(F.col("quality") == 1, "yes").otherwise("no"), F.when(F.col("toxic") == 1, "").otherwise("\nconfidence: 80%"))
    rows = table(spark, sf_dir, "labels").withColumn("f", judging.four_lines(text))
    return rows.select("doc_id", "f.*")


def ordered_answers(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("solution"), F.col("l_quantity").cast("int").cast("string").alias("confidence"))
    found = metrics.in_order(rows, "question", ["n"], ["solution", "confidence"])
    return found.select("question", F.array_join("solution", ",").alias("solutions"), F.array_join("confidence", ",").alias("confidences"))


def fact_ratio(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), (F.col("l_returnflag") == "R").cast("int").alias("right"), (F.col("l_returnflag") != "A").cast("int").alias("statements"))
    return metrics.fact_ratio(rows, "task")


def vote_scores(spark, sf_dir) -> DataFrame:
    votes = metrics.majority_vote(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")
    gold = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "O", "N").otherwise(F.col("o_orderstatus")).alias("l_returnflag"))
    found = metrics.vote_score(votes, gold, "l_orderkey", "l_returnflag")
    return found.select("l_orderkey", "majority", F.round("share", 6).alias("share"), "score")


def failure_states(spark, sf_dir) -> DataFrame:
    """Results of every status, some completed without an answer."""
    status = F.element_at(F.array(*[F.lit(x) for x in ("completed", "timeout", "submission_unconfirmed", "collection_failed", "needs_login", "ui_changed")]), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    rows = table(spark, sf_dir, "labels").select(status.alias("status"), F.when(F.col("quality") == 1, "a").alias("answer"))
    return rows.withColumn("state", F.coalesce(state.failure_state(F.col("status"), F.col("answer")), F.lit("READY_FOR_GRADING"))).groupBy("status", "state").agg(F.count(F.lit(1)).alias("cases"))


def recovery_counters(spark, sf_dir) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in state.NEXT]), (F.pmod("event_id", F.lit(len(state.NEXT))) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_type", state.resume_action(status).alias("action"))
    return metrics.recovery_counters(rows, "event_type")


QUERIES = {f.__name__: f for f in (
    best_answer_block, external_links, page_states, cached_grades, judge_ledger, citation_entailment, question_grades, four_line_form,
    ordered_answers, fact_ratio, vote_scores, failure_states, recovery_counters,
)}

_in = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"

ORACLES = {
    "judge_ledger": """
WITH a AS (
  SELECT doc_id, 'ref ' || doc_id AS reference, CASE WHEN doc_id % 3 = 0 THEN '最终答案: Ref ' || doc_id || '。' WHEN quality = 1 THEN 'it is ref ' || doc_id ELSE 'no idea' END AS answer
  FROM documents JOIN labels USING (doc_id) WHERE toxic = 0
), j AS (
  SELECT doc_id, CASE WHEN ends_with(answer, '7') THEN 'no verdict' ELSE '最终答案: ' || substr(answer, 1, 40) || chr(10) || '解释: containment' || chr(10) || '结论: '
    || CASE WHEN contains(answer, reference) THEN '正确' ELSE '错误' END END AS said FROM a
)
SELECT doc_id AS task_id, 2::BIGINT AS n_rows, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS hits, 1::BIGINT AS calls, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS jobs,
  CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS from_cache, sha256(said) AS text_sha256 FROM j""",
    "best_answer_block": r"""
WITH a AS (SELECT conv_id, min(coalesce(text, '')) AS prompt FROM conversations WHERE turn = 0 GROUP BY conv_id),
b AS (SELECT conv_id, turn, coalesce(text, '') AS text, prompt, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations JOIN a USING (conv_id)),
c AS (SELECT *, length(text) + turn % 2 * 100 + turn * 2 + CASE WHEN turn % 3 = 2 THEN 1000000 ELSE 0 END - CASE WHEN contains(text, prompt) THEN length(prompt) ELSE 0 END AS points,
  trim(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?m)^[ \t]+|[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS clean FROM b WHERE n <= 100),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY points DESC, turn) AS place FROM c WHERE length(clean) >= 8 AND clean <> prompt)
SELECT conv_id, sha256(clean) AS answer_sha256, length(clean) AS answer_chars FROM d WHERE place = 1 AND NOT contains(clean, '有什么我能帮你的吗')""",
    "external_links": f"""
WITH l AS (SELECT page_id // 10 AS site, page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages),
f AS (SELECT site, url, min(page_id) AS page_id FROM l WHERE starts_with(url, 'http') AND host NOT IN {_in(OWN)} GROUP BY site, url)
SELECT site, 'src' || row_number() OVER (PARTITION BY site ORDER BY page_id) AS citation_id, url FROM f""",
    "page_states": f"""
SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN '服务异常' WHEN 1 THEN '操作过于频繁' END AS error_note, turn % 2 = 0 AS has_prompt,
  {_in(p.STATUS_OF.values()).replace("(", "[").replace(")", ", 'provider_error']")}[conv_id % 4 + 1] AS status, turn % 3 > 0 AS in_conversation, coalesce(lower(text) IN {_in(OWN)}, false) AS own_host FROM conversations""",
    "cached_grades": """
WITH r AS (SELECT doc_id, quality, toxic, doc_id % 3 = 0 AS marked FROM documents JOIN labels USING (doc_id)),
x AS (SELECT doc_id, toxic, toxic = 0 AND marked AS exact, doc_id % 2 = 0 AS known, quality = 1 AND NOT marked AND doc_id % 10 = 7 AS silent, quality = 1 AND NOT marked AS judged_right FROM r)
SELECT doc_id AS task_id, exact, CASE WHEN toxic = 1 THEN NULL WHEN exact THEN 'correct' WHEN known THEN 'incorrect' WHEN silent THEN NULL WHEN judged_right THEN 'correct' ELSE 'incorrect' END AS conclusion,
  CASE WHEN toxic = 1 THEN 'gold has no reference answer' WHEN NOT exact AND NOT known AND silent THEN 'judge response has no conclusion' END AS error FROM x""",
    "citation_entailment": """
SELECT conv_id || '/' || turn AS report, 2::BIGINT AS pairs, 1::BIGINT AS supported, 1::BIGINT AS scored, 1.0::DOUBLE AS score, 0::BIGINT AS errors FROM conversations WHERE text IS NOT NULL""",
    "question_grades": """
SELECT doc_id, CAST(CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE quality END AS INT) AS score,
  CASE WHEN doc_id % 5 IN (0, 2) THEN '' WHEN doc_id % 5 = 1 OR quality = 1 THEN CAST(doc_id AS VARCHAR) END AS extracted,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '答案完全正确, 无需调用LLM Judge' WHEN 2 THEN 'Judge Response error' ELSE CASE WHEN quality = 1 THEN 'same' ELSE '解释 none' END END AS explanation FROM labels""",
    "four_line_form": """
SELECT doc_id, CASE toxic WHEN 1 THEN '' ELSE 'a' || doc_id END AS answer, CASE toxic WHEN 1 THEN '' ELSE 'because' || chr(10) || 'of it' END AS reasoning,
  CASE toxic WHEN 1 THEN '' ELSE CASE quality WHEN 1 THEN 'yes' ELSE 'no' END END AS correct, CASE toxic WHEN 1 THEN '' ELSE '80%' END AS confidence FROM labels""",
    "ordered_answers": """
WITH r AS (SELECT l_orderkey AS question, l_linenumber AS n, l_returnflag AS s, CAST(CAST(floor(l_quantity) AS INT) AS VARCHAR) AS c FROM lineitem)
SELECT question, string_agg(s, ',' ORDER BY n, s, c) AS solutions, string_agg(c, ',' ORDER BY n, s, c) AS confidences FROM r GROUP BY question""",
    "fact_ratio": """
SELECT l_orderkey AS task, round(count_if(l_returnflag = 'R') / nullif(count_if(l_returnflag <> 'A'), 0), 6) AS fact_ratio FROM lineitem GROUP BY 1""",
    "vote_scores": """
WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
v AS (SELECT l_orderkey, l_returnflag AS majority, n / sum(n) OVER (PARTITION BY l_orderkey) AS share, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) AS place FROM c)
SELECT l_orderkey, majority, round(share, 6) AS share, CAST(coalesce(majority = CASE o_orderstatus WHEN 'O' THEN 'N' ELSE o_orderstatus END, false) AS INT) AS score
FROM v LEFT JOIN orders ON l_orderkey = o_orderkey WHERE place = 1""",
    "failure_states": """
WITH r AS (SELECT ['completed', 'timeout', 'submission_unconfirmed', 'collection_failed', 'needs_login', 'ui_changed'][doc_id % 6 + 1] AS status, quality FROM labels)
SELECT status, CASE status WHEN 'completed' THEN CASE quality WHEN 1 THEN 'READY_FOR_GRADING' ELSE 'PROVIDER_ERROR' END WHEN 'timeout' THEN 'TIMED_OUT' WHEN 'submission_unconfirmed' THEN 'SUBMISSION_UNCONFIRMED'
  WHEN 'collection_failed' THEN 'COLLECTION_FAILED' ELSE 'PROVIDER_ERROR' END AS state, count(*) AS cases FROM r GROUP BY 1, 2""",
    "recovery_counters": f"""
WITH e AS (SELECT event_type, [{", ".join(f"'{x}'" for x in state.NEXT)}][event_id % {len(state.NEXT)} + 1] AS s FROM events)
SELECT event_type, count(*) AS cases, CAST(count_if(s IN {_in(state.BEFORE_SUBMISSION)}) AS BIGINT) AS reset, CAST(count_if(s IN {_in(state.AMBIGUOUS)}) AS BIGINT) AS needs_human, CAST(count_if(s IN {_in(state.SKIPPED)}) AS BIGINT) AS already_done,
  CAST(count_if(s NOT IN {_in([*state.BEFORE_SUBMISSION, *state.AMBIGUOUS, *state.SKIPPED])}) AS BIGINT) AS left_alone FROM e GROUP BY event_type""",
}
