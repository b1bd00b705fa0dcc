"""Golden rows of the operators."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdigris.operators import attribution, citations, grading, judging, leaks, ledger, metrics, selection, state
from verdigris.plans import config, workflow
from verdigris.sources import readers, schemas, sinks


def test_transitions():
    assert not state.can_transition("SUBMITTING", "RUNNING")
    assert state.can_transition("DONE", "GRADING")
    assert state.can_transition("SUBMISSION_UNCONFIRMED", "SUBMITTED")
    assert state.can_transition("RUNNING", "TIMED_OUT")
    assert not state.can_transition("CANCELLED", "QUEUED")


def test_resume(spark):
    rows = spark.createDataFrame([("CREATED",), ("RUNNING",), ("READY_FOR_GRADING",), ("CANCELLED",)], "s string")
    assert [r.a for r in rows.select(state.resume_action(F.col("s")).alias("a")).collect()] == ["rerun", "needs_human", "skip", "skip_other"]


def test_null_groups_have_one_sequence(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "c string, t int")
    assert sorted((str(r.c), r.seq) for r in state.sequence(rows, ["c"], ["t"]).collect()) == [("None", 0), ("None", 1), ("a", 0)]


def test_selection(spark):
    tasks = spark.range(20).select(F.col("id").cast("string").alias("task_id"))
    a = [r.task_id for r in selection.select_seeded(tasks, "s", 5).orderBy("ordinal").collect()]
    b = [r.task_id for r in selection.select_seeded(tasks.repartition(7), "s", 5).orderBy("ordinal").collect()]
    assert a == b and len(a) == 5
    assert [r.task_id for r in selection.select_ids(tasks, ["7", "3"]).orderBy("ordinal").collect()] == ["7", "3"]
    with pytest.raises(Exception, match="unknown task"):
        selection.select_ids(tasks, ["99"]).collect()


def test_claims(spark):
    rows = spark.createDataFrame([(1, "第一句说到了增长。[1]第二句也有内容[0][2]。short\nEnglish is fine. Still same claim", ["a"])], "k long, t string, c array<string>")
    found = citations.claims(rows, "k", "t", "c").orderBy("piece").collect()
    assert [(r.text, r.importance, r.citation_ids) for r in found] == [
        ("第一句说到了增长。", "major", []),
        ("[1]第二句也有内容[0][2]。", "minor", ["a"]),
        ("English is fine. Still same claim", "minor", []),
    ]


def test_kappa(spark):
    ten = spark.createDataFrame([("supported", "supported")] * 10, "e string, f string")
    assert metrics.kappa(ten, "e", "f").first().eligible is False
    thirty = spark.createDataFrame([("a", "a")] * 15 + [("b", "b")] * 15, "e string, f string")
    row = metrics.kappa(thirty, "e", "f").first()
    assert row.kappa == 1 and row.eligible
    none_equal = spark.createDataFrame([("a", "b")] * 4, "e string, f string")
    assert metrics.kappa(none_equal, "e", "f").first().kappa == 0


def test_calibration_bins(spark):
    rows = spark.createDataFrame([("m", "yes", "x"), ("m", "no", "100%"), ("m", "", "-5%")], "m string, c string, p string")
    r = metrics.calibration(rows, "m", "c", "p").first()
    assert (r.total, r.correct, r.wrong, r.none) == (3, 1, 1, 1)
    assert r.calibration_error_pct == pytest.approx((1 / 3 * 1 + 2 / 3 * 0.475) * 100, abs=1e-4)


def test_report_counts_numbers_only(spark):
    rows = spark.createDataFrame([("m", "scored", "0.5"), ("m", "scored", "null"), ("m", "scored", "true"), ("m", "scored", '"1"'), ("m", "failed", "1")], "metric_id string, status string, value_json string")
    r = metrics.metric_report(rows).first()
    assert (r.records, r.scored, r["mean"], r.failed) == (5, 1, 0.5, 1)


def test_overlay_without_citations(spark):
    subs = spark.createDataFrame([(1, 0, True, None, "adapter_failed"), (2, 0, True, "2024-01-01", "not_observable"), (3, 0, False, None, "none")], "k long, n_citations long, citation_required boolean, as_of string, citation_collection_status string")
    claims = citations.claims(spark.createDataFrame([(1, "some text that is long", ["c"])], "k long, t string, c array<string>"), "k", "t", "c")
    evidence = spark.createDataFrame([], "k long, status string, publisher string, published_at string")
    verdicts = spark.createDataFrame([], "k long, score double")
    got = {(r.k, r.metric_id): (r.value, r.status) for r in citations.overlay(subs, claims, evidence, verdicts, "k").collect()}
    assert got[1, "citation_validity"] == (None, "failed")
    assert got[2, "citation_validity"] == (None, "not_observable")
    assert got[3, "citation_validity"] == (0.0, "scored")
    assert got[1, "citation_completeness"] == (0.0, "scored")
    assert got[3, "citation_completeness"] == (None, "not_applicable")
    assert got[2, "temporal_validity"] == (None, "not_observable")


def test_bad_as_of_is_zero(spark):
    subs = spark.createDataFrame([(1, 1, True, "junk", "ok")], "k long, n_citations long, citation_required boolean, as_of string, citation_collection_status string")
    claims = citations.claims(spark.createDataFrame([(1, "x", ["c"])], "k long, t string, c array<string>"), "k", "t", "c")
    evidence = spark.createDataFrame([(1, "fetched", "a.gov", "2024-01-01")], "k long, status string, publisher string, published_at string")
    verdicts = spark.createDataFrame([(1, None)], "k long, score double")
    got = {r.metric_id: (r.value, r.status) for r in citations.overlay(subs, claims, evidence, verdicts, "k").collect()}
    assert got["temporal_validity"] == (0.0, "scored") and got["source_quality"] == (1.0, "scored")


def test_short_fact(spark):
    rows = spark.createDataFrame([("a", "最终答案： Paris。", "paris"), ("b", "maybe Paris", "Paris"), ("c", "x", None), ("d", "x", "y")], "task_id string, final_answer string, reference_answer string")
    calls = spark.sparkContext.accumulator(0)

    def judge(frame):
        calls.add(frame.count())
        return grading.fixture_judge(frame)

    got = {r.task_id: r for r in grading.short_fact(rows, judge).collect()}
    assert got["a"].exact and got["b"].conclusion == "correct" and got["d"].conclusion == "incorrect" and got["c"].error
    assert calls.value == 2
    with pytest.raises(Exception, match="gold has no reference"):
        grading.strict(grading.short_fact(rows, grading.fixture_judge)).collect()


def test_grade_composes_answers(spark):
    """Full-width answers, ligatures and decomposed letters match exactly and never reach the judge."""
    cases = spark.createDataFrame([("a", "READY_FOR_GRADING", "最终答案： Ｐａｒｉｓ　２０２４。"), ("b", "READY_FOR_GRADING", "最终答案: ﬁve cafe\u0301"), ("c", "READY_FOR_GRADING", "最终答案: Ｒｏｍｅ")], "task_id string, state string, answer string")
    gold = spark.createDataFrame([("a", "paris2024"), ("b", "FIVE CAFÉ"), ("c", "paris")], "task_id string, reference_answer string")
    got = {r.task_id: (r.exact, r.value_json) for r in workflow.grade(cases, gold, grading.fixture_judge).collect()}
    assert got == {"a": (True, "1"), "b": (True, "1"), "c": (False, "0")}


def test_dispatch_keeps_rows_without_a_grader(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "task_id string, benchmark_id string")
    graded = grading.dispatch(rows, {"a": lambda d: d.withColumn("score", F.lit(1.0)).withColumn("error", F.lit(None).cast("string"))})
    none = "no grader for benchmark"
    assert sorted((r.task_id, r.score, r.error) for r in graded.collect()) == [("1", 1.0, None), ("2", None, none), ("3", None, none)]


def test_selection_without_limit(spark):
    """All tasks in the order of the limited selection, and no window or limit in the plan."""
    tasks = spark.range(3000).select(F.col("id").cast("string").alias("task_id"), F.lit("s").alias("split"))
    found = workflow.select_tasks(tasks, config.Selection(split="s", seed="x", limit=None))
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "Limit" not in plan
    expected = selection.select_seeded(tasks, "x", 3000)
    pairs = lambda d: sorted((r.ordinal, r.task_id) for r in d.collect())
    assert pairs(found) == pairs(expected)


def test_long_form(spark):
    rows = spark.createDataFrame([("a", 7.5, 0.8), ("b", 1.0, None)], "task_id string, quality double, fact_ratio double")
    got = sorted((r.task_id, r.metric_id, r.value, r.status) for r in grading.long_form_scores(rows).where("value is not null or status = 'not_observable'").na.fill(-1.0).collect())
    assert got == [("a", "fact_ratio", 0.8, "scored"), ("a", "quality", 7.5, "scored"), ("b", "fact_ratio", -1.0, "not_observable"), ("b", "quality", 1.0, "scored")]


def test_attribution(spark):
    fence = "\n```\n[2] One.\n```\n"
    report = f"One. Two [1].\n\nTail. See [Site](https://s.example/p#x) and ![i](https://no.example).\n{fence}Left [9] [^2].\n\n[1]: <https://a.example>\n[^2]: https://f.example\n"
    odd = "\n\nA [x](https://a.example). B [1-2][2]. C![i](https://i.example/[1]) [7](/local).\n\n~~~\nopen [1]\n[1]: https://late.example"
    relabelled = "P [k](https://1.example) [k]. Q [1](https://2.example). R [1]. S [1](https://3.example). T [1].\n\n[1]: https://4.example\n[1]: https://5.example"
    reports = spark.createDataFrame([("a", report, 1), ("odd", odd, 2), ("k", relabelled, 3), ("none", None, 4), ("", "", 5)], "k string, m string, key int")
    rows = attribution.attributions(reports, "k", "m").collect()
    of = lambda key, kind: sorted((r for r in rows if r.key == key and r.kind == kind), key=lambda r: r.position)
    assert [(r.url, r.labels) for r in of("a", "citation")] == [("https://a.example", ["1"]), ("https://f.example", ["^2"]), ("https://s.example/p", ["Site"])]
    assert [(r.text, r.citation_ids) for r in of("a", "attribution")] == [("One.", ["c1"]), ("Two .", ["c1"]), ("Tail.", ["c3"]), ("See Site and .", ["c3"])]
    assert [r.text for r in of("a", "note")] == ["unresolved_citation_label:9", "unresolved_citation_label:2"]  # a footnote's definition is named ^2
    assert [(r.text, r.span_start, r.span_end) for r in of("odd", "attribution")] == [("A x.", 0, 25)]
    assert [r.text[-1] for r in of("odd", "note")] == ["1", "2", "2", "7"]
    assert [r.url for r in of("k", "citation")] == [f"https://{i}.example" for i in (5, 1, 2, 3)]
    assert [r.citation_ids for r in of("k", "attribution")] == [["c2"], ["c3"], ["c3"], ["c4"], ["c4"]]
    assert {r.key for r in rows} == {"a", "odd", "k"}
    assert attribution.numbers(3, 1) == ["1", "2", "3"] and attribution.numbers(1, 60) == ["1", "60"]


def test_leaks(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj kk ll"), (2, "xaa bb cc dd ee ff gg hh ii jjx"), (3, "short")], "d long, t string")
    items = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj"), (2, "hor"), (3, "")], "i long, a string")
    got = sorted((r.d, r.i) for r in leaks.corpus_leaks(docs, items, "d", "t", "i", "a").collect())
    assert got == [(1, 1), (2, 1), (3, 2)]


def test_ledger(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), (None, 1, "c")], "k string, t int, v string")
    assert sorted((str(r.k), r.v) for r in ledger.latest(rows, ["k"], ["t"]).collect()) == [("None", "c"), ("k", "b")]


def test_majority_tie(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a")], "q int, a string")
    assert metrics.majority_vote(rows, "q", "a").first().majority == "a"


def test_files(spark, tmp_path):
    good = '{"task_id":"t1","benchmark_id":"b","split":"s","input":{"prompt":"p"},"constraints":{"timeout_seconds":5},"answer":"x"}'
    (tmp_path / "tasks.jsonl").write_text(good + "\n\n" + good.replace('"split":"s"', '"split":"z"') + "\n")
    assert readers.tasks(spark, str(tmp_path / "tasks.jsonl"), "s").count() == 1
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(ValueError, match="not a task"):
        readers.tasks(spark, str(tmp_path / "bad.jsonl"), "s")
    (tmp_path / "gold.jsonl").write_text('{"task_id":"t1","reference_answer":"old"}\n{"task_id":"t1","reference_answer":"new"}\n')
    assert [r.reference_answer for r in readers.gold(spark, str(tmp_path / "gold.jsonl")).collect()] == ["new"]
    (tmp_path / "x.csv").write_text("﻿a,b\n1,2\n")
    assert readers.csv_with_mark(spark, str(tmp_path / "x.csv")).columns == ["a", "b"]
    raw = spark.createDataFrame([(good,)], "line string")
    assert raw.select(schemas.unknown_fields(raw, "line", ["task_id", "benchmark_id", "split", "input", "constraints"]).alias("u")).first().u == ["answer"]
    with pytest.raises(ValueError):
        sinks.safe_relative("../x")


def test_workflow(spark, tmp_path):
    tasks = spark.createDataFrame([("t1", "p1"), ("t2", "p2")], "task_id string, prompt string")
    cases = workflow.case_states(workflow.fixture_run(tasks))
    gold = spark.createDataFrame([("t1", "p1"), ("t2", "zzz")], "task_id string, reference_answer string")
    scores = workflow.grade(cases, gold, grading.fixture_judge)
    found, counters = workflow.report(scores, cases)
    report, markdown = sinks.run_report(found, counters, {"run_id": "r"})
    assert report["metrics"]["short_fact_accuracy"]["mean"] == 0.5 and "| short_fact_accuracy | 2 |" in markdown
    sinks.write_report(spark, str(tmp_path), report, markdown)
    assert (tmp_path / "report.json").exists()


def test_calls_happen_once(spark, tmp_path):
    tasks = spark.createDataFrame([("t1", "p1"), ("t2", "p2")], "task_id string, prompt string")
    log = str(tmp_path / "calls")

    def adapter(frames):
        for f in frames:
            with open(log, "a") as out:
                out.writelines(f"{x}\n" for x in f.task_id)
            yield f.assign(status="completed", answer="a", error=None)[["task_id", "status", "answer", "error"]]

    for _ in range(2):
        assert workflow.once(tasks, adapter, str(tmp_path / "store")).count() == 2
    assert sorted(open(log).read().split()) == ["t1", "t2"]


def test_manifest():
    bad = config.Manifest("r", "b", "s", "browser", concurrency=2, headers=(("Cookie", "x"),), judge=config.JudgeProfile("process", "m"))
    assert len(bad.problems(("video",))) == 5
    assert config.Manifest("r", "b", "s", "http").problems(("short_fact",)) == []
    assert config.locked(bad)[1] == config.locked(bad)[1]


def test_stream_equals_batch(spark, tmp_path):
    from verdigris.streaming.log import sequenced

    rows = spark.createDataFrame([("c1", "e1", 1, "CREATED"), ("c1", "e2", 2, "QUEUED"), ("c2", "e3", 1, "CREATED"), ("c2", "e4", 2, "DONE")], "case_id string, event_id string, ts long, state string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sequenced(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("steps").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.event_id, r.seq, r.legal) for r in spark.table("steps").collect())
    assert got == [("e1", 0, True), ("e2", 1, True), ("e3", 0, True), ("e4", 1, False)]
    batch = state.sequence(rows, ["case_id"], ["ts", "event_id"])
    assert sorted((r.event_id, r.seq) for r in batch.collect()) == [(a, b) for a, b, _ in got]


def test_calibration_counts_bins_from_the_last(spark):
    rows = spark.createDataFrame([("m", "no", "-67%"), ("m", "no", "90%")], "m string, c string, p string")
    assert metrics.calibration(rows, "m", "c", "p").first().calibration_error_pct == pytest.approx(78.5)
    with pytest.raises(Exception, match="below every bin"):
        metrics.calibration(rows.replace("-67%", "-101%"), "m", "c", "p").collect()


def test_kappa_refuses_what_it_cannot_compare(spark):
    rows = spark.createDataFrame([("a", "b")], "e string, f string")
    with pytest.raises(Exception, match="unknown label: a/b"):
        metrics.kappa(rows, "e", "f", labels=["a"]).collect()
    with pytest.raises(Exception, match="no labels"):
        metrics.kappa(rows.where("false"), "e", "f").collect()


def test_failed_results(spark):
    rows = spark.createDataFrame([("completed", "a"), ("completed", None), ("timeout", "a"), ("needs_login", None), (None, None)], "s string, a string")
    assert [r.x for r in rows.select(state.failure_state(F.col("s"), F.col("a")).alias("x")).collect()] == [None, "PROVIDER_ERROR", "TIMED_OUT", "PROVIDER_ERROR", "PROVIDER_ERROR"]


def test_leaks_of_any_number_and_length(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "no match here"), (3, None), (4, "x  y")], "d long, t string")
    short = [(i, f"zz{i} yy{i}") for i in range(12_000)]  # once a limit
    items = spark.createDataFrame([*short, (-1, "uick br"), (-2, "row"), (-3, " fox j"), (-4, "quick  brown"), (-5, "e quick brown f"), (-6, "h"), (-7, " "), (-8, None), (-9, "x  y")], "i long, a string")
    assert sorted((r.d, r.i) for r in leaks.corpus_leaks(docs, items, "d", "t", "i", "a").collect()) == [(1, -6), (1, -5), (1, -3), (1, -2), (1, -1), (2, -6), (4, -9)]
    assert leaks.corpus_leaks(docs, items.where("false"), "d", "t", "i", "a").count() == 0


def test_a_task_that_runs_again_calls_nobody(monkeypatch):
    calls = []

    def adapter(frames):
        for f in frames:
            calls.extend(f.task_id)
            raise RuntimeError("after the first call")
            yield f

    class Context:
        attempt = 0

        def attemptNumber(self):
            return self.attempt

    monkeypatch.setattr(workflow.TaskContext, "get", lambda: Context())
    frames = [pd.DataFrame({"task_id": ["t1", "t2"], "prompt": ["p", "q"]})]
    with pytest.raises(RuntimeError):
        list(workflow.first_attempt_only(adapter)(iter(frames)))
    Context.attempt = 1
    again = pd.concat(workflow.first_attempt_only(adapter)(iter(frames)))
    assert calls == ["t1", "t2"] and set(again.status) == {"needs_human_verification"} and list(again.task_id) == ["t1", "t2"]


def test_cached_judge(spark):
    rows = spark.createDataFrame([("t1", "a b", "ref"), ("t1", "a b", "ref"), ("t2", "has ref", "ref"), ("t3", "x", "ref")], "task_id string, final_answer string, reference_answer string")
    asked = []

    def judge(some):
        asked.append(sorted(r.task_id for r in some.collect()))
        return grading.fixture_judge(some)

    nothing = spark.createDataFrame([], "cache_key string, completed_at long, judge_text string")
    parts = ["task_id", "reference_answer", "final_answer"]
    first = judging.judged_once(rows, judge, nothing, "g", "m", parts)
    done = first.select("cache_key", F.lit(1).cast("long").alias("completed_at"), "judge_text").where("task_id != 't3'").distinct()
    assert first.count() == 4
    second = judging.judged_once(rows, judge, done, "g", "m", parts).collect()
    assert asked == [["t1", "t2", "t3"], ["t3"]] and sorted(r.cache_hit for r in second) == [False, True, True, True]
    judging.judged_once(rows, judge, done, "g", "other profile", parts).collect()
    assert asked[-1] == ["t1", "t2", "t3"]


def test_entailment_verdicts(spark):
    texts = ['so {"verdict": "supported", "score": 1, "confidence": 0.9}', '{"verdict": "maybe", "confidence": 1}', '{"verdict": "irrelevant", "score": 2, "confidence": 1}', '{"verdict": "insufficient_evidence", "score": null, "confidence": 0}', "none", None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(judging.entailment_verdict(F.col("x")).alias("v")).select("v.*").collect()
    assert [(r.verdict, r.score, r.error) for r in rows] == [
        ("supported", 1.0, None), (None, None, "unknown verdict"), (None, None, "score is out of range"), ("insufficient_evidence", None, None), (None, None, "no JSON object"), (None, None, "no JSON object"),
    ]


def test_guard_reads_numeric_hosts(spark):
    from verdigris.functions import urls

    expected = {
        "http://0x7f000001/": "EVIDENCE_PRIVATE_HOST", "http://2130706433/": "EVIDENCE_PRIVATE_HOST", "http://0177.1/": "EVIDENCE_PRIVATE_HOST", "http://127.0.0.1./": "EVIDENCE_PRIVATE_HOST",
        "http://8.8/": None, "http://256.1.1.1/": "EVIDENCE_INVALID_URL", "http://1.2.3.4.5/": "EVIDENCE_INVALID_URL", "http://my_host.org/x": None, "http://a.org/b c": None, "http://[::1]/": "EVIDENCE_PRIVATE_HOST",
        "http://[2606:4700::1]:80/": None, "http://u@a.org": "EVIDENCE_URL_CREDENTIALS_FORBIDDEN", "http://@a.org": None, "ftp://a.org": "EVIDENCE_UNSAFE_SCHEME", "nothing": "EVIDENCE_INVALID_URL", "http://": "EVIDENCE_INVALID_URL", "HTTP://A.LOCALHOST:1/": "EVIDENCE_PRIVATE_HOST",
    }
    rows = spark.createDataFrame([(x,) for x in expected], "u string").select("u", urls.url_guard(F.col("u")).alias("e")).collect()
    assert {r.u: r.e for r in rows} == expected


def test_judged_pairs(spark):
    """Each text and URL is asked about once, with the page cut at 5,000 characters; broken links aren't judged."""
    pairs = spark.createDataFrame([("a", 1, "the claim", "u1", 1), ("b", 1, "the claim", "u1", 1), ("a", 2, "another", "u1", 1), ("a", 3, "the claim", "u2", 0), ("a", 4, "silent", "u3", 1)], "key string, attribution int, text string, url string, link_works int")
    fetched = spark.createDataFrame([("u1", "x" * 4995 + "the claim"), ("u2", "the claim"), ("u3", None)], "url string, url_content string")
    requests = judging.pair_requests(pairs, fetched)
    assert requests.count() == 6
    asked = {(r.dimension, r.text, r.url): r.user for r in requests.collect()}
    assert asked["relevant", "the claim", "u1"] == f"Attribution Text:\nthe claim\n\nURL: u1\n\nURL Content:\n{'x' * 4995}the c\n\nEvaluate whether this URL content is relevant to the attribution text."
    judge = lambda rows: rows.withColumn("judge_text", F.when(F.col("url") == "u3", None).when(F.col("dimension") == "relevant", '{"score": 0.7}').otherwise("score = 0"))
    got = {(r.key, r.attribution): (r.relevant, r.supported, r.supported_text) for r in judging.judged_pairs(pairs, fetched, judge).collect()}
    assert got == {("a", 1): (1, 0, "score = 0"), ("b", 1): (1, 0, "score = 0"), ("a", 2): (1, 0, "score = 0"), ("a", 3): (None, None, None), ("a", 4): (None, None, None)}
    assert tuple(attribution.rates(judging.judged_pairs(pairs, fetched, judge)).where("key = 'b'").first())[1:] == (1.0, 1.0, 0.0, 1)


def test_results_table(spark):
    rows = [("q1", 0, "r", "A", 1.0, "same", False, False, None, 2.0, 4.0), ("q1", 1, "s", "B", 0.0, "other", True, False, "late", 4.0, 6.0), ("q1", 2, "t", "A", 1.0, "same", False, True, None, 0.0, 2.0)]
    names = ["question_id", "repeat", *metrics.REPEAT_COLUMNS, "cost", "seconds"]
    kinds = ["string", "int", "string", "string", "double", "string", "boolean", "boolean", "string", "double", "double"]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    questions, gold = spark.createDataFrame([("q1", "p"), ("q2", "p")], "question_id string, prompt string"), spark.createDataFrame([("q1", "A")], "question_id string, extracted_answer string")
    found = metrics.results_table(questions, frame, gold)
    assert len(found.columns) == 2 + 3 * 7 + 6
    got = {r.question_id: r for r in found.collect()}
    assert (got["q1"].response_1, got["q1"].error_2, got["q1"].content_filter_3, got["q1"].majority_vote_answer, got["q1"].majority_vote_score, got["q1"].best_of_n, got["q1"].mean_cost, got["q1"].mean_seconds) == ("r", "late", True, "A", 1, 1.0, 2.0, 4.0)
    assert got["q2"].response_1 is None and got["q2"].average is None
    for n, bad in ((2, frame), (3, frame.withColumn("repeat", F.lit(None).cast("int")))):
        with pytest.raises(Exception, match="repeat is not in 0 to"):
            metrics.results_table(questions, bad, gold, n=n).collect()


def test_poll_outcomes(spark):
    polls = {
        "stable": [("a", False), ("ab", False), ("ab", True), ("ab", False), ("abcdef", False)],  # equal for long enough, and not running any more
        "partial": [("abc", False), ("abcd", False), ("", False), ("xyzw", False), ("x", False)],
        "empty": [("", False), (None, False), ("", False)],
        "broken": [("ab", False), ("", False), ("ab", False)],
        "running": [("ab", True), ("ab", True), ("ab", None)],
    }
    rows = spark.createDataFrame([(k, i, a, r) for k, ps in polls.items() for i, (a, r) in enumerate(ps)], "k string, n int, answer string, running boolean")
    got = {r.k: (r.complete, r.answer, r.polls) for r in state.poll_outcomes(rows, ["k"], ["n"], "answer", "running", 3).collect()}
    assert got == {"stable": (True, "ab", 4), "partial": (False, "abcd", 5), "empty": (False, None, 3), "broken": (False, "ab", 3), "running": (True, "ab", 3)}


def test_bootstrap_is_near_the_normal_interval(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = {"a": rng.normal(5, 2, 400), "b": rng.integers(0, 2, 5000).astype(float), "one": np.array([3.0])}
    frame = spark.createDataFrame([(k, float(x)) for k, xs in values.items() for x in xs] + [("a", None), ("none", None)], "k string, v double")
    found = {r.k: (r.mean, r.low, r.high) for r in metrics.bootstrap_mean(frame.repartition(5), "v", "k").collect()}
    assert set(found) == set(values) and found["one"] == (3.0, 3.0, 3.0)
    for k in "ab":
        half = 1.96 * values[k].std() / len(values[k]) ** 0.5
        assert found[k] == pytest.approx((values[k].mean(), values[k].mean() - half, values[k].mean() + half), abs=half / 20)
    again = {r.k: (r.mean, r.low, r.high) for r in metrics.bootstrap_mean(frame.repartition(2), "v", "k").collect()}
    assert all(again[k] == pytest.approx(found[k]) for k in found)  # whatever the partitions
