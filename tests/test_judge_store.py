"""The judge ledger: a key is asked for once, whatever is done with the result."""

import threading

import pytest
from pyspark.sql import functions as F

from verdigris.operators import grading
from verdigris.plans import judge_store, workflow
from verdigris.plans.judge_store import JudgeLedger, calling
from verdigris.storage import exclusive

ROWS = "task_id string, final_answer string, reference_answer string"


@pytest.fixture
def counting(tmp_path):
    """A judge that writes down each call, and the calls so far."""
    log = str(tmp_path / "calls")

    def ask(row):
        with open(log, "a") as out:
            out.write(row["task_id"] + "\n")
        return "结论: 正确" if row["reference_answer"] in row["final_answer"] else "结论: 错误"

    def calls():
        try:
            return sorted(open(log).read().split())
        except FileNotFoundError:
            return []

    return calling(ask), calls


def test_asked_once_over_actions_and_runs(spark, tmp_path, counting):
    judge, calls = counting
    rows = spark.createDataFrame([("a", "x is 1", "1"), ("b", "x is 2", "1"), ("a", "x is 1", "1"), ("c", None, "3"), ("d", "最终答案: 7", "7")], ROWS).repartition(3)
    store = str(tmp_path / "store")

    def run(name, profile="m"):
        return grading.short_fact(rows.fillna("", "final_answer"), JudgeLedger(spark, store, "g", profile).judge(judge, name))

    graded = run("first")
    assert calls() == ["a", "b", "c"]
    assert graded.count() == 5 and graded.count() == 5
    graded.write.parquet(str(tmp_path / "out"))
    assert {r.task_id: r.conclusion for r in graded.collect()} == {"a": "correct", "b": "incorrect", "c": "incorrect", "d": "correct"}
    again = run("second")
    assert sorted(r.conclusion for r in again.collect()) == sorted(r.conclusion for r in graded.collect())
    assert calls() == ["a", "b", "c"]
    jobs = JudgeLedger(spark, store, "g", "m").jobs()
    assert {(r.run_id, r.jobs, r.hits) for r in jobs.groupBy("run_id").agg(F.count(F.lit(1)).alias("jobs"), F.count("cache_source_job_id").alias("hits")).collect()} == {("first", 4, 0), ("second", 4, 4)}
    run("third", "another profile")
    assert calls() == ["a", "a", "b", "b", "c", "c"]


def test_workflow_grades_through_the_ledger(spark, tmp_path, counting):
    judge, calls = counting
    cases = spark.createDataFrame([("a", "READY_FOR_GRADING", "it is 1"), ("b", "RUNNING", "it is 1")], "task_id string, state string, answer string")
    gold = spark.createDataFrame([("a", "1"), ("b", "1")], "task_id string, reference_answer string")
    for run in ("one", "two"):
        scores = workflow.grade(cases, gold, judge, ledger_of=JudgeLedger(spark, str(tmp_path / "s"), "g", "m"), run_id=run)
        assert [(r.task_id, r.status, r.value_json) for r in scores.collect()] == [("a", "scored", "1")] and scores.count() == 1
    assert calls() == ["a"]


def test_unknown_outcomes_stay_claimed_until_released(spark, tmp_path, counting):
    judge, calls = counting
    rows = spark.createDataFrame([("a", "1", "1"), ("b", "2", "1")], ROWS)
    mine = JudgeLedger(spark, str(tmp_path / "s"), "g", "m")

    def lost(batch):  # what a repeated task gives for all its rows
        return batch.withColumn("judge_text", F.when(F.col("task_id") == "b", "结论: 错误"))

    first = {r.task_id: (r.judge_text, r.cache_hit) for r in mine.ask(rows, lost, "r1").collect()}
    assert first == {"a": (None, False), "b": ("结论: 错误", False)}
    assert [r.task_id for r in mine.keyed(rows).join(mine.open_claims(), "cache_key").collect()] == ["a"]
    mine.ask(rows, judge, "r2")
    assert calls() == []  # the claim is open: nobody knows whether it was asked
    mine.release(mine.keyed(rows))
    third = {r.task_id: (r.judge_text, r.cache_hit) for r in mine.ask(rows, judge, "r3").collect()}
    assert calls() == ["a"] and third == {"a": ("结论: 正确", False), "b": ("结论: 错误", True)}
    assert mine.open_claims().count() == 0
    assert {(r.run_id, r.task): r.status for r in mine.jobs().collect()} == {
        ("r1", "a"): "UNKNOWN", ("r1", "b"): "COMPLETED", ("r2", "a"): "UNKNOWN", ("r2", "b"): "COMPLETED", ("r3", "a"): "COMPLETED", ("r3", "b"): "COMPLETED"}


def test_a_later_attempt_calls_nobody(spark, counting, monkeypatch):
    judge, calls = counting

    class Again:
        @staticmethod
        def get():
            return type("Context", (), {"attemptNumber": lambda self: 1})()

    rows = spark.createDataFrame([("a", "1", "1")], ROWS)
    captured = {}
    monkeypatch.setattr(type(rows), "mapInPandas", lambda self, run, schema: captured.setdefault("run", run))
    monkeypatch.setattr(judge_store, "TaskContext", Again)
    judge(rows)
    monkeypatch.undo()
    import pandas as pd

    monkeypatch.setattr(judge_store, "TaskContext", Again)
    out = list(captured["run"](iter([pd.DataFrame({"task_id": ["a"], "final_answer": ["1"], "reference_answer": ["1"]})])))
    assert out[0]["judge_text"].tolist() == [None] and calls() == []


def test_empty_rows_and_repeated_tasks(spark, tmp_path, counting):
    judge, calls = counting
    mine = JudgeLedger(spark, str(tmp_path / "s"), "g", "m")
    none = spark.createDataFrame([], ROWS)
    assert mine.ask(none, judge, "r").count() == 0 and calls() == []

    def adapter(frames):
        for f in frames:
            yield f.assign(status="completed", answer="x", error=None)[["task_id", "status", "answer", "error"]]

    twice = spark.createDataFrame([("t", "p"), ("t", "p"), ("u", "q")], "task_id string, prompt string")
    assert sorted(r.task_id for r in workflow.once(twice, adapter, str(tmp_path / "once")).collect()) == ["t", "u"]


def test_one_run_claims_at_a_time(spark, tmp_path):
    inside, most = [0], [0]

    def work():
        with exclusive(spark, str(tmp_path / "lock"), pause=0.01):
            inside[0] += 1
            most[0] = max(most[0], inside[0])
            threading.Event().wait(0.05)
            inside[0] -= 1

    threads = [threading.Thread(target=work) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert most[0] == 1
    (tmp_path / "held").touch()
    with pytest.raises(TimeoutError), exclusive(spark, str(tmp_path / "held"), patience=0.1):
        pass
