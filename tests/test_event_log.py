"""Appending to a numbered log: numbers go on, replays change nothing, lost batches leave nothing."""

import random

import pytest
from pyspark.sql import functions as F

from verdigris.plans import event_log
from verdigris.plans.event_log import EventLog

EVENT = "event_id long, run_id string, case_id string, attempt_id string, created_at long, event_type string"


def some_events(n, seed=1):
    rng = random.Random(seed)
    return [(i, "r", rng.choice(["a", "b", "c", None, None, None]), rng.choice(["1", None]), i // 3, "TRANSITION") for i in range(n)]


def numbers(rows):
    seen, out = {}, {}
    for e in sorted(rows, key=lambda e: (e[4], e[0])):
        key = e[1:4]
        out[e[0]] = seen.get(key, -1) + 1
        seen[key] = out[e[0]]
    return out


def test_numbers_go_on(spark, tmp_path):
    rows = some_events(300)
    frame = lambda some: spark.createDataFrame(some, EVENT).repartition(3)
    kept = EventLog(spark, str(tmp_path / "log"))
    assert kept.batches() == [] and kept.last() is None
    with pytest.raises(ValueError, match="no batch"):
        kept.read()
    assert kept.append(frame(rows[:100]), "1") == 100
    assert kept.append(frame(rows[100:200] + rows[150:160]), "2") == 100  # repeated in the batch
    assert kept.append(frame(rows[100:200]), "2") == 0  # the batch again
    assert kept.append(frame(rows[50:120]), "3") == 0  # its events again, under another id
    assert kept.append(frame(rows[190:]), "4") == 100
    assert kept.append(frame(rows).limit(0), "5") == 0
    found = kept.read()
    assert {r.event_id: r.seq for r in found.collect()} == numbers(rows) and found.count() == 300
    heads = {tuple(r)[:3]: r["last"] for r in kept.last().collect()}
    assert heads == {k: max(numbers(rows)[e[0]] for e in rows if e[1:4] == k) for k in {e[1:4] for e in rows}}


def test_a_lost_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    rows = some_events(60)
    kept = EventLog(spark, str(tmp_path / "log"))
    kept.append(spark.createDataFrame(rows[:20], EVENT), "1")
    monkeypatch.setattr(event_log, "touch", lambda *a: (_ for _ in ()).throw(OSError("lost before its commit")))
    with pytest.raises(OSError, match="lost"):
        kept.append(spark.createDataFrame(rows[20:40], EVENT), "2")
    monkeypatch.undo()
    assert kept.read().count() == 20
    assert kept.append(spark.createDataFrame(rows[20:], EVENT), "2") == 40
    assert {r.event_id: r.seq for r in kept.read().collect()} == numbers(rows)
    with pytest.raises(Exception, match="an event has no id"):
        kept.append(spark.createDataFrame([(None, *rows[0][1:])], EVENT), "3")


def test_recovery_events(spark):
    cases = spark.createDataFrame([(i, "SUBMISSION_UNCONFIRMED") for i in range(5)] + [(9, "DONE")], "case_id int, status string")
    results = spark.createDataFrame([(0, True, "completed", "x"), (1, True, "timeout", None), (2, True, "completed", None), (3, False, None, None), (9, True, "completed", "x")], "case_id int, found boolean, result string, answer string")
    now, events, counts = event_log.recovery(cases, results)
    assert {r.case_id: r.status for r in now.collect()} == {0: "READY_FOR_GRADING", 1: "TIMED_OUT", 2: "COLLECTION_FAILED", 3: "SUBMISSION_UNCONFIRMED", 4: "SUBMISSION_UNCONFIRMED", 9: "DONE"}
    assert tuple(counts.first()) == (1, 1, 2)
    walk = [(r.step, r.to) for r in events.where("case_id = 0").select("step", F.get_json_object("payload_json", "$.to").alias("to")).orderBy("step").collect()]
    assert [to for _, to in walk] == ["SUBMITTED", "RUNNING", "COMPLETED", "COLLECTED", "NORMALIZED", "READY_FOR_GRADING"]
    assert events.count() == 6 + 3 + 3


def test_citation_refresh(spark):
    cases = spark.createDataFrame([(i, "READY_FOR_GRADING") for i in range(5)] + [(9, "DONE")], "case_id int, status string")
    old = spark.createDataFrame([(i, "the  answer\n") for i in range(10)], "case_id int, answer string")
    found = [(0, True, "completed", "the  answer", ["a", "b"]), (1, True, "completed", "the  answer", []), (2, True, "completed", "another", ["a"]), (3, False, None, None, None), (4, True, "timeout", None, None), (9, True, "completed", "the  answer", ["a"])]
    events, counts = event_log.citation_refresh(cases, old, spark.createDataFrame(found, "case_id int, found boolean, result string, answer string, citations array<string>"))
    assert {(r.case_id, r.event_type, r.payload_json) for r in events.collect()} == {
        (0, "CITATIONS_REFRESHED", '{"citation_count":2}'), (1, "CITATIONS_REFRESHED", '{"citation_count":0}'),
        (2, "CITATION_REFRESH_FAILED", '{"message":"Answer changed while refreshing citations for 2"}')}
    assert tuple(counts.first()) == (1, 1, 1, 2)
