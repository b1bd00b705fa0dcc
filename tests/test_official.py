"""The official grader's process, manifests of what was written, and canonical JSON."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from verdigris.functions import text
from verdigris.operators import ledger
from verdigris.sources import manifest, official

STAND_IN = '''
import json, os, struct, sys, time
def send(x):
    body = json.dumps(x).encode()
    sys.stdout.buffer.write(struct.pack(">I", len(body)) + body)
    sys.stdout.buffer.flush()
with open(sys.argv[2], "a") as log:
    log.write("started\\n")
if sys.argv[1] == "silent":
    time.sleep(60)
send({"commit": sys.argv[1]})
while len(head := sys.stdin.buffer.read(4)) == 4:
    asked = json.loads(sys.stdin.buffer.read(struct.unpack(">I", head)[0]))
    with open(sys.argv[2], "a") as log:
        log.write(asked["task_id"] + "\\n")
    if asked["response"] == "crash":
        print("out of memory", file=sys.stderr, flush=True)
        sys.exit(3)
    if asked["response"] == "hang":
        time.sleep(60)
    verdict = {"schema_version": "verdigris.official_report_verdict.v1", "upstream_commit": asked["required_upstream_commit"], "quality_score": 7.5, "quality_dimensions": {"depth": 8},
               "fact_ratio": None if asked["response"] == "no facts" else 0.5, "right_count": 1, "wrong_count": 1, "unknown_count": 0, "raw": {}}
    if asked["response"] == "odd":
        verdict["quality_score"] = 11
    if asked["response"] == "other":
        verdict["upstream_commit"] = "7654321"
    send(verdict)
'''


@pytest.fixture
def grader(tmp_path):
    (tmp_path / "stand_in.py").write_text(STAND_IN)
    log = tmp_path / "log"

    def command(commit="1234567"):
        return [sys.executable, str(tmp_path / "stand_in.py"), commit, str(log)]

    return command, lambda: log.read_text().split()


def test_two_scores_and_one_process_for_a_task(spark, grader):
    command, log = grader
    cases = [("a", "fine"), ("b", "crash"), ("c", "no facts"), ("d", "hang"), ("e", "odd"), ("f", "other"), ("g", "é" * 70000)]
    rows = spark.createDataFrame([(i, "q", x) for i, x in cases], "task_id string, prompt string, final_answer string").coalesce(1)
    judged = spark.createDataFrame(official.official_judge(command(), "1234567", timeout=2)(rows).toPandas())
    got = {(r.task_id, r.metric_id): (r.status, r.value) for r in official.official_scores(judged, "1234567").collect()}
    quality, facts = "official.quality_score", "official.fact_ratio"
    assert got["a", quality] == ("scored", 7.5) and got["a", facts] == ("scored", 0.5) == got["g", facts]
    assert got["c", facts] == ("not_observable", None) and got["c", quality] == ("scored", 7.5)
    assert all(got[i, m] == ("failed", None) for i in "bdef" for m in (quality, facts))
    why = {r.task_id: r.error for r in official.official_scores(judged, "1234567").collect()}
    assert "ended with 3: out of memory" in why["b"] and why["d"] == "no answer within 2 s" and "quality_score: out of range" in why["e"] and why["f"] == "unexpected upstream commit: 7654321"
    assert log() == ["started", "a", "b", "started", "c", "d", "started", "e", "f", "g"]


@pytest.mark.parametrize("commit, why", [("7654321", "the grader is of commit 7654321, 1234567 is required"), ("silent", "no answer within 1 s")])
def test_the_wrong_grader_gets_no_row(spark, grader, commit, why):
    command, log = grader
    rows = spark.createDataFrame([("a", "q", "x")], "task_id string, prompt string, final_answer string").coalesce(1)
    with pytest.raises(Exception, match=why):
        official.official_judge(command(commit), "1234567", start_timeout=1)(rows).collect()
    assert set(log()) == {"started"}


def test_manifest_finds_what_has_changed(spark, tmp_path):
    folder, sealed = tmp_path / "run (1)+", str(tmp_path / "sealed")
    (folder / "deep").mkdir(parents=True)
    for name in ("a.json", "b.json", "deep/c.txt"):
        (folder / name).write_text(f"content of {name}")
    manifest.seal(spark, str(folder), sealed)
    assert manifest.verify(spark, str(folder), sealed).count() == 0
    listed = {r.path: r.size_bytes for r in spark.read.json(sealed).collect()}
    assert listed == {n: len(f"content of {n}") for n in ("a.json", "b.json", "deep/c.txt")}
    (folder / "a.json").write_text("Content of a.json")
    (folder / "deep/c.txt").unlink()
    (folder / "new.json").write_text("new")
    assert {r.path: r.problem for r in manifest.verify(spark, str(folder), sealed).collect()} == {"a.json": "changed", "deep/c.txt": "missing", "new.json": "not listed"}
    with pytest.raises(FileExistsError):
        manifest.seal(spark, str(folder), sealed)


def test_lock(spark, tmp_path):
    path = str(tmp_path / "run.lock.json")
    first = manifest.lock(spark, path, "r1", {"b": 1, "a": ["é"]}, ["t1", "t2"], judge_profile="p")
    assert first["environment"]["spark"] == spark.version and first["sha256"].startswith("sha256:")
    assert manifest.lock(spark, path, "r1", {"a": ["é"], "b": 1}, ["t1", "t2"], judge_profile="p") == first == manifest.locked(spark, path)
    with pytest.raises(ValueError, match="another manifest"):
        manifest.lock(spark, path, "r1", {"b": 2}, ["t1"])
    (tmp_path / ".run.lock.json.crc").unlink()  # a local file system's own check
    (tmp_path / "run.lock.json").write_text((tmp_path / "run.lock.json").read_text().replace("t2", "t3"))
    with pytest.raises(ValueError, match="has been changed"):
        manifest.locked(spark, path)


def test_equal_objects_hash_alike(spark):
    alike = ['{"b":1,"a":{"z":1.0,"y":[{"d":1,"c":"\\u0041"}]}}', ' {"a" : {"y": [ {"c":"A", "d":1.00} ], "z":1}, "b":1}']
    apart = ['{"b":1,"a":{"z":1,"y":[{"d":"1","c":"A"}]}}', '{"b":1,"a":{"z":1,"y":[{"c":"A","d":1},{}]}}', '{"b":1,"a":{"y":[{"c":"a","d":1}],"z":1}}', "[]", "{}", "null", '""']
    rows = spark.createDataFrame([(x,) for x in alike + apart], "x string").select(text.hash_object(F.col("x")).alias("h")).collect()
    hashes = [r.h for r in rows]
    assert hashes[0] == hashes[1] and len(set(hashes)) == 1 + len(apart)
    none = spark.createDataFrame([("{",), ('{"a":1,"a":2}',), (None,)], "x string").select(text.hash_object(F.col("x")).alias("h")).collect()
    assert [r.h for r in none] == [None] * 3
    maps = spark.createDataFrame([({"a": 1, "b": 2},), ({"b": 2, "a": 1},)], "m map<string,int>")
    assert maps.select(ledger.cache_key(F.lit("g").alias("g"), F.col("m")).alias("k")).distinct().count() == 1
