"""Many strings in many texts, held against Python's `in`."""

import random
from collections import Counter

from verdigris.operators import leaks, matching


def test_strings_in_texts(spark, monkeypatch):
    rng = random.Random(1)
    letters = "ab cé😀\n"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [some(rng.randrange(0, 80)) for _ in range(150)] + [None, "", "a" * 5000]
    strings = [some(rng.randrange(1, 6)) for _ in range(60)] + [texts[3][5:40], texts[4], "a" * 100, "a" * 100, "a" * 5001, None, "", "é"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "d int, t string, s string").repartition(3)
    items = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(strings)], "i string, a string")
    expected = Counter((d, f"s{i}") for d, t in enumerate(texts) for i, s in enumerate(strings) if t and s and s in t)
    got = lambda **sizes: Counter((r.d, r.i) for r in matching.contained(docs, items, "t", "i", "a", "d", **sizes).collect())
    assert got() == expected and len(expected) > 1000
    assert got(part_bytes=200) == expected and got(part_states=50) == expected  # in many parts
    monkeypatch.setattr(matching, "PREFIX", 2)
    assert Counter((d, f"s{i}") for d, t in enumerate(texts) for i in matching.rows_found(matching.automaton([s or "\0" for s in strings]), t or "")) == expected


def test_no_explode_and_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "the answer is forty two"), (1, "the answer is forty two"), (2, " ")], "d int, t string")
    items = spark.createDataFrame([(7, "forty two"), (8, " "), (9, None)], "i long, a string")
    found = leaks.corpus_leaks(docs, items, "d", "t", "i", "a")
    assert found.dtypes == [("d", "int"), ("i", "bigint")]
    assert Counter(map(tuple, found.collect())) == {(1, 7): 2}  # blank answers leak nothing, repeated rows repeat
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "Join" not in plan
    assert leaks.corpus_leaks(docs, items.where("false"), "d", "t", "i", "a").count() == 0


def test_markers(spark):
    rows = spark.createDataFrame([("t1", '{"x": {"reference_answer": 1}, "y": "JUDGE_PROMPT"}'), ("t2", "judge_prompt"), ("t3", None)], "task_id string, raw string")
    assert sorted(map(tuple, leaks.leaked_markers(rows, "raw").collect())) == [("t1", "JUDGE_PROMPT"), ("t1", "reference_answer")]
