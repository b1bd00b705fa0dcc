"""Importance resampling, hard negatives and the chosen-path join, held against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import common, minhash, negatives, resampling, simhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t", "a", "A b", "one two three", "Σας É ß z", "x" * 5000 + " y" * 50, "a-b_c d9 \x00 é\x7f", "same text again " * 8, "same text again " * 8]


def brute_features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, n_buckets=10000, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    found = [(i, *brute_features(t)) for i, t in docs]
    source, wanted = Counter(bucket(f) for _, _, fs in found for f in fs), Counter(bucket(f) for t in target for f in brute_features(t)[1])
    S, T = source.total(), wanted.total()
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (S + n_buckets) / ((source[b] + 1) * (T + n_buckets))))
    rows = []
    for i, n, fs in found:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return Counter((*r[:1], *r[2:], next((k + 1 for k, d in enumerate(drawn) if d is r), None)) for r in rows)


def some_texts(rng, n, vocabulary=300):
    return [" ".join(rng.choice(["Word", "w", "é"]) + str(rng.randrange(vocabulary)) for _ in range(rng.choice([3, 19, 20, 60]))) for _ in range(n)]


def found(frame):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in frame.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_resampling_equals_brute_force(spark, make, seed):
    rng = random.Random(seed)
    texts = some_texts(rng, 400) + ODD
    docs, target = list(enumerate(texts)), some_texts(rng, 30, 60) + [None, ""]
    got = found(resampling.resample(make(docs, 5), spark.createDataFrame([(t,) for t in target], "text string")))
    assert got == brute_resample(docs, target)
    assert sum(1 for r in got if r[4] is not None) > 5


def test_resampling_edges(spark, make, edges):
    none = spark.createDataFrame([], "text string")
    docs = edges + [(None, "many words of a row without id " * 9)] * 2 + [(i, f"number {i} " * 15) for i in range(50)]
    assert found(resampling.resample(make(docs), none)) == brute_resample(docs, [])
    assert resampling.resample(make([]), none).count() == 0
    clashing = make(docs).withColumnRenamed("lang", "score").withColumnRenamed("source", "rank").withColumnRenamed("n_chars", "weight")
    assert found(resampling.resample(clashing, none)) == brute_resample(docs, [])


def test_resampling_in_small_parts(monkeypatch):
    texts = [t if t is None else t.encode() for t in some_texts(random.Random(3), 40) + ODD]
    collect = lambda: Counter((int(r), int(b)) for x in resampling.features(texts, resampling.Words(), 10000, 3) if isinstance(x, tuple) for r, b in zip(*x, strict=True))
    whole = collect()
    monkeypatch.setattr(resampling, "AT_ONCE", 7)
    assert collect() == whole
    known = resampling.Words()
    monkeypatch.setattr(resampling, "MOST_WORDS", 3)  # the cache is emptied between texts
    parts = Counter()
    for at, t in enumerate(texts):
        parts.update((at, int(b)) for x in resampling.features([t], known, 10000, 3) if isinstance(x, tuple) for b in x[1])
    assert parts == whole


VECTORS = "vec_id long, embedding array<float>, label long"


def brute_negatives(rows, every=50, k=5, k_negative=3):
    good = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, a, c in good:
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b, strict=False)), j, d) for j, b, d in good]
        for s, j, _ in sorted((-0 + s, j, d) for s, j, d in scored if d == c and j != i)[:k]:
            fits = sorted((t, n) for t, n, d in scored if d != c and 50 * -s <= 100 * -t <= 95 * -s)
            for rank, (t, n) in enumerate(fits[:k_negative]):
                out[i, j, rank + 1, n, -s, -t] += 1
    return out


def mined(spark, rows, **options):
    frame = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0, **options)
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in frame.collect())


def some_vectors(seed, n, dims=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dims))
    return [(i, [float(np.float32(x)) for x in base[rng.integers(6)] + rng.normal(size=dims) * 0.6], int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("cells", [2, 5, 64, 256])
def test_negatives_equal_brute_force(spark, cells):
    rows = some_vectors(cells, 600)
    expected = brute_negatives(rows)
    assert len(expected) > 50 and mined(spark, rows, cells=cells) == expected


def test_negatives_over_many_tiles(spark, monkeypatch):
    for name, value in {"CHUNK_ANCHORS": 4, "LEAST_ROWS": 40, "AT_ONCE_ROWS": 7, "AT_ONCE_ANCHORS": 2}.items():
        monkeypatch.setattr(negatives, name, value)
    rows = some_vectors(9, 500)
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_edges(spark):
    v = [0.5, -0.25, 1.0]
    rows = [(None, v, 1), (1, None, 1), (2, v, None), (3, [0.5, None, 1.0], 1), (4, [0.5, math.nan, 1.0], 1), (5, [math.inf, 0.0, 0.0], 1),  # none of them takes part
            (0, v, 1), (50, v, 1), (100, v, 2), (100, v, 2), (6, v, 1), (6, v, 1), (7, [0.5], 2), (8, [], 2), (9, [0.4, -0.25, 0.9], 2), (10, [0.4, -0.25, 0.9], 3), (11, [-0.5, 0.25, -1.0], 1), (150, [0.0, 0.0, 0.0], 1), (12, [0.0] * 3, 5)]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, []) == Counter()
    assert mined(spark, [(0, v, 1), (1, v, 2)]) == Counter()  # no positive
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == brute_negatives([(0, [], 1), (1, [], 1), (2, [], 2)])
    frame = spark.createDataFrame([(i, x, c, 1, 2) for i, x, c in rows], VECTORS + ", at int, cells int")
    assert negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0).count() == sum(mined(spark, rows).values())


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x, anchors = rng.integers(-90, 90, (400, 16)), rng.integers(-90, 90, (6, 16))
    edges = np.concatenate([x.min(0)[None], np.sort(x, axis=0)[np.arange(1, 32) * 400 // 32], x.max(0)[None] + 1]).T
    codes = np.stack([np.searchsorted(edges[d, 1:-1], x[:, d], side="right") for d in range(16)], axis=1).astype(np.uint8)
    low, high = negatives.bounds(codes, anchors, edges)
    exact = x @ anchors.T
    assert (low <= exact).all() and (exact <= high).all()
    reach = negatives.kth_largest(low, 5)
    assert ((high >= reach).sum(0) < 120).all()  # most rows are ruled out by their bounds


def word_sets(docs):
    out = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        out[i] = {b" ".join(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {b" ".join(w)} - {b""}
    return out


def brute_classes(docs):
    sets = word_sets(docs)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def text(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**9)}"
    return out


def near_groups(seed):
    """Groups around one base each, with edits that put many pairs close to the threshold; some words upper-cased."""
    rng, docs = random.Random(seed), []
    for _ in range(25):
        base = text(rng, rng.choice([5, 60, 150]))
        docs += [base, *(edited(rng, base, rng.randrange(0, max(1, len(base) // 12))) for _ in range(rng.choice([0, 1, 4, 9])))]
    docs = [" ".join(w.upper() if rng.random() < 0.1 else w for w in d) for d in docs]
    rng.shuffle(docs)
    return list(enumerate(docs))


def dedup(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chosen_path_join_equals_brute_force(spark, make, seed):
    docs = near_groups(seed)
    assert dedup(minhash.near_duplicates(make(docs))) == brute_classes(docs)


def test_large_nodes_branch(spark, make, monkeypatch):
    """With nodes of 3 points at most everything shared goes down the levels, and what is left on the last one to the prefix join."""
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "MOST_WALKERS", 30)
    rng = random.Random(7)
    base = text(rng, 120)
    docs = list(enumerate([" ".join(edited(rng, base, rng.randrange(2, 9))) for _ in range(60)])) + [(i + 60, t) for i, t in near_groups(8)]
    for levels in (1, 3, 6):
        monkeypatch.setattr(minhash, "LEVELS", levels)
        assert dedup(minhash.near_duplicates(make(docs))) == brute_classes(docs)


def test_chosen_path_edges(spark, make, edges):
    docs = [*edges, (None, "another text that has no id"), (None, "lonely text that has no id either"), (20, "Null ID text"), (21, "\x1c a"), (22, " a")]
    rows = minhash.near_duplicates(make(docs).withColumnRenamed("lang", "kept").withColumnRenamed("source", "component")).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in docs)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [(by[i].n_shingles, by[i].component_id, by[i].kept) for i in (1, 2, 3, 4, 5, 6, 7, 20)] == [
        (0, 1, True), (0, 2, True), (0, 3, True), (1, 4, True), (2, 5, True), (2, 5, False), (1, 7, True), (1, 20, True)]
    assert Counter((r.component_id, r.kept) for r in rows if r.doc_id is None) == Counter({(20, False): 1, (None, True): 2})
    assert minhash.near_duplicates(make([])).count() == 0


def test_recall_of_trees():
    """Pairs of sets at 0.85 to 0.87: on the fourth level of the trees, that many share a node."""
    rng = np.random.default_rng(4)
    shared = 0
    with np.errstate(over="ignore"):
        for _ in range(300):
            both, one, two = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (172, 14, 14))
            nodes = []
            for own in (one, two):
                least, at, level = minhash.minima(np.concatenate([both, own])), np.zeros(0, int), minhash.ROOTS
                for _ in range(4):
                    _, level = minhash.branches(level, np.broadcast_to(least, (len(level), minhash.MINIMA)))
                nodes.append(set(level.tolist()))
            shared += bool(nodes[0] & nodes[1])
    assert shared == 300


def test_sketches_keep_pairs_at_the_threshold():
    rng, differ = np.random.default_rng(6), []
    with np.errstate(over="ignore"):
        for _ in range(400):
            both, one, two = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (170, 15, 15))
            a, b = (np.array(minhash.sketched(minhash.minima(np.concatenate([both, own]))), np.int64).view(np.uint64) for own in (one, two))
            differ.append(int(minhash.differing([a[i : i + 1] for i in range(4)], [b[i : i + 1] for i in range(4)])[0]))
    assert max(differ) < minhash.OUT and 12 < np.mean(differ) < 17


def test_packed_sets():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (simhash.unpacked(simhash.packed(x)) == x >> np.uint64(16)).all()
    assert len(simhash.unpacked(simhash.packed(x[:0]))) == 0


def test_hot_shingles_are_compared_in_chunks(spark, monkeypatch):
    """All sets share their rarest shingle: chunks find what the whole key finds."""
    common.bounded_batches(spark)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(40)[:38]], rng.integers(0, 1 << 63, 3).astype(np.uint64)])) for _ in range(80)]
    rows = spark.createDataFrame([(i, bytearray(simhash.packed(s))) for i, s in enumerate(sets)], "node long, shingles binary")
    members = spark.createDataFrame([(i, i) for i in range(80)], "node long, component long")
    whole = Counter((r.u, r.v) for r in simhash.prefix_pairs(members, rows).collect())
    monkeypatch.setattr(simhash, "MOST_POSTS", 10)
    assert Counter((r.u, r.v) for r in simhash.prefix_pairs(members, rows).collect()) == whole
    assert len(whole) > 50 and max(whole.values()) == 1
