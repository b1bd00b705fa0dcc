"""Operators over whole tables, held against brute force."""

import functools
import hashlib
import math
import numbers
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from verdigris.llm import chat, common, components, lm, queries, simhash, spotsigs, substring, urls, warc
from verdigris.storage import materialize, shared_dir
from verdigris.tables import NAMES


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near_corpus(seed=1):
    rng = random.Random(seed)
    docs = []
    for i in range(60):
        base = words(rng, rng.choice([4, 40, 200]), 3000).split()
        docs.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 8])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            docs.append(" ".join(copy))
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(i, docs[j]) for i, j in enumerate(order)]


def classes(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def fingerprint(text):
    w = [x for x in (text or "").encode().lower().split()]
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query(spark, table_dir):
    docs = [*near_corpus(), (9001, None), (9002, ""), (9003, " \n")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, table_dir(docs)).collect()}
    fp = {i: fingerprint(t) for i, t in docs}
    expected = classes(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert got == {i: (f"{fp[i]:016x}", expected[i]) for i in fp}


def test_simhash_edges(spark, make, edges):
    rows = simhash.near_duplicates(make(edges)).collect()
    assert len(rows) == len(edges)
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("twice", [False, True, "chunks"])
def test_trie_walk_finds_all_pairs(spark, k, twice, monkeypatch):
    rng = np.random.default_rng(k)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 300)]
    for _ in range(5):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) * rng.integers(0, 2, 300).astype(np.uint64)
    points = np.unique(np.concatenate([base, near]))
    monkeypatch.setattr(simhash, "CROWDED", 0 if twice else 2000)
    if twice == "chunks":
        monkeypatch.setattr(simhash, "CROWDED", 2000)
        monkeypatch.setattr(simhash, "MOST_POINTS", 12)
    frame = spark.createDataFrame([(i, simhash.signed(int(x))) for i, x in enumerate(points)], "node long, fp long")
    links = [(r.u, r.v) for r in simhash.links(frame, k).collect()]
    expected = [(a, b) for a in range(len(points)) for b in range(a) if int(points[a] ^ points[b]).bit_count() <= k]
    assert classes(range(len(points)), links) == classes(range(len(points)), expected)
    key = np.zeros(len(points), np.int64)
    walked = {(int(max(a, b)), int(min(a, b))) for x, y in simhash.walk(key, points, k, at_once=50) for a, b in zip(x, y, strict=True)}
    assert walked == set(expected)


@pytest.mark.parametrize("seed", range(6))
def test_trie_walk_with_guards_links_what_all_pairs_link(seed):
    """Equal and near points of one key, in a few parts at a time: the forest has the classes of brute force, and only links that hold."""
    rng = np.random.default_rng(seed)
    n, k, within = 200, seed % 5, 1 + seed % 2
    fp = rng.integers(0, 1 << 63, 4, dtype=np.uint64)[rng.integers(0, 4, n)]
    for _ in range(seed):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * rng.integers(0, 2, n).astype(np.uint64)
    guard, key = rng.integers(0, 1 << 8, n).astype(np.uint64), rng.integers(0, 3, n)
    order = np.lexsort((fp, key))
    fp, guard, key, node = fp[order], guard[order], key[order], rng.permutation(n)
    found = simhash.Forest(node)
    for a, b in simhash.walk(key, fp, k, at_once=20, label=found.label):
        near = np.bitwise_count(guard[a] ^ guard[b]) <= within
        found.add(a[near], b[near])
    expected = [
        (int(node[i]), int(node[j])) for i in range(n) for j in range(i)
        if key[i] == key[j] and int(fp[i] ^ fp[j]).bit_count() <= k and int(guard[i] ^ guard[j]).bit_count() <= within
    ]
    edges = list(zip(*(x.to_pylist() for x in found.edges().columns), strict=True))
    assert classes(range(n), edges) == classes(range(n), expected)
    assert set(map(frozenset, edges)) <= set(map(frozenset, expected))


def test_a_large_group_of_near_copies_is_not_paired():
    """5,000 points that are all linked: some compared pairs for each, not thousands."""
    rng = np.random.default_rng(0)
    flips = [np.uint64(1) << rng.integers(0, 64, 5000).astype(np.uint64) for _ in range(2)]
    fp = np.sort(np.uint64(12345) ^ flips[0] ^ flips[1])
    found, pairs = simhash.Forest(np.arange(5000)), 0
    for a, b in simhash.walk(np.zeros(5000, np.int64), fp, 4, label=found.label):
        pairs += len(a)
        found.add(a, b)
    assert len(found.kept) == 4999 and pairs < 50 * 5000


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3)]
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components.components(frame).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 7 for i in range(200, 260)}}


def test_near_texts(spark, make):
    rng = random.Random(8)
    base = [words(rng, 300, 100000).split() for _ in range(30)]
    docs = [" ".join(b) for b in base]
    for b in base[:20]:
        copy = list(b)
        for _ in range(3):
            copy[rng.randrange(300)] = "changed"
        docs.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in simhash.near_texts(make(list(enumerate(docs)))).collect()}
    assert sum(got[30 + i] == i for i in range(20)) >= 18
    assert all(got[i] == i for i in range(30))


def five_words(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def alike_exactly(a, b):
    a, b = five_words(a), five_words(b)
    return not (a or b) or 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("seed", [0, 1])
def test_near_texts_equals_brute_force(spark, make, seed):
    """One replaced block, an appended tail and scattered edits, at similarities around 0.8 from 0.70 to 0.95."""
    rng = random.Random(seed)
    docs = []
    for i in range(150):
        base, n = words(rng, 200, 100000).split(), 200
        docs.append(" ".join(base))
        aim = rng.uniform(0.70, 0.95)
        if i % 3 == 0:  # (196 - n) / (196 + n) shingles stay
            m = round(196 * (1 - aim) / (1 + aim)) - 4
            docs.append(" ".join([*base[:50], *words(rng, m, 100000).split(), *base[50 + m :]]))
        elif i % 3 == 1:
            docs.append(" ".join([*base, *words(rng, round(196 / aim) - 196, 100000).split()]))
        else:
            copy = list(base)
            for _ in range(round(196 * (1 - aim) / (1 + aim) / 5)):
                copy[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            docs.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in simhash.near_texts(make(list(enumerate(docs)))).collect()}
    linked = [(i, j) for i in range(len(docs)) for j in range(i) if alike_exactly(docs[i], docs[j])]
    assert 50 < len(linked) < 140
    assert got == classes(range(len(docs)), linked)


def test_near_texts_in_one_key(spark, make):
    """A chain of texts, each alike its neighbours only: links between later texts are not lost with a failed first one."""
    rng = random.Random(5)
    stream = words(rng, 800, 100000).split()
    docs = [" ".join(stream[i : i + 200]) for i in range(0, 600, 10)] + ["", " ", "few words", "Few  words"]
    got = {r.doc_id: r.component_id for r in simhash.near_texts(make(list(enumerate(docs)))).collect()}
    linked = [(i, j) for i in range(len(docs)) for j in range(i) if alike_exactly(docs[i], docs[j])]
    assert got == classes(range(len(docs)), linked)


def test_prefix_pairs_lose_no_link(spark):
    """A base that all share, with more or fewer of their own: all alike pairs of two components, and hardly any that are far apart."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    sets = [np.empty(0, np.uint64), base[:1], base[:4], base[:5]]
    for _ in range(120):
        kept = base[rng.permutation(150)[: rng.integers(120, 151)]]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, rng.integers(0, 50)).astype(np.uint64)])))
    component = [i % 40 for i in range(len(sets))]
    rows = spark.createDataFrame([(i, bytearray(simhash.packed(np.sort(x)))) for i, x in enumerate(sets)], "node long, shingles binary")
    members = spark.createDataFrame(list(enumerate(component)), "node long, component long")
    common.bounded_batches(spark)
    got = {(r.u, r.v) for r in simhash.prefix_pairs(members, rows).collect()}
    close = lambda u, v, least: len(both := set(sets[u].tolist()) & set(sets[v].tolist())) >= least * max(1, len(sets[u]) + len(sets[v]) - len(both))
    other = [(u, v) for u in range(len(sets)) for v in range(u) if component[u] != component[v]]
    near = {p for p in other if close(*p, 0.8)}
    assert len(near) > 100 and near <= got
    assert got <= set(other) and len(got) < len(other) / 2


def test_near_copies_are_dropped_by_row(spark, make):
    """Rows that share an id but no text both stay, a copy goes whatever its id, and null ids are treated alike."""
    rng = random.Random(9)
    a, b, c, d = (words(rng, 100, 100000) for _ in range(4))
    docs = [(1, a), (2, a + " tail"), (2, b), (3, c), (3, c), (None, c), (None, d), (None, d), (4, b)]
    for parts in (1, 3):
        kept = corpus_pipeline.drop_near_copies(spark, make(docs, parts), "")
        assert kept.columns == corpus_pipeline.COLUMNS
        assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", a), ("2", b), ("3", c), ("None", d)])


def brute_substrings(docs, n=20):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            g = tuple(w[s : s + n])
            if g in seen:
                gone[s : s + n] = [True] * n
            seen.add(g)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_query(spark, table_dir, monkeypatch, seed):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(substring, "BUCKET_ROWS", 2000)
    rng = random.Random(seed)
    shared = [words(rng, n, 5000) for n in (19, 20, 21, 35, 60)]
    docs = []
    for i in range(80):
        parts = [words(rng, rng.randrange(0, 60), 5000) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(shared))
        docs.append((i * 3, "\n".join(parts)))
    docs += [(1001, docs[5][1]), (1002, "loop it " * 40), (1003, None), (1004, ""), (1005, "tiny")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op5_substring_dedup(spark, table_dir(docs)).collect()}
    assert got == brute_substrings(docs)
    assert sum(x[1] for x in got.values()) > 100


def test_substring_edges(spark, make, edges):
    rows = substring.repeats(make(edges)).collect()
    assert len(rows) == len(edges)
    long = next(r for r in rows if r.doc_id == 7)
    assert (long.n_words, long.n_removed, long.removed_spans) == (3000, 2999, [[1, 3000]])
    assert next(r for r in rows if r.doc_id == 1).text is None
    assert substring.repeats(make([])).count() == 0
    clash = make([(1, "a b")]).withColumnRenamed("lang", "n_words")
    assert substring.repeats(clash).columns.count("n_words") == 1


def test_lm_scores(spark, make, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm, "BUCKET_ROWS", 300)
    rng = random.Random(6)
    docs = [(i, words(rng, rng.randrange(0, 40), 30)) for i in range(50)] + [(50, None), (51, "only once")]
    for order in (1, 2, 3):
        counts = Counter(tuple(w[i : i + n]) for _, t in docs for w in [(t or "").split()] for n in range(1, order + 1) for i in range(len(w) - n + 1))
        total = sum(c for g, c in counts.items() if len(g) == 1)
        got = {r.doc_id: r for r in lm.scores(make(docs), order=order).collect()}
        for i, t in docs:
            w, expected = (t or "").split(), 0.0
            for p in range(len(w)):
                back = 1.0
                for n in range(min(order, p + 1), 0, -1):
                    g = tuple(w[p - n + 1 : p + 1])
                    if n == 1:
                        expected += math.log(back * counts[g] / total)
                    elif counts[g] >= lm.MIN_COUNT:
                        expected += math.log(back * counts[g] / counts[g[:-1]])
                        break
                    else:
                        back *= lm.ALPHA
            assert got[i].n_words == len(w) and got[i].logprob == pytest.approx(expected, abs=1e-9)
    assert lm.scores(make([])).count() == 0


def spot_signatures(text):
    """The signatures of a text by the module's words, one word at a time."""
    m = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
        return x ^ x >> 31

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    bare = [w for w in re.split("[ \t\n\x0b\x0c\r]+", "".join(c for c in lower if not (c.isascii() and c.isprintable() and not c.isalnum() and c != " "))) if w]
    if not bare:
        return {xxhash.xxh64_intdigest(text.encode()) >> 32} if (text or "").strip(" \t\n\x0b\x0c\r") else set()
    h = [xxhash.xxh64_intdigest(w.encode()) for w in bare]
    chains = []
    for i, w in enumerate(bare):
        if w in spotsigs.ANCHORS:
            after = [h[j] for j in range(i + 1, len(bare)) if bare[j] not in spotsigs.ANCHORS][:2]
            if len(after) == 2:
                chains.append((h[i], after))
        if h[i] % 4 == 0 and i + 2 < len(bare):
            chains.append((h[i] + 1 & m, h[i + 1 : i + 3]))
    hashed = lambda start, rest, add=0: mixed((lambda x: x + add & m)(functools.reduce(lambda x, y: mixed(x) + y & m, rest, start))) >> 32
    out = {hashed(a, rest) for a, rest in chains}
    if len(out) < 8:
        size = min(3, len(bare))
        out |= {hashed(h[i], h[i + 1 : i + size], 1) for i in range(len(bare) - size + 1)}
    return out


SPOTS = ["", "  ", "!!!", "the", "The cat, the DOG and a mouse", "no anchors here whatsoever today", "der Hund und die Katze sind nicht im Haus", "é É the É x y", "a b c d e f g h " * 20, "the the the end of it all", "\x1c the-cat sat\x85on"]


def test_signatures_word_by_word():
    rng = random.Random(8)
    some = SPOTS + [" ".join(rng.choice(["the", "and", "Der", "x1", "cat", "dog.", "(y)", "zu", f"w{rng.randrange(99)}"]) for _ in range(rng.randrange(80))) for _ in range(150)]
    with np.errstate(over="ignore"):
        for t in some:
            assert set(spotsigs.signatures(t.encode(), spotsigs.WordHashes()).tolist()) == spot_signatures(t), t


def test_spot_query_equals_brute_force(spark, table_dir):
    """Fingerprints, edits and likenesses from signatures taken word by word."""
    rng = random.Random(3)
    texts = [*SPOTS, None, *(" ".join(rng.choice(["the", "and", "cat", "é", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(60))) for _ in range(60))]
    docs = {i * 3: t for i, t in enumerate(texts)}
    got = {r.doc_id: r for r in spotsigs.op10_spotsigs(spark, table_dir(list(docs.items()))).collect()}
    likeness = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    order = sorted(docs, reverse=True)
    for at, i in enumerate(order):
        text, following = docs[i] or "", docs[order[(at + 1) % len(order)]] or ""
        changed = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        mine, other, after = (spot_signatures(x) for x in (text, changed, following))
        assert (set(spotsigs.decoded(got[i].fingerprint).tolist()), set(spotsigs.decoded(got[i].edited_fingerprint).tolist())) == (mine, other)
        assert (got[i].near_edited, got[i].near_next) == (pytest.approx(likeness(mine, other)), pytest.approx(likeness(mine, after)))


@pytest.mark.parametrize("most", [4096, 6])
def test_spot_classes(spark, make, monkeypatch, most):
    """Brute force over signatures taken word by word; with chunks of a few posts, too, and rows with nulls, blanks and repeats."""
    monkeypatch.setattr(simhash, "MOST_POSTS", most)
    docs = near_corpus(3) + [(7000, ""), (7001, None), (7002, "  "), (7003, "near the end"), (7003, "near the end")]
    got = {r.doc_id: r.component_id for r in spotsigs.near_pairs(make([*docs, (None, "near the end"), (None, "alone without any id")]).withColumnRenamed("lang", "component")).collect()}
    sig = {i: spot_signatures(t) for i, t in docs}
    linked = [(a, b) for a in sig for b in sig if a < b and len(sig[a] & sig[b]) >= 0.8 * len(sig[a] | sig[b])]
    assert got.pop(None) in (7003, None) and got == classes(sig, linked)
    assert spotsigs.near_pairs(make([])).count() == 0


CHAT = "conv_id long, seq long, message long, kind string, role string, text string"


def test_fold_and_round_trip(spark):
    events = [
        (1, 0, 0, "message", "user", "a<|im_end|>b<\\|c"), (1, 1, 1, "open", "assistant", None), (1, 2, 1, "delta", None, "one "), (1, 3, 1, "delta", None, "two"),
        (1, 4, 2, "message", "user", "more"), (1, 5, 3, "message", "assistant", "later"), (1, 6, 1, "regenerate", None, None), (1, 7, 1, "delta", None, "new"),
        (1, 8, 4, "message", "system\n%", "<|im_start|>x"), (2, 0, 0, "message", "assistant", "x"), (2, 1, 0, "edit", None, "y"), (2, 2, 0, "delta", None, "z"),
        (None, 0, 0, "message", None, None),
    ]
    shuffled = list(events)
    random.Random(1).shuffle(shuffled)
    got = {r.conv_id: r for r in chat.parse(chat.render(chat.fold(spark.createDataFrame(shuffled, CHAT)))).collect()}
    turns = lambda i: [(t.role, t.text) for t in got[i].turns]
    assert turns(1) == [("user", "a<|im_end|>b<\\|c"), ("assistant", "new"), ("system\n%", "<|im_start|>x")]
    assert got[1].loss_texts == ["new"] and turns(2) == [("assistant", "yz")] and turns(None) == [("", "")]
    assert got[1].formatted.count(chat.START) == 3
    empty = spark.createDataFrame([], CHAT)
    assert chat.parse(chat.render(chat.fold(empty))).count() == 0


def test_url_judge(spark):
    pages = [
        (1, "http://A.Example.com/en/x"), (2, "https://www.example.com/en/"), (3, "http://example.com"), (4, "http://x.net/es/1"), (5, "http://bad.org/p/?utm_source=1#x"),
        (6, "https://www.bad.org/p"), (7, None), (8, "no scheme"), (9, "http://x.comm/"), (10, "http://ok.org/?a=1&ref=2"), (10, "http://ok.org/?a=1&ref=2"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    listed = spark.createDataFrame([("bad.org/p",)] + [(f"other{i}.org/x",) for i in range(500)] + [(None,)], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame, listed, urls.RULES).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[3] == ("example.com", "", None, "allow")
    assert got[4][2:] == ("net/es/", "block") and got[5][3] == got[6][3] == "block"
    assert got[7] == got[8] == ("", "", None, "allow") and got[9][2] is None and got[10][3] == "allow"
    assert urls.judge(frame, listed, urls.RULES).count() == len(pages)
    none = listed.where("false")
    assert {r.verdict for r in urls.judge(frame.where("page_id = 5"), none, urls.RULES).collect()} == {"allow"}


def test_bloom_has_no_false_negatives(spark):
    listed = spark.range(3000).selectExpr("concat('h', id, '.org/') AS canonical")
    n = urls.blocks_for(3000)
    block, masks = urls.masks("canonical", urls.F.lit(n))
    met = listed.select(block.alias("b"), *[m.alias(f"m{i}") for i, m in enumerate(masks)]).join(urls.bloom(listed, n), urls.F.col("b") == urls.F.col("block"))
    assert met.where(" and ".join(f"(w{i} & m{i}) = m{i}" for i in range(4))).count() == 3000


def test_warc_round_trip(spark, tmp_path):
    html = "<html lang=\"de\"><head><title>T &amp; x</title><style>p{}</style></head><body><script>var t='</p>';</script><p>a &lt;b&gt;<br>c <a href='/x'>d</a></p></body></html>"
    pages = spark.createDataFrame([(1, "http://a/x", html), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    records = warc.derive(warc.responses(pages))
    rows = records.collect()
    assert len(rows) == 6
    text = next(r for r in rows if r.page_id == 1 and r.warc_type == "conversion")
    assert text.block == "T & x\na <b>\nc d"
    meta = next(r for r in rows if r.page_id == 1 and r.warc_type == "metadata")
    assert "language: de" in meta.block and "outlinks: 1" in meta.block and meta.refers_to == text.refers_to
    assert meta.source_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    warc.write_warc(records, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((r.warc_type, r.block) for r in back) == sorted((r.warc_type, r.block) for r in rows)
    assert all(r.whole and r.headers["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() for r in back)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found, expected = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    one = lambda v: "~" if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, numbers.Real) else str(v)
    flat = lambda f: sorted(tuple(map(one, r)) for r in f[columns].astype(object).itertuples(index=False, name=None))
    assert flat(found) == flat(expected)


def test_pipeline(spark, table_dir):
    rng = random.Random(12)
    clean = [words(rng, 150, 100000) for _ in range(12)]
    passage = words(rng, 60, 100000)
    docs = list(enumerate(clean)) + [(20, clean[0]), (21, "### " * 50), (22, clean[1] + " tail"), (23, words(rng, 100, 100000) + " " + passage), (24, words(rng, 100, 100000) + " " + passage)]
    sf_dir = table_dir(docs)
    docs_now, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs_now = materialize(stage(spark, docs_now, sf_dir), "test-stage")
        kept.append(docs_now)
    assert all(k.columns == corpus_pipeline.COLUMNS for k in kept[:-1])
    assert {r.doc_id for r in kept[0].collect()} == {i for i, _ in docs} - {21}
    assert {r.doc_id for r in kept[1].collect()} == set(range(12)) | {23, 24}
    texts = {r.doc_id: r.text for r in kept[2].collect()}
    assert passage in texts[23] and passage not in texts[24] and texts[3] == clean[3]
    assert {r.doc_id for r in kept[3].collect()} == set(texts)
    there = set(os.listdir(shared_dir(spark)))
    result = corpus_pipeline.run(spark, sf_dir)
    assert result.count() == kept[3].count()
    assert set(os.listdir(shared_dir(spark))) - there == {os.path.basename(result._verdigris_path)}  # nothing else is left behind


def test_pipeline_edges(spark, table_dir, edges):
    rng = random.Random(5)
    same_id = [(50, words(rng, 120, 100000)), (50, words(rng, 120, 100000)), (None, words(rng, 120, 100000))]
    rows = corpus_pipeline.run(spark, table_dir([*edges, *same_id, same_id[0]])).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["50", "50", "None"]
    assert corpus_pipeline.run(spark, table_dir([])).count() == 0


@pytest.mark.parametrize(
    "text, spans, kept",
    [
        ("a b c", [[0, 1]], "b c"), ("a b c", [[1, 2]], "a c"), ("a b c", [[2, 3]], "a b "), ("a\nb c", [[1, 2]], "a\nc"), ("a b\n\nc", [[1, 2]], "a\n\nc"),
        (" a \n", [[0, 1]], " \n"), ("a b c d e", [[0, 1], [2, 3], [4, 5]], "b d "), ("é\tb\u00a0c  d", [[0, 1]], "b\u00a0c  d"),
    ],
)
def test_what_stays_keeps_its_lines(text, spans, kept):
    assert substring.cut_out(text.encode(), spans).decode() == kept


def test_many_buckets_in_one_partition(spark, make, monkeypatch):
    """Buckets beyond the largest number of partitions share partitions, with the same result."""
    rng = random.Random(4)
    shared = words(rng, 40, 5000)
    docs = [(i, f"{words(rng, 30, 5000)} {shared if i % 3 == 0 else ''}") for i in range(40)]
    monkeypatch.setattr(substring, "BUCKET_ROWS", 20)
    monkeypatch.setattr(lm, "BUCKET_ROWS", 20)
    whole = {r.doc_id: r.n_removed for r in substring.repeats(make(docs)).collect()}
    scored = {r.doc_id: round(r.logprob, 6) for r in lm.scores(make(docs)).collect()}
    monkeypatch.setattr(common, "MOST_PARTS", 3)
    assert {r.doc_id: r.n_removed for r in substring.repeats(make(docs)).collect()} == whole
    assert {r.doc_id: round(r.logprob, 6) for r in lm.scores(make(docs)).collect()} == scored
    assert {i: whole[i] for i, _ in docs} == {i: brute_substrings(docs)[i][1] for i, _ in docs}


def test_sets_of_unlike_texts_are_not_moved(make, monkeypatch):
    moved, write = [], simhash.materialize

    def watched(df, label, *more):
        out = write(df, label, *more)
        if label == "near":
            moved.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", watched)
    r = random.Random(11)
    passage = [f"shared{i}" for i in range(24)]
    words = [[f"w{r.randrange(10**6)}" for _ in range(120)] for _ in range(150)]
    docs = [(i, " ".join(["the", *" the ".join(passage).split(), *x])) for i, x in enumerate(words)]
    docs += [(1000 + i, f"{docs[i][1]} the end of copy") for i in range(8)]
    got = {x.doc_id: x.component_id for x in spotsigs.near_pairs(make(docs)).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in docs}
    assert 8 <= sum(moved) <= 16


@pytest.mark.parametrize("least", [(4, 5), (1, 2)])
def test_bitmaps_rule_out_no_alike_sets(spark, least):
    r, (p, q) = np.random.default_rng(3), least
    pairs = []
    for n in (*range(1, 40), 300, 3000):
        for kept in (1.0, 0.95, 0.9, 0.8, 0.5, 0.0):
            base = r.choice(1 << 20, 2 * n, replace=False).astype(np.uint64) << np.uint64(32)
            common = round(n * kept)
            pairs.append((base[:n], np.concatenate([base[:common], base[n : 2 * n - common]])))
    pairs.append((np.empty(0, np.uint64), np.empty(0, np.uint64)))
    rows = [(i, len(a), len(b), *map(int, spotsigs.bitmap(a)), *map(int, spotsigs.bitmap(b))) for i, (a, b) in enumerate(pairs)]
    side = lambda c: (lambda s: F.col(f"{s}_{c}"))
    names = ["i", "n_u", "n_v", *[f"{b}_{c}" for c in "uv" for b in spotsigs.BITMAP_COLUMNS]]
    kept = {x.i for x in spark.createDataFrame(rows, names).where(spotsigs.may_be_alike(least)(side("u"), side("v"))).collect()}
    alike = {i for i, (a, b) in enumerate(pairs) if simhash.alike(np.sort(a), np.sort(b), least)}
    assert alike <= kept and len(kept) < len(pairs)
