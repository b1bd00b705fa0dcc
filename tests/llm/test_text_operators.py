"""Operators on single texts: quality rules, BPE, packing, fingerprints."""

import hashlib
import heapq
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verdigris.llm import bpe, packing, quality, spotsigs

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "<|endoftext|>a<|startoftext|>", "a<|endoftext|", "Σας ΣΑΣ ὈΔΥΣΣΕΎΣ", "é ́a", " x y\x1cz\x85w", "İstanbul ǅ ŉ ﬁ", "日本語テスト😀👩‍👩‍👧",
       "don't I'LL we're ''s", "1234 ½ ² Ⅻ", "aaaaaaaaaaaaaaaaaaaaaaa aaaa aaa", "!!!!!!??!...----", "​﻿­ x", "\x00\x01", "가각", "x" * 300, "é" * 100]


@lru_cache
def library():
    return Tokenizer.from_file(PATH)


def texts(n, seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz'.,!?-0123 \n\tàéîöüßñçΣσİ日本语😀́ ​<|>"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return made + ["".join(rng.choice(["aa", "a", "in", "ing", "th", "er", "!", "hah"]) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_automaton_equals_library():
    some = ODD + texts(3000, 1)
    expected = [x.ids for x in library().encode_batch(some, add_special_tokens=False)]
    found = [np.frombuffer(x, "<u4").tolist() for x in bpe.Chunks(PATH).of([x.encode() for x in some])]
    assert found == expected
    decoded = bpe.automaton(PATH).decode(bpe.lists([np.array(x, "<u4").tobytes() for x in expected])).to_pylist()
    assert decoded == [library().decode(x, skip_special_tokens=False) for x in expected]


def test_long_words_and_full_caches():
    rng = random.Random(7)
    words = ["".join(rng.choice(x) for _ in range(rng.choice([49, 50, 400, 3000]))) for x in ("ab", "inger", "abcdefghijklmnopqrstuvwxyz", "éüß", "漢字кири") for _ in range(8)]
    some = [f"{a} {b} the the {a[:9]}" for a, b in zip(words, words[1:], strict=False)] * 2
    expected = [library().encode(x, add_special_tokens=False).ids for x in some]
    table = bpe.Chunks(PATH, most=2000)  # much less than a text's chunks take
    assert [np.frombuffer(table.of([x.encode()])[0], "<u4").tolist() for x in some] == expected


def test_bpe_query(spark, table_dir, edges):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2_bpe(spark, table_dir(edges)).collect())
    expected = Counter()
    for i, t in edges:
        ids = library().encode(t or "", add_special_tokens=False).ids
        decoded = library().decode(ids, skip_special_tokens=False)
        expected[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert got == expected


def test_decode_skips_unknown_ids(spark):
    frame = spark.createDataFrame([(1, [320, 99999999, -1]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(frame, PATH).collect()} == {1: library().id_to_token(320), 2: "", 3: ""}


def check_packing(rows, docs):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in docs:
        ids = [*library().encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE
    return by_sequence


def test_packing_query(spark, table_dir):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["hash", "thing", "other", "none"]) for _ in range(rng.choice([0, 5, 700, 2047, 2048, 5000])))) for i in range(60)] + [(60, None)]
    sequences = check_packing(packing.op1_packing(spark, table_dir(docs)).collect(), docs)
    fill = [sum(r.length for r in x) for x in sequences.values()]
    assert sum(1 for x in fill if x < 0.5 * packing.SIZE) <= 1


def test_packing_repeated_and_empty(spark, table_dir, edges, make):
    got = packing.op1_packing(spark, table_dir(edges)).collect()
    assert len(got) == sum(max(1, -(-(len(library().encode(t or "", add_special_tokens=False).ids) + 1) // packing.SIZE)) for _, t in edges)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.op1_packing(spark, table_dir([])).count() == 0


def test_patterns_hold_every_length():
    rng = random.Random(5)
    for _ in range(30):
        histogram = {n: rng.randint(1, 500) for n in rng.sample(range(1, 65), rng.randint(1, 40))}
        placed = Counter()
        for count, pack in packing.patterns(dict(histogram), 64):
            assert count > 0 and sum(pack) <= 64
            for n in pack:
                placed[n] += count
        assert placed == Counter(histogram)


def one_at_a_time(histogram, size):
    """How many packs there are if each piece, longest first, goes into the pack with the most room."""
    room = []  # a heap of negative room
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            if room and -room[0] >= length:
                heapq.heapreplace(room, room[0] + length)
            else:
                heapq.heappush(room, length - size)
    return len(room)


def skewed(seed, size=2048):
    rng = random.Random(seed)
    return Counter(min(size, int(rng.lognormvariate(4, 1.5)) + 1) for _ in range(20000))


@pytest.mark.parametrize("histogram", [{60: 34}, {60: 3400}, {1: 1000}, {n: 100 for n in range(1, 61)}, {2048: 5, 1025: 7, 1024: 9, 3: 1}, dict(skewed(1)), dict(skewed(2))], ids=range(7))
def test_no_more_packs_than_one_at_a_time(histogram):
    packs = packing.patterns(dict(histogram))
    assert sum(count for count, _ in packs) <= one_at_a_time(histogram, packing.SIZE)
    assert sum(count * n for count, pack in packs for n in pack) == sum(n * k for n, k in histogram.items())
    assert len(packs) <= 2 * packing.SIZE


def test_short_pieces_share_sequences():
    assert packing.patterns({60: 34}) == [(1, (60,) * 34)]
    assert sum(count for count, _ in packing.patterns({1: 4096})) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_a_rank_meets_few_ranges(seed):
    histogram = skewed(seed)
    rows, widths = packing.slots(packing.patterns(dict(histogram)))
    width, meets, taken = dict(widths), Counter(), Counter()
    for length, block, *_ in rows:
        meets[length, block] += 1
    compared = sum(meets[n, rank // width[n]] for n, k in histogram.items() for rank in range(k))
    assert compared < 4 * sum(histogram.values())
    for length, first, last in {(r[0], r[2], r[3]) for r in rows}:
        taken[length] += last - first
    assert taken == histogram


def test_short_documents_fill_sequences(spark, table_dir):
    docs = [(i, "hash " * (i % 3)) for i in range(500)]
    sequences = check_packing(packing.op1_packing(spark, table_dir(docs)).collect(), docs)
    assert len(sequences) == 1


def brute_quality(text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    inside = set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(spark, make, edges):
    rng = random.Random(2)
    docs = [t for _, t in edges] + [" ".join(rng.choice(["é", "b", "c#", "\n"]) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    docs += ["x y\nx y\n\nz", "one two three four five six seven eight nine\n" * 4, "\x1c a\x85b"]
    got = quality.judge(make(list(enumerate(docs)))).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_verdicts(spark, make):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(3000)]
    clean = " ".join(rng.choice(words) for _ in range(400))
    cases = [clean, clean + " ###" * 60, "\n".join(["same line of some words"] * 10 + [clean]), " ".join(["five words come again here"] * 40)]
    got = {r.doc_id: r.kept for r in quality.judge(make(list(enumerate(cases)))).collect()}
    assert got[0] and not got[1] and not got[3]
    assert quality.judge(make([])).count() == 0


def test_quality_keeps_other_columns(spark, make):
    docs = make([(1, "a")]).withColumnRenamed("lang", "kept")
    assert quality.judge(docs).columns.count("kept") == 1


def test_neighbours_and_edits(spark, table_dir):
    docs = {i: f"text {i} " + "the quick brown fox and a lazy dog of some kind " * (i % 5) for i in range(0, 300, 3)}
    docs[9] = None
    got = {r.doc_id: r for r in spotsigs.op10_spotsigs(spark, table_dir(list(docs.items()))).collect()}
    order = sorted(docs, reverse=True)
    for at, i in enumerate(order):
        text, following = docs[i] or "", docs[order[(at + 1) % len(order)]] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        with np.errstate(over="ignore"):
            a, b = (spotsigs.signatures(x.encode(), spotsigs.WordHashes()) for x in (text, edited))
        assert got[i].fingerprint == spotsigs.encoded(a)
        assert got[i].near_edited == pytest.approx(spotsigs.alike(a, b))


def test_neighbours_over_ranges(spark, make, monkeypatch):
    monkeypatch.setattr(spotsigs, "parts_for", lambda n, mb=16: 5)
    docs = [(i * 7, f"number {i} of the many texts in this table") for i in range(200)]
    got = {r.doc_id: r.near_next for r in spotsigs.fingerprints(make(docs)).collect()}
    assert len(got) == 200
    one = spotsigs.fingerprints(make([(1, "the only one of its kind here")])).first()
    assert one.near_next == 1.0
    assert spotsigs.fingerprints(make([])).count() == 0


def test_fingerprint_edges(spark, make, edges):
    rows = spotsigs.fingerprints(make(edges)).collect()
    assert len(rows) == len(edges)
    same = {r.fingerprint for r in rows if r.n_chars == 21}
    assert len(same) == 1
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {""}


def test_pruned_jaccard():
    a, b = np.arange(10, dtype=np.uint32), np.arange(5, 15, dtype=np.uint32)
    assert spotsigs.alike(a, b) == pytest.approx(1 / 3)
    assert spotsigs.alike(a, b, 0.5) == 0 and spotsigs.alike(a, a[:4], 0.5) == 0
    assert spotsigs.alike(a[:0], b[:0]) == 1 and spotsigs.alike(a[:0], b) == 0
