import random
import re

import numpy as np
import pytest

from gaugewright.llm import ngram_join
from gaugewright.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def families():
    random.seed(5)
    word = lambda: f"w{random.randrange(400)}"
    texts = [None, "", "  ", "one two", "One  TWO", "a b c d e", "A B C D E"]
    boiler = [word() for _ in range(40)]
    for size, edits in ((30, 1), (40, 3), (5, 0), (12, 6), (25, 2)):
        base = [word() for _ in range(random.randrange(40, 120))]
        for _ in range(size):
            w = list(base)
            for _ in range(random.randrange(edits + 1)):
                w[random.randrange(len(w))] = word()
            if random.random() < 0.2:
                w += [word() for _ in range(random.randrange(20))]
            texts.append(" ".join(w))
    texts += [" ".join(boiler + [word() for _ in range(random.randrange(2, 30))]) for _ in range(40)]
    random.shuffle(texts)
    return texts


@pytest.mark.parametrize("bits,rounds,small", [(20, 4, 8), (10, 1, 2), (14, 2, 3)])
def test_matches_brute_force(documents, monkeypatch, bits, rounds, small):
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    texts = families()
    got = ngram_join.join(documents(texts), bits=bits).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts)


def test_keep_one(documents):
    texts = families()
    frame = documents(texts)
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, root) in brute(texts).items() if root == i}


def test_repeats_nulls_empty(documents):
    got = ngram_join.join(documents([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (1, None), (None, None)])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("1", 0, "1"), ("3", 2, "3"), ("3", 2, "3"), ("None", 0, "None"), ("None", 1, "None"), ("None", 2, "3")]
    assert ngram_join.join(documents([])).count() == 0


def test_rows_that_share_an_id(documents):
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:-1], "x"])), (2, "one clean text that is like none of the others"), (3, "a b c d e f g")]
    assert sorted((r.doc_id, r.text[:3]) for r in ngram_join.keep_one(documents(rows)).collect()) == [(1, "w0 "), (2, "one"), (3, "a b")]


def test_null_ids_link(documents):
    part = lambda k: " ".join(f"w{i}" for i in range(k, k + 100))
    rows = [(7, part(0)), (None, part(12)), (None, part(12)), (8, part(24)), (None, "q r s t u v"), (None, "other words than all of these here")]
    frame = documents(rows)
    got = ngram_join.join(frame).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("7", "7"), ("8", "7"), ("None", "7"), ("None", "7"), ("None", "None"), ("None", "None")]
    assert sorted((str(r.doc_id), r.text[:1]) for r in ngram_join.keep_one(frame).collect()) == [("7", "w"), ("None", "o"), ("None", "q")]


def test_probe_overlaps():
    random = np.random.default_rng(2)
    for _ in range(20):
        probe = np.unique(random.integers(0, 60, 40).astype(np.uint64))
        sets = [np.unique(random.integers(0, 60, random.integers(1, 60)).astype(np.uint64)) for _ in range(30)]
        got = ngram_join.Probe(probe).overlaps(sets, 75)
        for s, common in zip(sets, got, strict=True):
            true = len(np.intersect1d(s, probe))
            assert common == true if ngram_join.enough(true, len(s), len(probe)) else common in (None, true)


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (5, 4), (4, 9), (3, 1), (7, 7)] + [(100 + i, 101 + i) for i in range(40)] + [(i, 500) for i in range(501, 540)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert [got[x] for x in (1, 2, 3, 10, 11, 4, 5, 9, 140, 539)] == [1, 1, 1, 10, 10, 4, 4, 4, 100, 500]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [1024, 4096])
def test_opposite_words(documents, n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    words = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    texts = [*words, *[" ".join([w, "c", "d", "e", "f", w]) for w in words], *[" ".join(["xy"[b if k else 1 - b] for b in bits]) for k in (0, 1)]]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(documents(texts)).collect()} == brute(texts)


def test_sets_that_share_half_a_digest(documents, monkeypatch):
    whole = ngram_join.class_of

    def weak(shingles, taken=frozenset()):
        first, second = (x % 8 for x in whole(shingles)), whole(shingles)[1]
        first = next(first)
        return (second, first) if first in taken else (first, second)

    monkeypatch.setattr(ngram_join, "class_of", weak)
    texts = [" ".join(f"{k}w{i}" for i in range(30)) for k in range(20)] * 2
    got = ngram_join.join(documents(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts)


def test_a_very_long_text(documents):
    long = [f"w{i}" for i in range(60_000)]
    texts = [" ".join(long), " ".join([*long, "z"]), " ".join(long[:20_000])]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(documents(texts)).collect()} == brute(texts)
