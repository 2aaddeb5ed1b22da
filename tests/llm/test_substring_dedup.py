import random
import re

import pytest

from gaugewright.llm import substring_dedup


def brute(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if key in seen:
                gone |= set(range(a, a + window))
            seen.add(key)
        out[i] = (len(w), " ".join(x for k, x in enumerate(w) if k not in gone), len(gone))
    return out


@pytest.mark.parametrize("window,seed", [(4, 2), (6, 3), (20, 8)])
def test_matches_brute_force(documents, window, seed):
    random.seed(window)
    vocabulary = [chr(97 + i) for i in range(3)] if window < 20 else [f"w{i}" for i in range(200)]
    passage = random.choices(vocabulary, k=60)
    texts = [None, "", " \n ", "a", " ".join(passage), " ".join(passage), "x " * 300]
    for _ in range(40):
        w = random.choices(vocabulary, k=random.randrange(3 * window))
        at, n = random.randrange(40), random.randrange(window, 40)
        w[len(w) // 2 : len(w) // 2] = passage[at : at + n]
        texts.append(random.choice([" ", "\n", "\t\x0b"]).join(w))
    got = substring_dedup.dedup(documents(texts, 5), window=window, seed=seed).collect()
    want = brute(list(enumerate(texts)), window)
    assert {r.doc_id: (r.n_words, r.kept, sum(x["last"] - x["first"] + 1 for x in r.removed)) for r in got} == want


def test_repeated_rows_null_ids_empty(documents):
    text = " ".join(f"w{i}" for i in range(30))
    got = substring_dedup.dedup(documents([(1, text), (1, text), (2, text), (None, text + " z")])).collect()
    assert sorted((str(r.doc_id), len(r.kept.split())) for r in got) == [("1", 0), ("1", 0), ("2", 0), ("None", 31)]
    assert substring_dedup.dedup(documents([])).count() == 0


def test_rows_that_share_an_id(documents):
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, words("a", 30)), (2, words("a", 30)), (2, words("b", 30)), (None, words("c", 25)), (None, words("d", 25)), (3, words("c", 25) + " " + words("d", 25))]
    got = substring_dedup.dedup(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.kept[:2], len(r.kept.split())) for r in got) == [("1", "a0", 30), ("2", "", 0), ("2", "b0", 30), ("3", "", 0), ("None", "c0", 25), ("None", "d0", 25)]
    three = substring_dedup.dedup(documents([(5, f"x{i} " + words("a", 30)) for i in range(3)])).collect()
    assert sorted(len(r.kept.split()) for r in three) == [1, 1, 31]


def opposite(n):
    """Two words of n letters that sums over places can't tell apart: a Thue-Morse word and the one with its letters swapped."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_opposite_words_and_runs(documents, n):
    one, two = opposite(n)
    rows = list(enumerate([" ".join([w] * 25) + f" {w}x {w}y" for w in (one, two)] + [" ".join(x) for x in opposite(n)]))
    got = substring_dedup.dedup(documents(rows), window=20).collect()
    assert {r.doc_id: (r.n_words, r.kept, sum(x["last"] - x["first"] + 1 for x in r.removed)) for r in got} == brute(rows, 20)


def test_frequent_seed_and_a_very_long_text(documents, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY", 3)
    line = [f"l{i}" for i in range(30)]
    texts = [" ".join([f"u{k}", *line, f"v{k}"]) for k in range(40)] + [" ".join(f"w{i % 5000}" for i in range(60_000)), " ".join(f"r{i}" for i in range(40))] * 2
    got = substring_dedup.dedup(documents(texts)).collect()
    assert {r.doc_id: (r.n_words, r.kept, sum(x["last"] - x["first"] + 1 for x in r.removed)) for r in got} == brute(list(enumerate(texts)), 20)
