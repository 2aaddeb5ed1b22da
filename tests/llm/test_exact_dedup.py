import re
from collections import Counter, defaultdict

from gaugewright.llm import exact_dedup

TEXTS = ["a b", "a  b", "a\tb ", None, "", " ", "c", "c", "c", "x" * 50_000, "x" * 50_000, " ", "a b"]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {i: (min(g), len(g), i == min(g)) for g in groups.values() for i in g}


def test_matches_brute_force(documents):
    rows = list(enumerate(TEXTS + ["hot"] * 200))
    for k in (1, 4, 256):
        got = exact_dedup.classify(documents(rows), k=k).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == brute(rows)
        assert len(got) == len(rows)


def test_repeated_rows_and_null_ids(documents):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c")]
    got = exact_dedup.classify(documents(rows)).collect()
    assert len(got) == 6
    assert Counter((r.keep_id, r.group_size, r.kept) for r in got) == Counter([(1, 3, True), (1, 3, False), (1, 3, False), (None, 2, True), (None, 2, False), (2, 1, True)])
    kept = exact_dedup.keep_first(documents(rows))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "a"), ("2", "c"), ("None", "b")]


def test_keep_first_keeps_columns(documents):
    frame = documents(TEXTS + ["hot"] * 50)
    kept = exact_dedup.keep_first(frame, k=3)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, _, k) in brute(list(enumerate(TEXTS + ["hot"] * 50))).items() if k}


def test_empty_table(documents):
    assert exact_dedup.classify(documents([])).count() == 0
    assert exact_dedup.keep_first(documents([])).count() == 0


def test_misra_gries_finds_every_heavy_key():
    stream = [list("aabcadaeaf"), list("bbbbgabhai"), list("jklmnoaapb")]
    total = Counter(x for b in stream for x in b)
    for k in (1, 2, 3, 5):
        found = exact_dedup.misra_gries(stream, k)
        assert len(found) <= k
        assert {x for x, n in total.items() if n * (k + 1) > sum(total.values())} <= set(found)
        assert all(found[x] <= total[x] for x in found)
