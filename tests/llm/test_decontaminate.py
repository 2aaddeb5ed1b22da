import random
import re

from gaugewright.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items, window=10):
    said, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(said) - n + 1):
                if said[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(said), len(hit), sorted(found)


def cases():
    random.seed(1)
    vocabulary = ["alpha", "Beta", "ÉTÉ", "straße", "x1", "of", "the"]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(1, 12)] + [(7, "of of of the x1")]
    texts = [None, "", "...", "of"]
    for _ in range(25):
        parts = random.choices(vocabulary, k=random.randrange(30))
        if random.random() < 0.6:
            parts[5:5] = random.choice(items)[1].upper().split()
        texts.append(random.choice([" ", ", ", "\n--"]).join(parts))
    return items, [t for t in texts]


def test_matches_brute_force(spark, documents):
    items, texts = cases()
    bench = spark.createDataFrame(items + [(None, "nothing here at all"), (99, None)], "item_id long, text string")
    for block in (decontaminate.BLOCK_CHARS, 150):
        got = {r.doc_id: r for r in decontaminate.contamination(documents(texts), bench, block_chars=block).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            n, hit, found = brute(t, items)
            assert (got[i].n_words, sum(h["last"] - h["first"] + 1 for h in got[i].hits), got[i]["items"]) == (n, hit, found)
            for h, s in zip(got[i].hits, got[i].spans, strict=True):
                assert words(t[s.start : s.end]) == words(t)[h["first"] : h["last"] + 1]
        kept = decontaminate.keep_clean(documents(texts), bench, block_chars=block)
        assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute(t, items)[1]}
        assert kept.columns == documents(texts).columns


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents([]), none).count() == 0
    r = decontaminate.contamination(documents(["a b"]), none).first()
    assert (r.n_words, r.hits, r["items"]) == (2, [], [])
    assert decontaminate.keep_clean(documents(["a b"]), none).count() == 1
