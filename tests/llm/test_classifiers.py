import base64
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.llm import language_id, quality, queries, toxicity
from gaugewright.llm.common import fold
from gaugewright.llm.features import Rows


def auc(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    y = np.array(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.fixture(scope="module")
def sf01():
    return "/root/testdata/sf0.01"


def held_out(spark, sf, query, column):
    labels = queries.table(spark, sf, "labels").select("doc_id", column)
    return query(spark, sf).where("held_out").join(labels, "doc_id").collect()


def test_quality_held_out(spark, sf01):
    rows = held_out(spark, sf01, queries.op8_quality, "quality")
    assert auc([r.quality for r in rows], [r.score for r in rows]) > 0.97
    assert all(r.predicted == 1 for r in rows if r.quality == 1)


def test_toxicity_held_out(spark):
    rows = held_out(spark, "/root/testdata/sf0.1", queries.op7_toxicity, "toxic")
    assert auc([r.toxic for r in rows], [r.score for r in rows]) > 0.97
    assert np.mean([r.predicted for r in rows if r.toxic == 1]) > 0.8
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.05


def test_language_held_out(spark, sf01):
    rows = queries.op1_language_id(spark, sf01).where("held_out").join(queries.table(spark, sf01, "documents").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_sum_of_squares_identity():
    random_ = np.random.default_rng(0)
    model = quality.Model(0.3, random_.normal(size=quality.SIZE), random_.normal(size=(quality.SIZE, 3)))
    at, x = np.array([1, 5, 9]), np.array([0.5, 2.0, -1.0])
    pairs = sum(model.v[at[i]] @ model.v[at[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert model.raw_scores(Rows([at], [x]))[0][0] == pytest.approx(0.3 + model.w[at] @ x + pairs)


def test_segmentations_are_summed():
    pieces = language_id.Pieces([b" ", b"a", b"b", b" a", b"ab"])
    p = np.array([[0.1], [0.2], [0.3], [0.05], [0.25], [0.0]])
    got = language_id.Lattice([b" ab"], pieces).forward(p)[3, 0, 0]
    assert got == pytest.approx(0.1 * 0.2 * 0.3 + 0.05 * 0.3 + 0.1 * 0.25)
    uses = language_id.Lattice([b" ab"], pieces).expected(p, np.array([[2.0]]))
    assert (uses[:, 0] @ np.array([1, 1, 1, 2, 2, 0])) == pytest.approx(2 * 3)


def test_pu_risk_finds_the_marking_words():
    random_ = np.random.default_rng(1)
    clean = [np.unique(random_.integers(10, 1000, 30)) for _ in range(900)]
    toxic = [np.unique(np.append(random_.integers(10, 1000, 30), random_.integers(0, 10, 3))) for _ in range(200)]
    model = toxicity.train(toxic[:100], clean + toxic[100:], 0.1, buckets=1000)
    score = lambda rows: Rows(rows).times(model.weights) + model.bias
    assert auc([1] * 100 + [0] * 900, np.concatenate([score(toxic[100:]), score(clean)])) > 0.95
    assert toxicity.train([], clean, 0.1, 1000).scores([None])[0] < 0.3


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_edge_cases(spark, documents, kind):
    random.seed(0)
    texts = [" ".join(random.choices(["alpha", "beta", "gamma", "delta"], k=20)) + (" nasty" if i % 4 == 0 else "") for i in range(80)]
    docs = documents([*enumerate(texts), (500, None), (501, ""), (502, "z" * 100_000), (None, "alpha"), (0, texts[0])])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(61, None), (None, 1)], f"doc_id long, {kind} int")
    module = toxicity if kind == "toxic" else quality
    got = module.score(docs, module.fit(docs, labels)).collect()
    assert len(got) == 85 and all(0 <= r.score <= 1 for r in got)
    assert len({round(r.score, 9) for r in got if r.doc_id == 0}) == 1
    none = spark.createDataFrame([], f"doc_id long, {kind} int")
    assert module.score(docs, module.fit(docs, none)).count() == 85
    assert module.score(documents([]), module.fit(documents([]), none)).count() == 0


def test_quality_keeps_all_columns_and_rejects(spark, documents):
    docs = documents(["good words here."] * 60 + ["### $$$ ### %%%"] * 20)
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 60, 1).otherwise(0).alias("quality"))
    kept = quality.keep_good(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(60))
    everything = quality.keep_good(docs, quality.fit(docs, labels.limit(0)))
    assert everything.count() == 80


def test_language_edge_cases(spark, documents):
    docs = documents([(1, "the cat"), (2, None), (3, "123 !!"), (4, ""), (None, "the dog"), (5, "漢字"), (1, "the cat"), (6, "w" * 5000)])
    model = language_id.fit(docs)
    got = {str(r.doc_id): r for r in language_id.identify(docs, model).collect()}
    assert {k: got[k].lang_pred for k in ("2", "3", "4")} == dict.fromkeys("234", "und")
    assert all(got[k].lang_pred == "en" and got[k].score == 1.0 for k in ("1", "5", "6", "None"))
    unlearned = language_id.identify(docs, language_id.fit(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}
    assert language_id.identify(documents([]), language_id.fit(documents([]))).count() == 0


def test_folds(spark):
    rows = spark.range(50).select("id", fold(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_long_words_as_short_ones():
    random_ = np.random.default_rng(4)
    pieces = language_id.Pieces([b" ", b"a", b"b", b"ab", b"ba", b"aab", b"bbbbb", b" ab", b"abababababab" * 2])
    p = random_.random((len(pieces) + 1, 2))
    p[-1] = 0
    for n in (1, 5, 20, 31):
        word = b" " + bytes(random_.choice(list(b"ab"), n).tolist())
        counts = np.array([[2.0, 3.0]])
        short, long = (kind([word], pieces) for kind in (language_id.Lattice, language_id.Long))
        assert np.allclose(short.log_total(p), long.log_total(p))
        assert np.allclose(short.expected(p, counts)[:-1], long.expected(p, counts)[:-1])
    very = language_id.Long([b" " + b"ab" * 50_000], pieces)
    assert np.isfinite(very.log_total(p * 1e-5)).all()


def test_language_against_all_segmentations(spark, documents, tmp_path):
    vocabulary = ["th", "he", "the", " the", " d", "er", "der", " der", "ein", " ein", "ing", "ch", "\u00fc", "\u00fcr", " a", "nd", " and", "and", "un", " und", "abcdefghijklmno", " kaleidoskopisch"]
    path = tmp_path / "pieces"
    path.write_text("\n".join(f"{base64.b64encode(v.encode()).decode()} {i}" for i, v in enumerate(vocabulary)))
    random.seed(1)
    said = {"en": ["the", "thing", "and", "a", "abcdefghijklmno"], "de": ["der", "ein", "und", "f\u00fcr", "ich", "kaleidoskopisch"]}
    rows = [(i, " ".join(random.choices(said["en" if i % 2 else "de"] + ["x"], k=random.randrange(1, 7)))) for i in range(60)]
    docs = documents(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    model = language_id.fit(docs, path=str(path))
    at = {piece: i for piece, i in model.pieces.items()}

    def total(data, k):
        return 1.0 if not data else sum(model.p[at[data[:n]], k] * total(data[n:], k) for n in range(1, len(data) + 1) if data[:n] in at)

    texts = dict(rows)
    for r in language_id.identify(docs, model).collect():
        logs = [model.log_share[k] + sum(math.log(total(b" " + w.encode(), k)) for w in texts[r.doc_id].split()) for k in range(2)]
        want = [math.exp(x) / sum(math.exp(y) for y in logs) for x in logs]
        assert r.lang_pred == model.languages[int(np.argmax(want))] and r.score == pytest.approx(max(want))


def test_toxicity_blocks_and_scores_of_a_whole_table(spark, documents):
    random.seed(3)
    rows = [(i, " ".join(random.choices([f"w{k}" for k in range(60)], k=20) + (["nasty", "vile"][: i % 3] if i % 4 == 0 else []))) for i in range(300)]
    docs = documents([*rows, (900, None), (901, "nasty")])
    labels = spark.createDataFrame([(i, int(i % 4 == 0 and i % 3 > 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, block=64)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, text in [*rows, (900, ""), (901, "nasty")]:
        out = model.bias + sum(float(model.weights[b]) for b in {zlib.crc32(w.encode()) % toxicity.BUCKETS for w in text.split()})
        assert got[i] == pytest.approx(1 / (1 + np.exp(-out)), abs=1e-6)
    truth = [int(i % 4 == 0 and i % 3 > 0) for i, _ in rows[200:]]
    assert auc(truth, [got[i] for i, _ in rows[200:]]) > 0.95


def test_quality_scores_of_a_whole_table(documents):
    random_ = np.random.default_rng(7)
    model = quality.Model(0.2, random_.normal(size=quality.SIZE), random_.normal(size=(quality.SIZE, 2)))
    texts = [None, "", "one", "One two, two! 3", "x " * 3000, "\u00fcber alles"]
    for r in quality.score(documents(texts), model).collect():
        at, x = quality.features(texts[r.doc_id], None if texts[r.doc_id] is None else len(texts[r.doc_id]))
        pairs = sum(float(model.v[at[i]] @ model.v[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
        out = model.bias + float(model.w[at] @ x) + pairs
        assert r.score == pytest.approx(1 / (1 + np.exp(-out)), rel=1e-4)
    odd = documents(texts).drop("n_chars").withColumn("n_chars", F.lit("many"))
    assert quality.keep_good(odd, model, threshold=0.0).count() == len(texts)
