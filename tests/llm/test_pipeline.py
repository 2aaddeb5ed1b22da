"""The pipeline against its stages applied plainly."""

import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from gaugewright.llm import packing, quality, queries
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_ngram_join import brute as near


def test_stages_equal_plain_versions(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_duplicates", "decontamination", "packing"]
    model = quality.fit(docs, queries.table(spark, sf_dir, "labels"))
    good = {r.doc_id for r in quality.score(docs, model).where("score >= 0.3").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    first = {}
    for i, t in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    rows = sorted(first.values())
    roots = near([t for _, t in rows])
    rows = [r for k, r in enumerate(rows) if roots[k][1] == k]
    items = [(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    grams = set()
    for _, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        n = min(10, len(w))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    def clean(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return not any(tuple(w[i : i + 10]) in grams for i in range(len(w)))

    rows = [r for r in rows if clean(r[1])]
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(bytes(r.ids), "<u4")))
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        assert np.concatenate([x for _, x in sorted(got[i], key=lambda p: p[0])]).tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


def test_columns_pass_through(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_brute_force_agrees_with_itself():
    assert hits("a b c", [(1, "b c")])[1] == 2
