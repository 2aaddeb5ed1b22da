import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gaugewright.llm import packing

TEXTS = ["Hello, World! It's 42.", None, "", " \n\t ", "naïve café ÉTÉ Straße", "<|endoftext|> x<|startoftext|>", "word " * 5000, "a\x1cb c d", "İstanbul ΣΑΣ é ﬁ", "don't we'll I'd", "a" * 3000, "x.y,z;w:(q)...", "ΑΣ ΑΣ,", "Ä.", "퟿ 漢字 😀!"] * 3


@pytest.mark.parametrize("size", [16, 2048])
def test_round_trip(documents, size):
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    got = packing.pack(documents(TEXTS), size=size).collect()
    pieces, sequences = {}, {}
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length
        pieces.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(pieces[i], key=lambda p: p[0])
        assert np.concatenate([p[1] for p in parts]).tolist() == want
        assert all(p[2] == len(want) for p in parts)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // size) + 3  # a partition leaves less than one sequence open


def test_costs_are_balanced():
    random = np.random.default_rng(0)
    lengths = random.integers(1, 2048, 500).tolist()
    placed = packing.assign(lengths)
    assert sum(p[2] for p in placed) == sum(lengths)
    cost = {}
    for _, _, n, s in placed:
        cost[s] = cost.get(s, 0) + n + n * n / 1024
    assert len(cost) == -(-sum(lengths) // 2048)
    assert max(cost.values()) < 2.5 * (sum(cost.values()) / len(cost))


def test_repeats_ties_nulls_empty(documents):
    got = packing.pack(documents([(None, "a"), (1, "a"), (1, "a")]), size=4).collect()
    assert sorted(str(r.doc_id) for r in got if r.start == 0) == ["1", "1", "None"]
    assert packing.pack(documents([])).count() == 0
    assert packing.assign([]) == []


def test_crc(spark, documents):
    from pyspark.sql import functions as F

    r = packing.pack(documents(["one two"])).select("ids", F.crc32("ids").alias("crc")).first()
    assert r.crc == zlib.crc32(bytes(r.ids))


def test_encoder_forgets_long_runs():
    """What is remembered is bounded in characters, not only in runs."""
    import pyarrow as pa

    random = np.random.default_rng(0)
    texts = pa.array(["".join(map(str, random.integers(0, 10, 8000))) for _ in range(600)])
    encode = packing.Encoder(packing.vocabulary_path())
    for at, to in packing.slices(texts):
        encode(texts[at:to])
    assert sum(map(len, encode.runs)) < 3_500_000  # of 4,800,000


def test_idle_workers_hold_nothing(spark, documents):
    packing.pack(documents([f"word{i} other{i}" for i in range(4000)])).count()

    def held(stream):
        import pyarrow as pa

        for _ in stream:
            pass
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(e.runs) for e in packing._encoders.values()], pa.int64())})

    found = [r.n for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()]
    assert found and max(found) == 1


def test_batches_are_small(documents, monkeypatch):
    """Neither a block nor a long document leaves in one batch; every id leaves."""
    import pyarrow as pa

    docs = documents(["a"])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": lambda: 0}))
    texts = ["one two three four five"] * 5000 + ["word " * 40_000]
    made = list(packing.pack(docs, size=16)(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": texts})])))
    assert max(b.num_rows for b in made) <= 1024
    assert sum(sum(b.column(2).to_pylist()) for b in made) == 5000 * 6 + 40_001
    assert sorted({r for b in made for r in b.column(0).to_pylist()}) == list(range(len(texts)))
