"""Quality classifier: a factorisation machine.

A text's features are hashed words (by their log counts, at unit length), structure statistics and
metadata (both as one-hot bins). The score is

    sigmoid(bias + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)),

the sum-of-squares identity: linear in the number of features, though every pair interacts. Fitting
uses at most SAMPLE labelled rows of each class, spread by a hash of the id; metadata is the n_chars
column where there is one (null: a bin of its own).

Every text is scored whole; null and empty texts have only structure features. Rows with null labels
or ids teach nothing. With one class or none to learn from, every score is 1 (nothing is rejected).
Repeated rows are scored each; an empty table gives none. Columns other than id, text, label and
n_chars play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.common import column, fold, map_batches, spread_sample
from gaugewright.llm.features import PLAIN, Adam, Rows, collect_sample, raw, sigmoid

BUCKETS, FACTORS, BINS = 1 << 15, 8, 10
SAMPLE, EPOCHS, STEPS, BATCH, RATE, L2 = 4000, 6, 200, 256, 0.02, 1e-5
THRESHOLD = 0.3

LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS, SPACE, UPPER = b"0123456789", b" \t\n\r\x0b\x0c", bytes(range(65, 91))
SYMBOLS = b"#$%&*+<=>@\\^_`{|}~/[]"
STATISTICS = ("letters", "digits", "spaces", "upper", "symbols", "length", "words", "word_length", "distinct", "lines", "line_repeats", "line_ends", "short_lines", "top_word", "n_chars")


def share(data: bytes, kind: bytes) -> float:
    return 1 - len(data.translate(None, kind)) / max(1, len(data))


def statistics(data: bytes, counts: Counter, n_chars: int | None) -> list[float]:
    """Each between 0 and 1, in the order of STATISTICS; n_chars is -1 for null."""
    words = sum(counts.values())
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = max(1, len(lines))
    scale = lambda x, top: min(1.0, math.log1p(max(0, x)) / math.log1p(top))
    return [
        share(data, LETTERS), min(1.0, 4 * share(data, DIGITS)), min(1.0, 3 * share(data, SPACE)), min(1.0, 4 * share(data, UPPER)), min(1.0, 4 * share(data, SYMBOLS)),
        scale(len(data), 1e6), scale(words, 1e5), min(1.0, sum(len(w) * c for w, c in counts.items()) / max(1, words) / 12), len(counts) / max(1, words),
        scale(n, 1e4), 1 - len(set(lines)) / n, sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / n, sum(len(x) < 30 for x in lines) / n,
        max(counts.values(), default=0) / max(1, words), -1.0 if n_chars is None else scale(n_chars, 1e6),
    ]


def features(text: str | None, n_chars: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: BUCKETS of words, then BINS + 1 bins for each statistic."""
    data = raw(text)
    counts = Counter(data.translate(PLAIN).split())
    at = np.fromiter((crc32(w) % BUCKETS for w in counts), np.int64, len(counts))
    values = np.log1p(np.fromiter(counts.values(), float, len(counts)))
    if len(values):
        values /= math.sqrt(float(values @ values))
    stats = [s * (BINS + 1) + (BINS if x < 0 else min(BINS - 1, int(x * BINS))) for s, x in enumerate(statistics(data, counts, n_chars))]
    return np.concatenate([at, BUCKETS + np.array(stats)]), np.concatenate([values, np.full(len(stats), 0.5)])


SIZE = BUCKETS + len(STATISTICS) * (BINS + 1)


@dataclass
class Model:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw_scores(self, x: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Before the sigmoid; and sum v_if x_i of each row and factor."""
        sums = np.stack([x.times(self.v[:, f]) for f in range(self.v.shape[1])], 1)
        squares = np.bincount(x.row, x.values**2 * (self.v**2).sum(1)[x.indices], len(x))
        return self.bias + x.times(self.w) + 0.5 * ((sums**2).sum(1) - squares), sums


def train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 0) -> Model:
    if len(set(y.tolist())) < 2:
        return Model(40.0, np.zeros(SIZE), np.zeros((SIZE, FACTORS)))
    random = np.random.default_rng(seed)
    model = Model(float(np.log(y.mean() / (1 - y.mean()))), np.zeros(SIZE), random.normal(0, 0.02, (SIZE, FACTORS)))
    for_w, for_v = Adam((SIZE,), RATE), Adam((SIZE, FACTORS), RATE)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(x)))):  # a small sample is gone over more often
        order = random.permutation(len(x))
        for start in range(0, len(x), BATCH):
            some = order[start : start + BATCH]
            rows = Rows([x[i][0] for i in some], [x[i][1] for i in some])
            out, sums = model.raw_scores(rows)
            slope = (sigmoid(out) - y[some]) / len(some)
            dw = rows.transposed_times(slope, SIZE)
            squares = np.bincount(rows.indices, rows.values**2 * slope[rows.row], SIZE)
            dv = np.stack([np.bincount(rows.indices, rows.values * (slope * sums[:, f])[rows.row], SIZE) for f in range(FACTORS)], 1) - squares[:, None] * model.v
            model.w -= for_w.step(dw + L2 * model.w)
            model.v -= for_v.step(dv + L2 * model.v)
            model.bias -= RATE * float(slope.sum())
    return model


def chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"), declared(docs).alias("n_chars"))


def declared(docs: DataFrame) -> Column:
    """n_chars as a whole number; null where it is none or absent."""
    return docs["n_chars"].try_cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Model:
    """Train on labelled rows whose fold is not the held-out one."""
    marks = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    totals = {r[0]: r[1] for r in marks.groupBy("y").count().collect()}
    few = F.broadcast(spread_sample(marks, F.col("doc_id"), F.col("y"), sample))  # two classes of `sample` ids, whatever the input
    rows = chosen(docs, id_col, text_col).join(few, "doc_id")

    def packed(row: dict) -> bytes:
        at, values = features(row["text"], row["n_chars"])
        return at.astype("<i4").tobytes() + values.astype("<f4").tobytes()

    found, y = collect_sample(rows, packed, "y")
    x = [(np.frombuffer(b, "<i4", len(b) // 8).astype(np.int64), np.frombuffer(b, "<f4", len(b) // 8, len(b) // 2).astype(float)) for b in found]
    model = train(x, y)
    if len(totals) == 2:  # the sample holds the classes in other shares than the labels do
        model.bias += math.log(totals[1] / totals[0]) - math.log(max(1, (y == 1).sum()) / max(1, (y == 0).sum()))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    rows = chosen(docs, id_col, text_col)
    run = scorer(docs, model)

    def scored(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": run(b["text"], b["n_chars"])}

    return map_batches(rows, scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def scorer(docs: DataFrame, model: Model):
    """texts, n_chars -> scores, for use on the executors; the model's size is fixed."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.w.astype(np.float32), model.v.astype(np.float32)))

    def run(texts: list[str | None], sizes: list[int | None]) -> list[float]:
        own, out = Model(*sent.value), []
        for at in range(0, len(texts), 500):
            made = [features(t, n) for t, n in zip(texts[at : at + 500], sizes[at : at + 500], strict=True)]
            out += sigmoid(own.raw_scores(Rows([m[0] for m in made], [m[1] for m in made]))[0]).tolist()
        return out

    return run


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score the threshold or more."""
    run = scorer(docs, model)

    @F.pandas_udf("double")
    def quality(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series(run([None if t is None else t for t in texts], [None if pd.isna(n) else int(n) for n in sizes]))

    return docs.where(quality(column(docs, text_col), declared(docs)) >= threshold)
