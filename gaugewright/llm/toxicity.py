"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; everything else in the training folds is unlabelled text. A
numpy classifier, linear in the presence of hashed words, minimises the risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with the logistic loss; when the second part falls below zero, a step goes against its gradient. The
prior is the share of toxic rows among the labelled ones of the training folds.

Every word has a weight. Its presence counts the less the less its shares of the positive and the
unlabelled rows differ, in standard deviations z of a share smoothed by SMOOTH rows: z^2 / (z^2 + HALF^2).

Fitting uses at most POSITIVES positive rows, spread by a hash of the id, and all unlabelled rows: these
are dealt to blocks of about BLOCK rows by a hash, a classifier is fitted to the positives and each
block on the executors, and the weights of all blocks are averaged. Every text is scored whole; null and
empty texts have no words and get the score of the bias alone. Rows with null labels or ids teach
nothing (their ids are in no fold, so held_out is null). Without positives the score is 0. Repeated
label rows count as often as they occur. Columns other than id, text and label play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.common import fold, map_batches, spread_sample, two_columns
from gaugewright.llm.features import Adam, Rows, collect_sample, sigmoid, word_buckets

BUCKETS = 1 << 18
POSITIVES, BLOCK, PARTITIONS = 3000, 16_384, 20_000
HALF, SMOOTH = 4.0, 4.0
STEPS, RATE, PENALTY = 60, 0.1, 0.05
THRESHOLD = 0.3


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(Rows([word_buckets(t, len(self.weights)) for t in texts]).times(self.weights) + self.bias)


def train(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, buckets: int = BUCKETS, steps: int = STEPS) -> Model:
    """Non-negative PU risk over rows of bucket numbers."""
    if not positives or not unlabelled or not 0 < prior < 1:
        return Model(np.zeros(buckets, np.float32), -40.0)
    np_, nu = len(positives), len(unlabelled)
    in_p, in_u = (np.bincount(np.concatenate(many), minlength=buckets) for many in (positives, unlabelled))
    used = np.flatnonzero(in_p + in_u)
    place = np.zeros(buckets, np.int32)
    place[used] = np.arange(len(used))
    p, u = (Rows([place[i] for i in many]) for many in (positives, unlabelled))
    share = (in_p + in_u + SMOOTH)[used] / (np_ + nu + SMOOTH)
    z = (in_p / np_ - in_u / nu)[used] / np.sqrt(share * (1 - share) * (1 / np_ + 1 / nu) + 1e-12)
    scale = z * z / (z * z + HALF * HALF)
    size, w, b = len(used), np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    for_w, for_b = Adam((size,), RATE), Adam((1,), RATE)

    for _ in range(steps):
        gp, gu = p.times(w * scale) + b, u.times(w * scale) + b
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        # slopes of the risk by each row's output: as a positive 1/(1+e^g) less, as a negative 1/(1+e^-g) more
        if negative >= 0:
            slopes = prior * (sigmoid(gp) - 1) / np_ - prior * sigmoid(gp) / np_, sigmoid(gu) / nu
        else:
            slopes = prior * sigmoid(gp) / np_, -sigmoid(gu) / nu
        dw = (p.transposed_times(slopes[0], size) + u.transposed_times(slopes[1], size)) * scale
        w -= for_w.step(dw + PENALTY / np_ * w)
        b -= float(for_b.step(np.array([slopes[0].sum() + slopes[1].sum()]))[0])
    weights = np.zeros(buckets, np.float32)
    weights[used] = w * scale
    return Model(weights, b)


def averaged(rows: DataFrame, positives: list[np.ndarray], prior: float, block: int) -> Model:
    """The mean of the models of all blocks of rows (key, text)."""
    n = rows.count()
    if not n or not positives or not 0 < prior < 1:
        return train([], [], prior)
    blocks = -(-n // block)
    sent = rows.sparkSession.sparkContext.broadcast(positives)

    def features(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"block": b["block"], "x": [word_buckets(t, BUCKETS).astype("<u4").tobytes() for t in b["text"]]}

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        model = train(sent.value, [np.frombuffer(x, "<u4") for x in sorted(group["x"])], prior)
        some = np.flatnonzero(model.weights)
        return pd.DataFrame({"word": np.append(some, -1).astype(np.int32), "weight": np.append(model.weights[some], model.bias).astype(float)})

    dealt = map_batches(rows.select(F.pmod("key", F.lit(blocks)).cast("int").alias("block"), "text"), features, "block int, x binary")
    # as many partitions as blocks: small ones aren't put together, since a block takes time rather than room
    found = dealt.repartition(min(blocks, PARTITIONS), "block").groupBy("block").applyInPandas(fitted, "word int, weight double").groupBy("word").agg(F.sum("weight").alias("weight"))
    weights, bias, of = np.zeros(BUCKETS, np.float32), 0.0, min(blocks, n)
    for word, weight in found.toLocalIterator():  # BUCKETS rows and the bias
        if word < 0:
            bias = weight / of
        else:
            weights[word] = weight / of
    return Model(weights, bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held_out: int = 2, positives: int = POSITIVES, block: int = BLOCK) -> Model:
    """Train on the rows whose fold is not the held-out one."""
    texts = two_columns(docs, id_col, text_col).where(fold(F.col("doc_id"), folds) != held_out)
    marks = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("y")).where(F.col("y").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    n, toxic = marks.agg(F.count("y"), F.coalesce(F.sum(F.when(F.col("y") == 1, 1)), F.lit(0))).first()

    def buckets(row: dict) -> bytes:
        return word_buckets(row["text"], BUCKETS).astype("<u4").tobytes()

    # `positives` ids, whatever the input
    confirmed = spread_sample(marks.where("y = 1"), F.col("doc_id"), F.col("y"), positives)
    shown = collect_sample(texts.join(F.broadcast(confirmed), "doc_id").select("doc_id", "text", "y"), buckets, "y")[0]
    rows = texts.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    return averaged(rows, [np.frombuffer(x, "<u4") for x in shown], toxic / n if n else 0.0, block)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    rows = two_columns(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own = Model(*sent.value)
        for b in batches:
            for at in range(0, len(b["text"]), 1000):
                yield {"doc_id": b["doc_id"][at : at + 1000], "score": own.scores(b["text"][at : at + 1000]).tolist()}

    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
