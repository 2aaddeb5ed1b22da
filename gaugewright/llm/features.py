"""Sparse numpy features of whole texts, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from gaugewright.llm.common import map_batches

#: ASCII that is no letter or digit becomes a space, A-Z lower case; other characters stay as they are.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def word_buckets(text: str | None, buckets: int) -> np.ndarray:
    """The distinct buckets of a text's words, sorted."""
    words = set(raw(text).translate(PLAIN).split())
    return np.unique(np.fromiter((crc32(w) % buckets for w in words), np.int64, len(words))) if words else np.zeros(0, np.int64)


class Rows:
    """Sparse rows: indices and values one after another, and where each row ends."""

    def __init__(self, indices: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.lengths = np.array([len(i) for i in indices], np.int64)
        self.indices = np.concatenate(indices) if len(indices) else np.zeros(0, np.int64)
        #: None: all are 1
        self.values = None if values is None else np.concatenate(values) if len(values) else np.zeros(0)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def __len__(self) -> int:
        return len(self.lengths)

    def times(self, w: np.ndarray) -> np.ndarray:
        ends, terms = np.cumsum(self.lengths), w[self.indices] if self.values is None else self.values * w[self.indices]
        sums = np.concatenate([np.zeros(1), np.cumsum(terms, dtype=float)])
        return sums[ends] - sums[ends - self.lengths]

    def transposed_times(self, d: np.ndarray, size: int) -> np.ndarray:
        each = np.repeat(d, self.lengths)
        return np.bincount(self.indices, each if self.values is None else self.values * each, size)


class Adam:
    def __init__(self, shape: tuple, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def collect_sample(rows: DataFrame, function, label: str) -> tuple[list, np.ndarray]:
    """function(row of columns) -> bytes on the executors; those and the label column come to the driver in the order of doc_id."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            names = list(b)
            made = [function(dict(zip(names, r, strict=True))) for r in zip(*b.values(), strict=True)]
            yield {"at": b["doc_id"], "y": b[label], "x": made}

    found = sorted(map_batches(rows, run, f"at {rows.schema['doc_id'].dataType.simpleString()}, y int, x binary").collect(), key=lambda r: (r.at, bytes(r.x)))
    return [bytes(r.x) for r in found], np.array([r.y for r in found], float)
