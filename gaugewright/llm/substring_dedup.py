"""Substring dedup: seed and extend.

A window is WINDOW consecutive words. Its anchor is the run of SEED words in it whose hash is least
(winnowing), so equal windows have equal anchors at equal places. The windows that share one anchor,
at one place of a document, are neighbours; their words together are the anchor's extension to both
sides.

1. Anchors are grouped by their seed: the earliest occurrence, and whether all extensions are the
   same. That is a sum over rows, so a seed in any number of documents is combined before the shuffle.
2. Occurrences of repeated seeds are found by a join on the seed (a very frequent one is broadcast and
   its occurrences spread). With one extension only, each occurrence but the earliest is a repeat as a whole. With several, the match is extended to each
   side as far as windows reach: every window there is grouped by a 128-bit hash of its words.
3. Words of windows that start earlier elsewhere are removed; what is removed in a row is a maximal
   repeat of at least WINDOW words.

Words are runs of other characters than ASCII white space. Windows are judged on the input. Earlier
means in a smaller doc_id (null first), or in the same document further left. Rows with the same doc_id and
text count as one document and get the result of a single one; rows that share only the doc_id are
documents of their own, in the order of a 64-bit hash of their texts. Null texts have no words; an empty
table gives no rows; columns other than id and text play no part. Nothing is capped, and no pairs of
occurrences are made: extending each pair of occurrences would grow with the square of a seed's count, so
matches are extended to all windows of an anchor at once, and equal windows meet by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.common import cut, drop_cut, map_batches, matched, two_columns
from gaugewright.llm.words import Runs, hashed, mix, split

WINDOW, SEED = 20, 8
#: A seed with more than 1/HEAVY of all occurrences of repeated seeds is split; there are at most that many.
HEAVY = 1024


class Anchors:
    """The anchors of a document, from the digests of its words: seed hash, position, and the first and last window start of each."""

    def __init__(self, hashes: np.ndarray, window: int, seed: int):
        self.window, self.runs, self.others = window, Runs(hashes[0]), Runs(hashes[1], 1)
        n = hashes.shape[1]
        if n < window:
            self.seeds, self.at, self.low, self.high = np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
            return
        grams = self.runs.every(seed)
        starts = np.arange(n - window + 1)
        at = starts + np.lib.stride_tricks.sliding_window_view(grams, window - seed + 1).argmin(1)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        self.at, self.low, self.high = at[first], first, np.concatenate([first[1:], [len(starts)]]) - 1
        self.seeds = grams[self.at]

    def extensions(self) -> np.ndarray:
        """A hash of the words of all windows of each anchor, and of where in them the anchor and the windows are."""
        shape = ((self.at - self.low) * self.window + self.high - self.low).astype(np.uint64)
        return mix(self.others(self.low, self.high + self.window) + mix(shape))

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows at these starts, from independent digests of their words."""
        return tuple(r(starts, starts + self.window).view(np.int64) for r in (self.runs, self.others))


def repeated(ids: list, counts: list[int]) -> np.ndarray | list:
    return np.repeat(np.array(ids, object) if None in ids or not all(isinstance(i, int) for i in ids) else np.array(ids), counts)


def find_anchors(rows: DataFrame, window: int, seed: int, extend: bool) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for start in range(0, len(b["text"]), 1000):
                ids, texts, counts, parts = b["doc_id"][start : start + 1000], b["hash"][start : start + 1000], [], {"seed": [], "at": [], "extension": []}
                for hashes in hashed(b["text"][start : start + 1000]):
                    a = Anchors(hashes, window, seed)
                    counts.append(len(a.at))
                    parts["seed"].append(a.seeds.view(np.int64))
                    parts["at"].append(a.at)
                    if extend:
                        parts["extension"].append(a.extensions().view(np.int64))
                yield {"doc_id": repeated(ids, counts), "hash": repeated(texts, counts)} | {k: np.concatenate(v) for k, v in parts.items() if v}

    return map_batches(rows, run, f"seed long, doc_id {kind}, hash long, at int" + ", extension long" * extend)


def find_windows(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """Two hashes, doc_id, hash of the text and start of each window whose anchor is in `mixed`."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            ids, texts, counts, parts = [], [], [], []
            marked = [x for x in zip(b["doc_id"], b["text"], b["mixed"], b["hash"], strict=True) if x[2]]
            for (doc, _, mixed, text), hashes in zip(marked, hashed([x[1] for x in marked]), strict=True):
                if mixed:
                    a = Anchors(hashes, window, seed)
                    some = np.isin(a.at, mixed)
                    starts = np.concatenate([np.arange(x, y + 1) for x, y in zip(a.low[some], a.high[some], strict=True)])
                    ids.append(doc)
                    texts.append(text)
                    counts.append(len(starts))
                    parts.append((*a.windows(starts), starts))
            if parts:
                yield {"doc_id": repeated(ids, counts), "hash": repeated(texts, counts)} | {n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(("h", "g", "start"))}

    return map_batches(rows.select("doc_id", "hash", "text", "mixed"), run, f"h long, g long, doc_id {kind}, hash long, start int")


def cover(n: int, low: np.ndarray, high: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts between a low and its high."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, low, 1)
    np.add.at(step, high + window, -1)
    return np.cumsum(step[:-1]) > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """A row for each document: doc_id, n_words, removed (maximal repeats as word ranges, ends included), kept (what stays, words joined by one space)."""
    rows = two_columns(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    grouped = find_anchors(rows, window, seed, True).groupBy("seed").agg(
        F.min(F.struct("doc_id", "hash", "at")).alias("first"), F.count(F.lit(1)).alias("n"), F.min("extension").alias("low"), F.max("extension").alias("high")
    ).where("n > 1")
    seeds = cut(grouped.select("seed", "n", F.struct("first", (F.col("low") != F.col("high")).alias("mixed")).alias("of")), "seeds")
    found = matched(find_anchors(rows, window, seed, False), seeds, "seed", ("doc_id", "hash", "at"), HEAVY).select("doc_id", "hash", "at", "of.first", "of.mixed")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash")) & (F.col("at") == F.col("first.at"))
    # sets: rows that repeat an id and its text give the same places
    marks = cut(
        found.where(F.col("mixed") | ~is_first).groupBy("doc_id", "hash").agg(F.collect_set(F.when(F.col("mixed"), F.col("at"))).alias("mixed"), F.collect_set(F.when(~F.col("mixed"), F.col("at"))).alias("whole")),
        "repeats",
    )
    drop_cut(seeds)
    marks = marks.withColumnsRenamed({"doc_id": "marked", "hash": "of"})
    texts = rows.join(marks, rows["doc_id"].eqNullSafe(F.col("marked")) & (rows["hash"] == F.col("of")), "left").drop("marked", "of")
    earliest = find_windows(texts, window, seed).groupBy("h", "g").agg(F.min(F.struct("doc_id", "hash", "start")).alias("first"))
    earliest = earliest.groupBy(F.col("first.doc_id").alias("owner"), F.col("first.hash").alias("of")).agg(F.collect_list("first.start").alias("earliest"))
    full = texts.join(earliest, texts["doc_id"].eqNullSafe(earliest["owner"]) & (texts["hash"] == earliest["of"]), "left").select("doc_id", "text", "mixed", "whole", "earliest")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for at in range(0, len(b["text"]), 1000):
                ids, out = b["doc_id"][at : at + 1000], {"n_words": [], "removed": [], "kept": []}
                for text, mixed, whole, first in zip(*[b[c][at : at + 1000] for c in ("text", "mixed", "whole", "earliest")], strict=True):
                    words = split(text)
                    gone = np.zeros(len(words), bool)
                    if mixed or whole:
                        a = Anchors(next(hashed([text])), window, seed)
                        some = np.isin(a.at, whole or [])
                        gone |= cover(len(words), a.low[some], a.high[some], window)
                        if mixed:
                            some = np.isin(a.at, mixed)
                            starts = np.concatenate([np.arange(x, y + 1) for x, y in zip(a.low[some], a.high[some], strict=True)])
                            starts = starts[~np.isin(starts, first or [])]
                            gone |= cover(len(words), starts, starts, window)
                    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    out["n_words"].append(len(words))
                    out["removed"].append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                    out["kept"].append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words).decode("utf-8", "surrogatepass"))
                yield {"doc_id": ids} | out

    return map_batches(full, run, f"doc_id {kind}, n_words long, removed array<struct<first:long,last:long>>, kept string")
