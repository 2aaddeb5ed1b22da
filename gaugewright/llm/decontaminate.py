"""Benchmark decontamination: one Aho-Corasick automaton over the windows of test questions and answers.

The automaton's alphabet is the benchmark's own words, numbered: a document becomes a sequence with one
number a word (0 for a word that no item has), which the automaton reads once. A hit is mapped back to
code-point offsets of the original text.

Words are runs of characters other than ASCII non-alphanumerics, with A-Z in lower case. A pattern is
`window` consecutive words of an item, or all the words of a shorter item; items without words have
none. A document word is hit when it lies in any occurrence of a pattern.

The driver holds one block of the benchmark at a time, of about `block_chars` characters; one block is
the usual case, more pass over the documents one after another. Items of more than `PIECE` words are
read in pieces that overlap by a window less one word, so every pattern lies in one. Null texts have no
words; null item ids match but can't be listed; repeated items count once; empty tables give empty
results or no hits; columns other than id and text play no part.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.common import column, cut, drop_cut, map_batches, two_columns

WINDOW = 10
BLOCK_CHARS, PIECE = 4_000_000, 50_000
#: Bytes: lower case for A-Z; a space for ASCII that is in no word; UTF-8 of other characters as it is.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCANNED = "doc_id {id}, n_words long, hits array<struct<first:long,last:long>>, spans array<struct<start:long,end:long>>, items array<string>"
_built: dict[str, tuple] = {}


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split() if text else []


def build(items: list[tuple[str | None, str | None]], window: int) -> tuple[dict[bytes, int], object]:
    """Number of each word, from 1, and the automaton; its values are (length, ids of the items)."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    patterns: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        said = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words_of(text))
        for i in range(max(1, len(said) - window + 1) if said else 0):
            patterns.setdefault(said[i : i + window], set()).update([] if item is None else [item])
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for p, owners in patterns.items():
        machine.add_word(p, (len(p), tuple(owners)))
    if patterns:
        machine.make_automaton()
    return numbers, machine


def built(key: str, items: list[tuple], window: int) -> tuple:
    """build(), kept by this worker for its next tasks."""
    if key not in _built:
        _built.clear()
        _built[key] = build(items, window)
    return _built[key]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan_block(docs: DataFrame, items: list[tuple], window: int, more: bool) -> DataFrame:
    """docs with the hits of these items added to those that it has; the text goes on only if more blocks follow."""
    carried, sent, key = "hits" in docs.columns, docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    schema = SCANNED.format(id=docs.schema["doc_id"].dataType.simpleString()) + ", text string" * more

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        numbers, machine = built(key, sent.value, window)
        for batch in batches:
            out: dict = {"doc_id": batch["doc_id"], "n_words": [], "hits": [], "spans": [], "items": []} | ({"text": batch["text"]} if more else {})
            for i, text in enumerate(batch["text"]):
                words = words_of(text)
                hits = [(h["first"], h["last"]) for h in batch["hits"][i]] if carried else []
                found = set(batch["items"][i]) if carried else set()
                if numbers and words:
                    for at, (length, owners) in machine.iter(tuple([numbers.get(w, 0) for w in words])):
                        hits.append((at - length + 1, at))
                        found.update(owners)
                hits = joined(hits)
                where = [m.span() for m in WORD.finditer(text)] if hits else []
                out["n_words"].append(len(words))
                out["hits"].append([{"first": a, "last": b} for a, b in hits])
                out["spans"].append([{"start": where[a][0], "end": where[b][1]} for a, b in hits])
                out["items"].append(sorted(found))
            yield out

    return map_batches(docs, scan, schema)


def pieces_of(items: DataFrame, window: int) -> DataFrame:
    """item and text, long items in overlapping pieces; each once."""

    def cut_up(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict = {"item": [], "text": []}
            for item, text in zip(b["item"], b["text"], strict=True):
                words = words_of(text)
                for i in range(0, max(1, len(words) - window + 1), PIECE) if words else ():
                    out["item"].append(item)
                    out["text"].append(b" ".join(words[i : i + PIECE + window - 1]).decode("utf-8", "surrogatepass"))
            yield out

    return map_batches(items, cut_up, "item string, text string").distinct()


def item_blocks(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_chars: int) -> Iterator[tuple[list[tuple], bool]]:
    """The items as (id, text) in blocks, and whether it is the last one; one empty block if there are none. A block is collected when it is asked for."""
    items = cut(pieces_of(benchmark.select(column(benchmark, item_col).cast("string").alias("item"), column(benchmark, item_text_col).alias("text")).where(F.col("text").isNotNull()), window), "benchmark")
    blocks = max(1, ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield [(r.item, r.text) for r in part.toLocalIterator()], b == blocks - 1
    drop_cut(items)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document: doc_id, n_words, hits (word ranges, ends included), spans (code points, end excluded), items (sorted ids)."""
    out, written = two_columns(docs, id_col, text_col), None
    for items, last in item_blocks(benchmark, item_col, item_text_col, window, block_chars):
        out = scan_block(out, items, window, not last)
        if not last:
            out = cut(out, "contamination")
            if written is not None:
                drop_cut(written)
            written = out
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns, in whose text no pattern occurs."""

    def clean_of(items: list[tuple]):
        sent, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            numbers, machine = built(key, sent.value, window)
            return pd.Series([not numbers or next(machine.iter(tuple([numbers.get(w, 0) for w in words_of(t)])), None) is None for t in texts], dtype=bool)

        return clean

    for items, last in item_blocks(benchmark, item_col, item_text_col, window, block_chars):
        docs = docs.where(clean_of(items)(column(docs, text_col)))
        docs = docs if last else cut(docs, "clean")
    return docs
