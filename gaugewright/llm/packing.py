"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A document's ids end with one end-of-document id. Documents longer than a sequence are cut into full
sequences and a rest. The cost of a piece of n tokens is LINEAR * n + QUADRATIC * n * n (the dense
layers, and attention within the piece). The pieces of a block are assigned in descending length to
the sequence of lowest cost that has room; the block's number of sequences is the least that can hold
its tokens, and a piece that fits nowhere whole is cut over the sequences that have room, lowest cost
first. So each block leaves less than one sequence of padding.

A block is at most BLOCK_PIECES rests of one input partition: tasks share nothing, nothing is
shuffled, and a lost task makes the same rows again. sequence_id holds the partition above and a
counter below 33 bits.

A worker holds one block, SLICE_BYTES of text (one text at least) and the ids of CACHED_WORDS runs or
CACHED_CHARS characters besides; rows leave in batches of OUT_PIECES, and what a task held goes back to
the system at its end, since Spark keeps idle workers. None of these sizes has a part in the result.

Defined results: null text counts as empty (its only id is the end id); a null or repeated doc_id is
carried as it is, each row being a document of its own; ties in length are taken in input order; an
empty table gives no pieces; columns other than id and text play no part.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gaugewright.llm.common import arrow_schema, hand_back, two_columns

SEQUENCE, END_ID = 2048, 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
BLOCK_PIECES = 8192
SLICE_BYTES, CACHED_WORDS, CACHED_CHARS, OUT_PIECES = 2 << 20, 200_000, 2_500_000, 1024

#: Marks that may follow a word in a run; the tokenizer always parts them from letters.
TAIL = ".,;:!?|"
WORD_END = "</w>"

_encoders: dict[str, Encoder] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be printed, else one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*printed}))}


class Encoder:
    """Ids of whole texts, with those of the runs between spaces and line ends remembered.

    The tokenizer drops white space and never joins across it, so runs can be encoded one by one, and it
    takes A-Z as a-z; any other white space stays inside a run. Most runs are a word of Latin letters with marks behind:
    such words go to the model itself, many at once, in lower case and as byte letters, which is what
    the tokenizer's normaliser and splitter make of them. All other runs go to the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {b: c for b, c in byte_letters().items() if b != 10}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.parts: dict[str, int] = {"": 0}  # word or tail or other run -> its place in start and count
        self.runs: dict[str, int] = {"": 0}  # run -> its place in pairs: the parts that make it
        self.chars = 0  # of all runs
        self.ids, self.start, self.count, self.pairs = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, 2), np.int64)

    def add(self, parts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """New parts, their ids one after another, and where each one's end."""
        starts = np.r_[0, ends[:-1]].astype(np.int64)
        self.parts.update(zip(parts, range(len(self.start), len(self.start) + len(parts)), strict=True))
        self.start, self.count = np.r_[self.start, len(self.ids) + starts], np.r_[self.count, ends - starts]
        self.ids = np.r_[self.ids, ids]

    def add_words(self, words: list[str]) -> None:
        """Lower-case Latin words."""
        said = "\n".join(words).encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([said], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(words):
            self.add(words, ids, ends)
        else:
            self.add_others(words)

    def add_others(self, runs: list[str]) -> None:
        made = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        self.add(runs, np.array([i for ids in made for i in ids], np.uint32), np.cumsum([len(ids) for ids in made]))

    def learn(self, runs: list[str]) -> None:
        parts, words, others = self.parts, {}, {}
        split: list[tuple[str, str]] = []
        for run in runs:
            core = run.rstrip(TAIL)
            low = core.lower()
            if low.isalpha() and (low.isascii() or max(low) < "\u0250"):
                tail = run[len(core) :]
                if low not in parts:
                    words[low] = None
                if tail not in parts:
                    others[tail] = None
            else:
                low, tail = run, ""
                if run not in parts:
                    others[run] = None
            split.append((low, tail))
        if words:
            self.add_words(list(words))
        if others:
            self.add_others(list(others))
        self.runs.update(zip(runs, range(len(self.pairs), len(self.pairs) + len(runs)), strict=True))
        self.chars += sum(map(len, runs))
        self.pairs = np.concatenate([self.pairs, np.array([(parts[w], parts[t]) for w, t in split], np.int64)])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.runs) > CACHED_WORDS or self.chars > CACHED_CHARS:
            self.forget()
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are found in texts as they are
            texts = pc.ascii_lower(texts)
        runs = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = runs.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        new = [r for r in names if r not in self.runs]
        if new:
            self.learn(new)
        known = np.fromiter(map(self.runs.__getitem__, names), np.int64, len(names))
        each = self.pairs[known][coded.indices.to_numpy()].ravel()
        start, count = self.start[each], self.count[each]
        ends = np.cumsum(count)
        flat = self.ids[np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.r_[0, ends][2 * runs.offsets.to_numpy().astype(np.int64)]
        return [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def encoder(path: str) -> Encoder:
    """The encoder that this worker keeps for its next tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes, one text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def assign(lengths: list[int], size: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(piece, start in it, length, sequence) for pieces of at most `size` tokens; sequences count from 0."""
    n = -(-sum(lengths) // size)
    cost, room = np.zeros(n), np.full(n, size, np.int64)
    out, cut_up = [], []

    def put(piece: int, start: int, length: int, s: int) -> None:
        room[s] -= length
        cost[s] += linear * length + quadratic * length * length
        out.append((piece, start, length, s))

    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        s = int(np.argmin(np.where(room >= lengths[piece], cost, np.inf)))
        if room[s] >= lengths[piece]:
            put(piece, 0, lengths[piece], s)
        else:
            cut_up.append(piece)
    for piece in cut_up:
        start = 0
        while start < lengths[piece]:
            s = int(np.argmin(np.where(room > 0, cost, np.inf)))
            length = int(min(room[s], lengths[piece] - start))
            put(piece, start, length, s)
            start += length
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, linear: float = LINEAR, quadratic: float = QUADRATIC, block: int = BLOCK_PIECES) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    rows = two_columns(docs, id_col, text_col)
    path, end = tokenizer or vocabulary_path(), np.array([end_id], np.uint32)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    types = arrow_schema(schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = encoder(path), TaskContext.get().partitionId() << 33
        rests: list[tuple] = []  # doc_id, start, ids, doc_tokens

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first
            filled: dict[int, int] = {}
            placed = assign([len(r[2]) for r in rests], size, linear, quadratic)
            for at in range(0, len(placed), OUT_PIECES):
                done = []
                for piece, start, length, s in placed[at : at + OUT_PIECES]:
                    doc, begin, ids, total = rests[piece]
                    done.append((doc, begin + start, length, ids[start : start + length].tobytes(), total, first + s, filled.get(s, 0)))
                    filled[s] = filled.get(s, 0) + length
                yield columns(done)
            first += len(filled)
            rests.clear()

        def columns(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], f.type) for i, f in enumerate(types)], schema=types)

        try:
            for batch in stream:
                for at, to in slices(batch.column(1)):
                    full: list[tuple] = []
                    for doc, ids in zip(batch.column(0)[at:to].to_pylist(), encode(batch.column(1)[at:to]), strict=True):
                        ids = np.append(ids, end)
                        total, start = len(ids), 0
                        while total - start >= size:
                            full.append((doc, start, size, ids[start : start + size].tobytes(), total, first, 0))
                            start, first = start + size, first + 1
                            if len(full) >= OUT_PIECES:
                                yield columns(full)
                                full = []
                        if start < total:
                            rests.append((doc, start, ids[start:].copy(), total))
                            if len(rests) >= block:
                                yield from packed()
                    yield columns(full)
                batch = None
            yield from packed()
        finally:
            rests.clear()
            encode.forget()
            hand_back()

    return rows.mapInArrow(run, schema)
