"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (byte pieces; every
single byte is one). A word, a space and its lower-case letters, has as its probability the sum over
all its segmentations into pieces of the product of their probabilities: a forward algorithm over
byte positions. Piece probabilities come from expectation maximisation with forward and backward sums.
A text's score for a language is the sum of its words' log probabilities plus the log share of the
language; the prediction is the best one and `score` its posterior probability.

Words are runs of letters in lower case, of any length: those of up to WHOLE bytes are summed many at
once, longer ones one by one with rescaling. Every piece of the vocabulary counts. Fitting uses at most
SAMPLE rows of each language, spread by a hash of the id. Null texts and texts without a letter are
`und` with score 0, and so is everything when nothing could be learned. Ties go to the language first
in order. Rows with null lang or id teach nothing. Texts of any length are scored whole; repeated rows
are scored each; an empty table gives none; columns other than id, text and lang play no part.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.common import fold, map_batches, spread_sample, two_columns
from gaugewright.llm.words import mix

SAMPLE, ROUNDS = 400, 3
WHOLE, CHUNK, RESCALE, FLOOR = 32, 4096, 8, 1e-8
CACHED_WORDS = 500_000
NONE = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Bytes: ASCII that is no letter becomes a space.
TO_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_pieces(path: str) -> Pieces:
    """Piece -> number, of all pieces of the vocabulary and all single bytes."""
    with open(path, "rb") as lines:
        found = {base64.b64decode(line.split()[0]) for line in lines}
    return Pieces(sorted(found | {bytes([b]) for b in range(256)}))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case runs of characters that aren't ASCII non-letters."""
    return text.lower().encode("utf-8", "surrogatepass").translate(TO_LETTERS).split() if text else []


def letters_of(run: bytes) -> list[bytes]:
    """The words of a run, as bytes to segment."""
    words = [run] if run.isascii() else [w.encode("utf-8") for w in LETTERS.findall(run.decode("utf-8", "replace"))]
    return [b" " + w for w in words]


NOTHING = np.uint64(0x9E3779B97F4A7C15)
BYTE_KEYS = mix(np.arange(1, 257).astype(np.uint64))


def longer(hashes: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Hashes of byte runs that are one byte longer."""
    out = (hashes ^ BYTE_KEYS[data]) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


class Pieces(dict):
    """piece -> number, and the numbers of many byte runs at once, by their hashes."""

    SLOTS = 20  # bits

    def __init__(self, found: list[bytes]):
        super().__init__((p, i) for i, p in enumerate(found))
        self.hashes, self.bytes = np.zeros(len(found) + 1, np.uint64), max(map(len, found), default=1)
        lengths = np.array([len(p) for p in found])
        for n in np.unique(lengths).tolist():
            some = np.flatnonzero(lengths == n)
            data, h = np.frombuffer(b"".join(found[i] for i in some), np.uint8).reshape(-1, n), np.full(len(some), NOTHING)
            for k in range(n):
                h = longer(h, data[:, k])
            self.hashes[some] = h
        self.first = np.full(1 << self.SLOTS, len(found), np.int32)
        self.next = np.full(len(found) + 1, len(found), np.int32)
        self.longest = 1
        for i, h in enumerate((self.hashes[:-1] >> np.uint64(64 - self.SLOTS)).tolist()):
            self.next[i], self.first[h] = self.first[h], i
            length, at = 1, self.next[i]
            while at < len(found):
                length, at = length + 1, self.next[at]
            self.longest = max(self.longest, length)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """len(self) where a run is no piece."""
        at = self.first[hashes >> np.uint64(64 - self.SLOTS)]
        for _ in range(self.longest):
            at = np.where(self.hashes[at] == hashes, at, self.next[at])
        return np.where(self.hashes[at] == hashes, at, len(self))

    def starting(self, data: np.ndarray, low: int, high: int) -> np.ndarray:
        """Numbers of the pieces of each length (columns) that start at each place from low to high (rows)."""
        out, h = np.full((high - low, self.bytes), len(self)), np.full(high - low, NOTHING)
        for k in range(min(self.bytes, len(data) - low)):
            n = min(high, len(data) - k) - low
            h[:n] = longer(h[:n], data[low + k : low + k + n])
            out[:n, k] = self.numbers(h[:n])
        return out


class Lattice:
    """All segmentations of words of one length: for each start and end, the number of the piece between (or the last number, which has probability 0)."""

    def __init__(self, words: list[bytes], pieces: Pieces):
        self.n, none, self.arcs = len(words[0]), len(pieces), []
        data = np.frombuffer(b"".join(words), np.uint8).reshape(-1, self.n).T
        for i in range(self.n):
            h = np.full(len(words), NOTHING)
            for j in range(i + 1, min(self.n, i + pieces.bytes) + 1):
                h = longer(h, data[j - 1])
                ids = pieces.numbers(h)
                if (ids != none).any():
                    self.arcs.append((i, j, ids))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Probability of each word's first bytes, by position, word and language."""
        a = np.zeros((self.n + 1, len(self.arcs[0][2]), p.shape[1]))
        a[0] = 1
        for i, j, ids in self.arcs:
            a[j] += a[i] * p[ids]
        return a

    def log_total(self, p: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(self.forward(p)[self.n], 1e-300))

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, given how often each language has each word."""
        a = self.forward(p)
        b = np.zeros_like(a)
        b[self.n] = counts / np.maximum(a[self.n], 1e-300)
        out = np.zeros_like(p)
        for i, j, ids in reversed(self.arcs):
            b[i] += p[ids] * b[j]
        for i, j, ids in self.arcs:
            used = a[i] * p[ids] * b[j]
            for k in range(p.shape[1]):
                out[:, k] += np.bincount(ids, used[:, k], len(p))
        return out


class Long:
    """All segmentations of one word of any length, with probabilities as numbers times powers of e."""

    def __init__(self, words: list[bytes], pieces: Pieces):
        (word,) = words
        self.data, self.pieces = np.frombuffer(word, np.uint8), pieces

    def chunks(self, p: np.ndarray, back: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each place, the numbers of the pieces that start there, and their probabilities."""
        n = len(self.data)
        places = range(0, n, CHUNK)
        for low in reversed(places) if back else places:
            ids = self.pieces.starting(self.data, low, min(n, low + CHUNK))
            chances = p[ids]
            for k in range(len(ids) - 1, -1, -1) if back else range(len(ids)):
                yield low + k, ids[k], chances[k]

    def forward(self, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each place up to the end, the probability of the bytes before it: a number and the logarithm of what it is times."""
        now, logs, later = np.ones(p.shape[1]), np.zeros(p.shape[1]), np.zeros((self.pieces.bytes, p.shape[1]))
        yield now, logs
        for i, _, chances in self.chunks(p):
            later += now * chances
            now = later[0].copy()
            later[:-1] = later[1:]
            later[-1] = 0
            if i % RESCALE == RESCALE - 1:
                logs, later, now = logs + np.log(now), later / now, np.ones_like(now)
            yield now, logs

    def log_total(self, p: np.ndarray) -> np.ndarray:
        for now, logs in self.forward(p):
            pass
        return (np.log(now) + logs)[None]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        before = [np.log(now) + logs for now, logs in self.forward(p)]
        out, times = np.zeros_like(p), counts.reshape(-1)
        after, logs = np.zeros((self.pieces.bytes, p.shape[1])), np.zeros(p.shape[1])
        after[0] = 1
        for i, ids, chances in self.chunks(p, True):
            ways = chances * after  # of the bytes from i on, by the first piece
            np.add.at(out, ids, ways * np.exp(before[i] + logs - before[-1]) * times)
            after[1:] = after[:-1].copy()
            after[0] = ways.sum(0)
            if i % RESCALE == 0:
                logs, after = logs + np.log(after[0]), after / after[0]
        return out


def lattice_of(words: list[bytes], pieces: Pieces) -> Lattice | Long:
    return (Lattice if len(words[0]) <= WHOLE else Long)(words, pieces)


def by_length(words: list[bytes]) -> Iterator[list[int]]:
    """Places of words of one length, long words one by one."""
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for g in groups.values():
        size = 20_000 if len(words[g[0]]) <= WHOLE else 1
        for at in range(0, len(g), size):
            yield g[at : at + size]


@dataclass
class Model:
    languages: list[str]
    log_share: np.ndarray
    p: np.ndarray  # pieces (and one of probability 0) x languages
    path: str
    pieces: Pieces = field(default_factory=lambda: Pieces([]))

    def log_words(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for group in by_length(words):
            out[group] = lattice_of([words[i] for i in group], self.pieces).log_total(self.p)
        return out


def train(counts: dict[str, Counter], share: dict[str, float], path: str, rounds: int = ROUNDS) -> Model:
    """counts: for each language, how often each word (as bytes) occurs."""
    languages = sorted(counts)
    pieces = read_pieces(path)
    words = sorted({w for c in counts.values() for w in c})
    table = np.array([[counts[k][w] for k in languages] for w in words], float).reshape(len(words), len(languages))
    lattices = [(lattice_of([words[i] for i in g], pieces), table[g]) for g in by_length(words)]
    single = np.array([len(q) == 1 for q in sorted(pieces, key=pieces.get)] + [False])
    p = np.full((len(pieces) + 1, len(languages)), 1 / len(pieces))
    p[-1] = 0
    for _ in range(rounds if words else 0):
        used = sum(lattice.expected(p, n) for lattice, n in lattices)
        used[-1] = 0
        p = used / np.maximum(used.sum(0), 1e-300)
        mixed = (used.sum(1) / max(used.sum(), 1e-300))[:, None]
        p = 0.98 * p + 0.02 * mixed
        p[single] = np.maximum(p[single], FLOOR)
    return Model(languages, np.log(np.array([share[k] for k in languages])), p, path, pieces)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, sample: int = SAMPLE, path: str | None = None) -> Model:
    """Learn from the rows whose fold is not the held-out one."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    totals = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        found: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                for run, n in Counter(words_of(text)).items():
                    for w in letters_of(run):
                        found[lang][w] += n
        for lang, c in found.items():
            yield {"lang": [lang] * len(c), "word": list(c), "n": list(c.values())}

    some = spread_sample(rows.select("text", "lang", "doc_id"), F.col("doc_id"), F.col("lang"), sample)
    counts: dict[str, Counter] = {k: Counter() for k in totals}
    for lang, word, n in map_batches(some.select("text", "lang"), count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n")).toLocalIterator():
        counts[lang][bytes(word)] += n
    return train(counts, {k: n / sum(totals.values()) for k, n in totals.items()}, path or vocabulary_path())


class Scorer:
    """Scores texts, remembering the words of earlier ones."""

    def __init__(self, model: Model):
        self.model, self.known, self.logs = model, {}, np.zeros((1, len(model.languages)))

    def learn(self, runs: list[bytes]) -> None:
        parts = [letters_of(r) for r in runs]
        words = list({w for p in parts for w in p})
        logs, at = self.model.log_words(words), {w: i for i, w in enumerate(words)}
        said = [(r, p) for r, p in zip(runs, parts, strict=True) if p]
        self.known.update(dict.fromkeys(runs, 0))
        self.known.update((r, len(self.logs) + i) for i, (r, _) in enumerate(said))
        if said:
            ids = np.fromiter((at[w] for _, p in said for w in p), np.int64)
            starts = np.cumsum([0] + [len(p) for _, p in said[:-1]])
            self.logs = np.concatenate([self.logs, np.add.reduceat(logs[ids], starts)])

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.known) > CACHED_WORDS:
            self.known, self.logs = {}, self.logs[:1]
        runs = [words_of(t) for t in texts]
        known = self.known
        new = list({r for x in runs for r in x if r not in known})
        if new:
            self.learn(new)
        names, scores = [], []
        for x in runs:
            ids = np.fromiter((known[r] for r in x), np.int64, len(x))
            ids = ids[ids > 0]
            if not len(ids) or not self.model.languages:
                names.append(NONE)
                scores.append(0.0)
                continue
            total = self.logs[ids].sum(0) + self.model.log_share
            best = int(total.argmax())
            names.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


_scorers: dict[str, Scorer] = {}


def scorer_of(key: str, languages: list[str], log_share: np.ndarray, p: np.ndarray, path: str) -> Scorer:
    """The scorer that this worker keeps for its next tasks."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(Model(languages, log_share, p, path, read_pieces(path)))
    return _scorers[key]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row. The model sent out has a number for each piece and language."""
    rows = two_columns(docs, id_col, text_col)
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((model.languages, model.log_share, model.p, model.path))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        scorer = scorer_of(key, *sent.value)
        for b in batches:
            for at in range(0, len(b["text"]), 1000):
                names, scores = scorer(b["text"][at : at + 1000])
                yield {"doc_id": b["doc_id"][at : at + 1000], "lang_pred": names, "score": scores}

    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
