"""N-gram Jaccard join by prefix trees: documents whose sets of word shingles are similar, and their components.

1. Each text becomes the set of its shingle hashes; texts with the same set are one class. A sketch of
   fixed size counts shingles by hash bucket over all documents.
2. The global order of shingles is (count of its bucket, hash): rare ones first. Of two sets that reach
   the threshold, each has a common shingle within its first n - ceil(t n) + 1. Classes are dealt by
   those shingles. Buckets never count too little, so a shingle's group is known to be at most its
   bucket's count; shingles of high counts are salted.
3. Groups of up to SMALL classes give their pairs, less those that the lengths and the places of the
   shingle rule out. In larger groups all members are compared with one, the pivot: the member with the
   smallest share of rarer shingles, which of edited copies is the one that the others come from. Members that link
   with it are one component. Jaccard distance is a metric, so others can link with those only if
   their similarities to the pivot differ by 1 - t at most; these pairs are compared, and the others
   form the group of the next round. After ROUNDS rounds the rest gives its pairs. Pairs in groups of
   either kind are left out where the places of the shingle rule them out: if it is the first that they
   share, what follows it is all they can share; if it isn't, they meet in the group of the first.
4. Pairs are verified by probe: the ordered sets of a probe's candidates form a trie, which is walked
   once; sets that share a path share its overlap, a set ends where the overlap so far and the length
   that remains can't reach the threshold, and a subtree where no length could. Texts are fetched once per class that has candidates.
5. Links make components; each document gets the smallest doc_id of its component.

Words are runs of other characters than ASCII white space, with A-Z in lower case. A text of fewer
words than a shingle has its whole sequence as its only one; null texts and texts without words
have the empty set and no links: component_id is their doc_id. Rows that repeat a doc_id count as
documents of their own with the same id. A null doc_id is the smallest of no component: its row takes
the smallest id of the others, null if there is none. Empty tables give no rows; columns other than
id and text play no part. Shingles are compared by 64-bit hashes of digests of their words, sets by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.common import column, cut, drop_cut, map_batches, matched, release, two_columns
from gaugewright.llm.components import components
from gaugewright.llm.words import Runs, hashed

SHINGLE, PERCENT = 5, 75
SKETCH_BITS, SLICE, MERGERS = 20, 4096, 64
SMALL, ROUNDS = 8, 2
SEEN_CLASSES, TRIE = 500_000, 512


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for words, _ in hashed(texts, lower=True):
        if not len(words):
            yield words
        elif len(words) < size:
            yield Runs(words)(np.array([0]), np.array([len(words)]))
        else:
            yield np.unique(Runs(words).every(size))


def class_of(shingles: np.ndarray, taken: frozenset[int] = frozenset()) -> tuple[int, int]:
    """Two 64-bit numbers of a set; the first is its class unless other sets have `taken` it."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    first, second = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
    return (second, first) if first in taken else (first, second)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n // 100) + 1


def enough(common: int, n: int, m: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (n + m - common)


def classify(rows: DataFrame, size: int, bits: int) -> DataFrame:
    """Rows (doc_id, hash of the text, class, n) of the documents, and rows (slice, counts) of this partition's part of the sketch."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counts = np.zeros(1 << bits, np.int64)
        for b in batches:
            for at in range(0, len(b["text"]), 1000):
                sets = list(shingle_sets(b["text"][at : at + 1000], size))
                counts += np.bincount((np.concatenate(sets) & np.uint64(len(counts) - 1)).astype(np.int64), minlength=len(counts))
                k, both = len(sets), [class_of(s) if len(s) else (None, None) for s in sets]
                yield {"doc_id": b["doc_id"][at : at + 1000], "hash": b["hash"][at : at + 1000], "class": [c for c, _ in both], "other": [c for _, c in both], "n": [len(s) for s in sets], "slice": [None] * k, "counts": [None] * k}
        parts = counts.reshape(-1, min(SLICE, len(counts)))
        used = np.flatnonzero(parts.any(1))
        nothing = [None] * len(used)
        yield {"doc_id": nothing, "hash": nothing, "class": nothing, "other": nothing, "n": nothing, "slice": used, "counts": [parts[i].astype("<i8").tobytes() for i in used]}

    return map_batches(rows.withColumn("hash", F.xxhash64("text")), run, f"doc_id {kind}, hash long, class long, other long, n long, slice int, counts binary")


def merged_sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """The sum of all partitions' sketches: 2^bits counts, whatever the input."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<i8") for c in group["counts"])
        return pd.DataFrame({"slice": [group["slice"].iloc[0]], "counts": [total.tobytes()]})

    few = parts.withColumn("merger", F.pmod(F.xxhash64("counts"), F.lit(MERGERS))).groupBy("slice", "merger").applyInPandas(add, "slice int, counts binary")
    out = np.zeros((1 << bits) // min(SLICE, 1 << bits) * min(SLICE, 1 << bits), np.int64).reshape(-1, min(SLICE, 1 << bits))
    for r in few.groupBy("slice").applyInPandas(add, "slice int, counts binary").toLocalIterator():
        out[r["slice"]] = np.frombuffer(bytes(r["counts"]), "<i8")
    return out.ravel()


def ordered(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """In global order: by the count of the bucket, then by hash."""
    return shingles[np.lexsort((shingles, counts[(shingles & np.uint64(len(counts) - 1)).astype(np.int64)]))]


def prefixes(rows: DataFrame, sent, limit: int, size: int, percent: int, taken: frozenset[int]) -> DataFrame:
    """(token, salt, class, n, place) for the prefix of each class that a partition has; salt is -1 for groups known to be within the limit."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counts, seen = sent.value, set()
        for b in batches:
            for at in range(0, len(b["text"]), 1000):
                tokens, classes, sizes, places = [], [], [], []
                for s in shingle_sets(b["text"][at : at + 1000], size):
                    if len(s) and (c := class_of(s, taken)[0]) not in seen:
                        if len(seen) >= SEEN_CLASSES:
                            seen.clear()
                        seen.add(c)
                        p = ordered(s, counts)[: prefix_length(len(s), percent)]
                        tokens.append(p)
                        classes.append(np.full(len(p), c))
                        sizes.append(np.full(len(p), len(s)))
                        places.append(np.arange(len(p)))
                if tokens:
                    token, cls = np.concatenate(tokens), np.concatenate(classes)
                    found = counts[(token & np.uint64(len(counts) - 1)).astype(np.int64)]
                    salt = np.where(found > limit, (cls & 0x7FFFFFFF) % (found // limit + 1), -1)
                    yield {"token": token.view(np.int64), "salt": salt, "class": cls, "n": np.concatenate(sizes), "place": np.concatenate(places)}

    return map_batches(rows.select("text"), run, "token long, salt int, class long, n long, place int")


CANDIDATES = "big boolean, token long, a long, n long, b long, m long, place int"


def candidates(dealt: DataFrame, percent: int) -> DataFrame:
    """From prefix rows sorted by token, salt and class: pairs (a, n, b, m) of small groups, and the members (token, a, n) of big ones."""

    def small(c: list, n: list, at: list) -> Iterator[tuple]:
        for j in range(1, len(c)):
            for i in range(j):
                lo, hi = (n[i], n[j]) if n[i] < n[j] else (n[j], n[i])
                most = 1 + min(n[i] - at[i], n[j] - at[j]) - 1
                if 100 * lo >= percent * hi and enough(min(most, lo), n[i], n[j], percent):
                    yield (c[i], n[i], c[j], n[j]) if c[i] < c[j] else (c[j], n[j], c[i], n[i])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[np.ndarray] | None = None
        names = ("token", "salt", "class", "n", "place")

        def groups(cols: list[np.ndarray], ends: bool) -> tuple[dict, list[np.ndarray] | None]:
            token, salt, cls = cols[:3]
            fresh = np.ones(len(token), bool)  # first row of each token, salt and class
            fresh[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (cls[1:] != cls[:-1])
            cols = [c[fresh] for c in cols]
            token, salt = cols[:2]
            starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
            lengths = np.diff(np.r_[starts, len(token)])
            rest = None
            if not ends:
                rest, starts, lengths = [c[starts[-1] :] for c in cols], starts[:-1], lengths[:-1]
            many = (lengths > SMALL) | (salt[starts] >= 0)
            rows = np.concatenate([np.arange(s, s + k) for s, k in zip(starts[many], lengths[many], strict=True)] or [np.zeros(0, np.int64)])
            pairs = {p for s, k in zip(starts[~many & (lengths > 1)].tolist(), lengths[~many & (lengths > 1)].tolist(), strict=True) for p in small(*[c[s : s + k].tolist() for c in cols[2:]])}
            made = list(pairs)
            nothing = [None] * len(rows)
            return {
                "big": [True] * len(rows) + [False] * len(made), "token": cols[0][rows].tolist() + [None] * len(made), "a": cols[2][rows].tolist() + [p[0] for p in made],
                "n": cols[3][rows].tolist() + [p[1] for p in made], "b": nothing + [p[2] for p in made], "m": nothing + [p[3] for p in made], "place": cols[4][rows].tolist() + [None] * len(made),
            }, rest

        for b in batches:
            cols = [b[c].astype(np.int64) for c in names]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if len(cols[0]):
                out, held = groups(cols, False)
                yield out
        if held is not None:
            yield groups(held, True)[0]

    return map_batches(dealt, run, CANDIDATES, arrays=True)


class Probe:
    """Walks the trie of a probe's candidates."""

    def __init__(self, probe: np.ndarray):
        self.probe = np.sort(probe)

    def hits(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.probe, tokens), len(self.probe) - 1)
        return self.probe[at] == tokens

    def overlaps(self, sets: list[np.ndarray], percent: int) -> list[int | None]:
        """The overlap with each of the sets (in global order); None where it was found not to reach the percentage."""
        out: list[int | None] = [None] * len(sets)
        path, sums, depth = np.zeros(0, np.uint64), np.zeros(1, np.int64), 0  # the last set, its running overlap, and how far that is known
        left, whole = None, len(self.probe)  # depth of the node whose subtree was given up
        for k in sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes()):
            s = sets[k]
            shared = min(len(path), len(s), depth)
            differ = np.flatnonzero(path[:shared] != s[:shared])
            depth = int(differ[0]) if len(differ) else shared
            if left is not None and depth >= left:
                depth = left
                continue  # path stays: what comes next is compared with the set at which the subtree was given up
            left = None
            running = np.zeros(len(s) + 1, np.int64)
            running[: depth + 1] = sums[: depth + 1]
            while True:
                have = int(running[depth])
                most = have + min(len(s) - depth, whole - have)
                if not enough(min(most, len(s)), len(s), whole, percent):
                    if not enough(whole, whole + depth - have, whole, percent):
                        left = depth  # whatever the length of a set below this node, it misses too much already
                    break
                if depth == len(s):
                    out[k] = have
                    break
                end = min(len(s), depth + 128)
                running[depth + 1 : end + 1] = have + np.cumsum(self.hits(s[depth:end]))
                depth = end
            path, sums = s, running
        return out


def verify(pairs: DataFrame, texts: DataFrame, sent, size: int, percent: int) -> DataFrame:
    """(a, n, b, m, common) of each pair whose similarity reaches the percentage, for distinct pairs of classes."""
    of_b = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    of_a = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    full = pairs.join(of_b, "b").join(of_a, "a").select("a", "n", "b", "m", "text_a", "text_b").sortWithinPartitions("a")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counts, sets = sent.value, {}

        def fetch(c: int, text: str) -> np.ndarray:
            if c not in sets:
                if len(sets) > 4096:
                    sets.clear()
                sets[c] = ordered(next(shingle_sets([text], size)), counts)
            return sets[c]

        for b in batches:
            start, a = 0, b["a"]
            out: dict = {c: [] for c in ("a", "n", "b", "m", "common")}
            while start < len(a):
                end = start + 1
                while end < len(a) and end - start < TRIE and a[end] == a[start]:
                    end += 1
                probe = Probe(fetch(a[start], b["text_a"][start]))
                found = probe.overlaps([fetch(b["b"][i], b["text_b"][i]) for i in range(start, end)], percent)
                for i, common in zip(range(start, end), found, strict=True):
                    if common is not None:
                        for c in ("a", "n", "b", "m"):
                            out[c].append(b[c][i])
                        out["common"].append(common)
                start = end
            yield out

    return map_batches(full, run, "a long, n long, b long, m long, common long")


def similarity() -> Column:
    return F.col("common") / (F.col("n") + F.col("m") - F.col("common"))


def fits(n: str, m: str, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def reachable(n: str, place: str, m: str, other: str, percent: int) -> Column:
    """Whether sets of n and m shingles can reach the percentage if their first common shingle is at these places."""
    most = F.least(F.col(n) - F.col(place), F.col(m) - F.col(other))
    return most * 100 >= (F.col(n) + F.col(m) - most) * percent


def ascending(df: DataFrame, x: str, nx: str, y: str, ny: str) -> DataFrame:
    """Pairs as (a, n, b, m) with a before b."""
    forth = F.col(x) < F.col(y)
    one = lambda p, q: F.when(forth, F.col(p)).otherwise(F.col(q))
    return df.select(one(x, y).alias("a"), one(nx, ny).alias("n"), one(y, x).alias("b"), one(ny, nx).alias("m"))


def links_of(docs: DataFrame, sets: DataFrame, sketch: np.ndarray, size: int, percent: int, taken: frozenset[int]) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): links between classes that have the same components as all links; and the tables written for them."""
    spark, written = docs.sparkSession, []

    def cut_here(df: DataFrame, name: str) -> DataFrame:
        written.append(cut(df, name))
        return written[-1]

    sent = spark.sparkContext.broadcast(sketch)
    limit = int(4 * sketch.mean()) + 64
    dealt = prefixes(docs, sent, limit, size, percent, taken).repartition("token", "salt").sortWithinPartitions("token", "salt", "class")
    found = cut_here(candidates(dealt, percent), "candidates")
    release(spark)
    pairs = found.where("not big").select("a", "n", "b", "m")
    big = found.where("big").select("token", F.col("a").alias("c"), "n", "place").distinct()

    involved = found.select(F.col("a").alias("class")).unionByName(found.where("not big").select(F.col("b").alias("class"))).distinct()
    owners = sets.where("n > 0").groupBy("class").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "hash"))).alias("owner"), F.min("hash").alias("any")).join(involved, "class")
    named = owners.where("owner is not null").select("class", F.col("owner.doc_id").alias("owner"), F.col("owner.hash").alias("of"))
    joined = docs.join(named, (docs["doc_id"] == named["owner"]) & (F.xxhash64(docs["text"]) == named["of"])).select("class", "text")  # rows that share an id may have other texts
    nameless = owners.where("owner is null").select("class", F.col("any").alias("of"))
    single = docs.where("doc_id is null and text is not null").groupBy(F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text"))
    texts = cut_here(joined.unionByName(single.join(nameless, F.col("hash") == F.col("of")).select("class", "text")), "texts")
    release(spark)
    least = 2 * percent - 100  # below this a member is too far from the pivot to link with any that links with it
    links = []

    def compared(asked: DataFrame) -> DataFrame:
        """The pairs, each once, that reach `least`; links are kept. Few pairs are known to be few, and are broadcast to the texts."""
        found = cut_here(verify(cut_here(asked.distinct(), "pairs"), texts, sent, size, least), "compared")
        links.append(found.where(F.col("common") * 100 >= (F.col("n") + F.col("m") - F.col("common")) * percent).select("a", "b"))
        return found

    asked = pairs
    for r in range(ROUNDS + 1):
        sizes = big.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct((F.col("place") / F.col("n")).alias("share"), "c", "n")).alias("pivot")).where("members > 1")
        group = cut_here(big.join(sizes, "token").select("token", "c", "n", "place", "members", F.col("pivot.c").alias("p"), F.col("pivot.n").alias("q")), "groups")
        last = r == ROUNDS
        few, many = (group.where(w) for w in ((F.lit(last) | (F.col("members") <= SMALL)), ~F.lit(last) & (F.col("members") > SMALL)))
        other = few.select("token", F.col("c").alias("b"), F.col("n").alias("m"), F.col("place").alias("other"))
        asked = asked.unionByName(few.withColumnRenamed("c", "a").join(other, "token").where(F.col("a") < F.col("b")).where(fits("n", "m", percent) & reachable("n", "place", "m", "other", percent)).select("a", "n", "b", "m"))
        asked = asked.unionByName(ascending(many.where(F.col("c") != F.col("p")).where(fits("n", "q", least)), "p", "q", "c", "n"))
        near = compared(asked)
        if last or many.isEmpty():
            break
        near = near.select(F.col("a").alias("lo"), F.col("b").alias("hi"), similarity().alias("s"), (F.col("common") * 100 >= (F.col("n") + F.col("m") - F.col("common")) * percent).alias("linked"))
        state = many.withColumns({"lo": F.least("p", "c"), "hi": F.greatest("p", "c")}).join(near, ["lo", "hi"], "left")
        pivot = F.col("c") == F.col("p")
        state = cut_here(state.select("token", "c", "n", "place", F.when(pivot, 1.0).otherwise(F.col("s")).alias("s"), (pivot | F.coalesce("linked", F.lit(False))).alias("linked")), "states")
        inside = state.where("linked").select("token", F.col("c").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"), F.col("s").alias("sx"))
        outside = state.where(~F.col("linked") & F.col("s").isNotNull()).select("token", F.col("c").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"), F.col("s").alias("sy"))
        cross = inside.join(outside, "token").where((F.col("sx") - F.col("sy") <= 1 - percent / 100 + 1e-9) & fits("nx", "ny", percent) & reachable("nx", "px", "ny", "py", percent))
        asked = ascending(cross, "x", "nx", "y", "ny")  # compared with the next round's pairs
        big = state.where(~F.col("linked")).select("token", "c", "n", "place")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out, written


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bits: int = SKETCH_BITS) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id."""
    return components_of(docs, id_col, text_col, shingle, percent, bits).select("doc_id", "n_shingles", "component_id")


def components_of(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, bits: int = SKETCH_BITS) -> DataFrame:
    """A row for each document: doc_id, hash of the text, n_shingles, component_id."""
    rows = two_columns(docs, id_col, text_col)
    first = cut(classify(rows, shingle, bits), "sets")
    sets = first.where("slice is null")
    # different sets that share 64 bits (24 in 3 * 10^10 by chance) take their other 64
    shared = sets.where("class is not null").groupBy("class").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high")
    taken = frozenset(r["class"] for r in shared.select("class").toLocalIterator())
    own = F.when(F.col("class").isin(list(taken)), F.col("other")).otherwise(F.col("class")) if taken else F.col("class")
    sets = sets.select("doc_id", "hash", own.alias("class"), "n")
    sketch = merged_sketch(first.where("slice is not null").select("slice", "counts"), bits)
    links, written = links_of(rows, sets, sketch, shingle, percent, taken)
    roots = components(links)
    low = sets.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("low"))
    rooted = low.join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "low", F.coalesce("root", "class").alias("root"))
    ids = cut(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.struct(F.min("low").alias("component_id")).alias("of")), "roots")
    named = cut(matched(rooted, ids, "root", ("class",)).select(F.col("class").alias("of"), "of.component_id"), "classes")
    written.append(ids)
    for table in written:
        drop_cut(table)
    release(docs.sparkSession)
    full = sets.where("n > 0").join(named, F.col("class") == F.col("of")).select("doc_id", "hash", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(sets.where("n = 0").select("doc_id", "hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of their component; rows with null ids stay if their component has no id.

    Rows are removed by id and text: of rows that share an id, each goes by its own component.
    """
    found = components_of(docs, id_col, text_col, shingle, percent)
    gone = found.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "hash").distinct()
    return docs.join(gone, column(docs, id_col).eqNullSafe(gone["doc_id"]) & (F.xxhash64(column(docs, text_col)) == gone["hash"]), "left_anti")
