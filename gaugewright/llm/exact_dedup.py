"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of each partition, merged, name every digest that more than 1/(k+1) of the rows
may carry. Their exact counts decide the winners (at most k rows, so broadcasting them is bounded);
copies of winners go on the map side and never meet in one task. All other digests are grouped by an
ordinary shuffle, in which no group can hold more than 1/(k+1) of the rows.

Defined results: a null text counts as empty; texts are compared after each run of ASCII white space
became one space (no trimming). Of equal texts the smallest doc_id stays, null ids coming last; of
rows that share that id too, any single one stays. An empty table gives an empty result. Columns
other than id and text play no part and may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.llm.common import column, cut, map_batches, two_columns

#: Counters in a summary: winners and candidates are this many at most.
COUNTERS = 256
#: Summaries meet in this many groups before the driver merges one summary of each.
MERGERS = 64
#: A filter of repeated digests has at most 2^BLOOM_BITS bits (32 MB), in maps of BITMAP.
BLOOM_BITS, PROBES, BITMAP = 28, 4, 32_768


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def merge_counts(counts: dict, k: int) -> dict:
    """At most k counters: the (k+1)th largest count comes off all."""
    if len(counts) <= k:
        return counts
    off = sorted(counts.values(), reverse=True)[k]
    return {key: n - off for key, n in counts.items() if n > off}


def misra_gries(batches: Iterable[Iterable], k: int) -> dict:
    """Summary of a stream: a key in more than 1/(k+1) of it has a counter, which is never above its true count."""
    counts: Counter = Counter()
    for batch in batches:
        counts.update(batch)
        counts = Counter(merge_counts(counts, k))
    return counts


def frequent_keys(keys: DataFrame, k: int = COUNTERS) -> list[bytes]:
    """Keys (one binary column, key) among which are all that more than 1/(k+1) of the rows hold; k at most."""

    def summarise(batches: Iterator[dict]) -> Iterator[dict]:
        found = misra_gries((b["key"] for b in batches), k)
        yield {"key": list(found), "n": list(found.values())}

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for key, n in zip(group["key"], group["n"], strict=True):
            counts[bytes(key)] += n
        found = merge_counts(counts, k)
        return pd.DataFrame({"key": list(found), "n": list(found.values())})

    parts = map_batches(keys.where(F.col("key").isNotNull()), summarise, "key binary, n long").withColumn("merger", F.pmod(F.spark_partition_id(), F.lit(MERGERS)))
    counts: Counter = Counter()
    for key, n in parts.groupBy("merger").applyInPandas(merge, "key binary, n long").toLocalIterator():  # MERGERS * k rows at most
        counts[bytes(key)] += n
    return list(merge_counts(counts, k))


def winners(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """Digest, smallest id and exact count of each digest that 1/(k+1) of the rows or more hold: k rows at most."""
    spark = digests.sparkSession
    candidates = frequent_keys(digests.select(F.col("digest").alias("key")), k)
    rows = []
    if candidates:
        few = F.broadcast(spark.createDataFrame([(bytearray(c),) for c in candidates], "digest binary"))
        exact = digests.join(few, "digest").groupBy("digest").agg(F.min("doc_id").alias("heavy_id"), F.count(F.lit(1)).alias("heavy_n"))
        total = digests.count()
        rows = [(bytearray(r.digest), r.heavy_id, r.heavy_n) for r in exact.collect() if r.heavy_n > 1 and r.heavy_n * (k + 1) >= total and r.heavy_id is not None]
    kind = digests.schema["doc_id"].dataType.simpleString()
    return spark.createDataFrame(rows, f"digest binary, heavy_id {kind}, heavy_n long")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """A row for each input row: doc_id, digest, keep_id, group_size, kept."""
    rows = two_columns(docs, id_col, text_col)
    digests = cut(rows.select("doc_id", text_digest(F.col("text")).alias("digest")), "digests")
    split = digests.join(F.broadcast(winners(digests, k)), "digest", "left")
    loser = F.col("heavy_n").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("heavy_id"))
    rest = split.where(~loser).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"), F.first("heavy_id").alias("heavy_id"), F.first("heavy_n").alias("heavy_n"))
    # counts and minima are combined before the shuffle; rows that share id and text come out again one by one
    groups = rest.groupBy("digest").agg(F.min("doc_id").alias("least"), F.sum("copies").alias("size"))
    rest = rest.join(groups, "digest").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rest = rest.select(
        "doc_id", "digest", F.coalesce("heavy_id", "least").alias("keep_id"), F.coalesce("heavy_n", "size").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.coalesce("heavy_id", "least")) & (F.col("nth") == 1)).alias("kept"),
    )
    return split.where(loser).select("doc_id", "digest", F.col("heavy_id").alias("keep_id"), F.col("heavy_n").alias("group_size"), F.lit(False).alias("kept")).unionByName(rest)


def repeated_bits(digests: DataFrame, most: int) -> np.ndarray:
    """A Bloom filter, as bits, of the digests that occur more than once. It has 2^`most` bits at most: a filter that is too small lets more through, never less."""
    repeated = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    size = 1 << min(most, max(BITMAP.bit_length() - 1, (repeated.count() * 12).bit_length()))
    places = repeated.select(F.explode(bloom_places(F.col("digest"), size)).alias("place"))
    maps = places.groupBy(F.floor(F.col("place") / BITMAP).cast("int").alias("at")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(BITMAP))).alias("bits"))
    out = np.zeros(size // 8, np.uint8).reshape(-1, BITMAP // 8)
    for at, bits in maps.toLocalIterator():
        out[at] = np.frombuffer(bytes(bits), np.uint8)
    return out.ravel()


def bloom_places(digest: Column, size: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(size)) for i in range(PROBES)])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS, bits: int = BLOOM_BITS) -> DataFrame:
    """The rows of docs, all columns, that stay: one of each text. Only texts whose digest may occur again, by a Bloom filter, are shuffled."""
    digests = cut(two_columns(docs, id_col, text_col).select("doc_id", text_digest(F.col("text")).alias("digest")), "digests")
    sent = docs.sparkSession.sparkContext.broadcast(repeated_bits(digests, bits))

    @F.pandas_udf("boolean")
    def perhaps_repeated(places: pd.Series) -> pd.Series:
        at = np.array(places.tolist(), np.int64).reshape(len(places), -1)
        return pd.Series(((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1))

    row = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("row"), column(docs, id_col).alias("doc_id"), text_digest(column(docs, text_col)).alias("digest"))
    row = row.withColumn("perhaps", perhaps_repeated(bloom_places(F.col("digest"), len(sent.value) * 8)))
    light = row.where("perhaps").join(F.broadcast(winners(digests, k)), "digest", "left").where(F.col("heavy_n").isNull() | F.col("doc_id").eqNullSafe(F.col("heavy_id")))
    first = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("doc_id").asc_nulls_last()))
    return row.where("not perhaps").select("row.*").unionByName(light.withColumn("nth", first).where("nth = 1").select("row.*"))
