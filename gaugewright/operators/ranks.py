"""Row numbers, predecessors and exact quantiles in one order over a whole table, without bringing it into one partition.

Rows are dealt to buckets between approximate quantiles of the order; windows run inside buckets, and
the buckets' counts and ends (a few numbers, whatever the input) join them up. Where the quantiles lie
changes how rows are dealt, never the result. Buckets grow in number with the table, so that each keeps
about BUCKET rows; rows of one value are split by a hash of their tiebreak.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.exprs import col, number

#: Rows of a bucket, and how many buckets there are at least and at most (their ends are literals of the plan).
BUCKET, BUCKETS, MOST = 2_000_000, 64, 4096
#: Values that one task may hold for a quantile; a bracket between approximate quantiles, with this accuracy, holds less of more.
SMALL, ACCURACY = 1_000_000, 10_000


def with_bucket(df: DataFrame, order: Column, buckets: int | None = None) -> tuple[DataFrame, int]:
    """_x (the order as a long or double) and _bucket, from 0 up with the order; 0 for NULL, which comes first."""
    df = df.withColumn("_x", order)
    buckets = buckets or min(MOST, max(BUCKETS, -(-df.count() // BUCKET)))
    cuts = sorted(set(df.agg(F.percentile_approx("_x", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []))
    below = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    return df.withColumn("_bucket", F.when(F.col("_x").isNull(), 0).otherwise(F.size(F.filter(below, lambda c: c < F.col("_x"))) + 1)), len(cuts) + 2


def row_numbers(df: DataFrame, order: Column, tiebreak: Sequence[str] = (), out: str = "n") -> DataFrame:
    """Numbers from 1 in the order (NULL first), ties by the tiebreak columns."""
    dealt, buckets = with_bucket(df, order)
    counts = {r[0]: r[1] for r in dealt.groupBy("_bucket").count().collect()}
    offsets = [0, *accumulate(counts.get(b, 0) for b in range(buckets))]
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_x", *[col(t) for t in tiebreak]))
    return dealt.withColumn(out, within + F.get(F.array(*[F.lit(o) for o in offsets]), F.col("_bucket"))).drop("_x", "_bucket")


def previous(df: DataFrame, order: Column, out: str = "previous") -> DataFrame:
    """The order's value one row before; NULL for the first. For values that are there."""
    dealt, buckets = with_bucket(df, order)
    ends = dict(sorted((r[0], r[1]) for r in dealt.groupBy("_bucket").agg(F.max("_x")).collect()))
    filled = list(ends)
    before = [ends[filled[k - 1]] if (k := bisect_left(filled, b)) else None for b in range(buckets)]
    kind = dealt.schema["_x"].dataType
    last = F.get(F.array(*[F.lit(v).cast(kind) for v in before]), F.col("_bucket"))
    return dealt.withColumn(out, F.coalesce(F.lag("_x").over(Window.partitionBy("_bucket").orderBy("_x")), last)).drop("_x", "_bucket")


def unpivoted(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """key, value: a row for each named column of each row that has a number there."""
    pairs = F.array(*[F.struct(F.lit(name).alias("key"), number(c).alias("value")) for name, c in columns.items()])
    return df.select(F.explode(pairs).alias("p")).select("p.key", "p.value").where("value is not null")


def quantiles(df: DataFrame, probabilities: Sequence[float], small: int = SMALL) -> dict[str | None, tuple[int, list[float]]]:
    """For each key of (key, value), of which there are few: how many values, and their exact quantiles (linear interpolation).

    Keys of up to `small` values are done in one task each. For larger ones each order statistic is
    looked for between two approximate quantiles that enclose it, and again among what lies there.
    """
    df = df.where("value is not null")
    n = {r.key: r.n for r in df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    if max(n.values(), default=0) <= small:
        found = df.groupBy("key").agg(F.percentile("value", F.array(*[F.lit(float(p)) for p in probabilities])).alias("q")).collect()
        return {r.key: (n[r.key], [float(x) for x in r.q]) for r in found}
    places = {key: [p * (m - 1) for p in probabilities] for key, m in n.items()}
    wanted = {key: sorted({r for x in at for r in (floor(x), ceil(x))}) for key, at in places.items()}
    got = order_statistics(df, wanted, n, small)
    between = lambda key, x: got[key, floor(x)] + (got[key, ceil(x)] - got[key, floor(x)]) * (x - floor(x))
    return {key: (n[key], [between(key, x) for x in at]) for key, at in places.items()}


def order_statistics(df: DataFrame, wanted: dict[str | None, list[int]], n: dict[str | None, int], small: int) -> dict[tuple[str | None, int], float]:
    """The values of the wanted places (from 0) in each key's order."""
    spark = df.sparkSession
    around = lambda key, r: (max(0.0, r / n[key] - 2 / ACCURACY), min(1.0, (r + 1) / n[key] + 2 / ACCURACY))
    asked = sorted({q for key, ranks in wanted.items() for r in ranks for q in around(key, r)})
    ends = {r.key: dict(zip(asked, r.q, strict=True)) for r in df.groupBy("key").agg(F.percentile_approx("value", asked, ACCURACY).alias("q")).collect()}
    rows = [(key, r, *(float(ends[key][q]) for q in around(key, r))) for key, ranks in wanted.items() for r in ranks]
    brackets = spark.createDataFrame(rows, "of string, place long, low double, high double")  # a row for each quantile
    joined = df.join(F.broadcast(brackets), F.col("key").eqNullSafe(F.col("of")))
    inside = F.col("value").between(F.col("low"), F.col("high"))
    counts = joined.groupBy("of", "place").agg(F.count_if(F.col("value") < F.col("low")).alias("below"), F.count_if(inside).alias("inside"), F.min("low").alias("low"), F.min("high").alias("high")).collect()
    out = {(c.of, c.place): c.low for c in counts if c.low == c.high}
    name = {f"{i}": c for i, c in enumerate(counts) if c.low < c.high}
    if not name:
        return out
    part = F.coalesce(*[F.when(F.col("of").eqNullSafe(F.lit(c.of)) & (F.col("place") == c.place), F.lit(k)) for k, c in name.items()])
    rest = joined.where(inside).select(part.alias("key"), "value").where("key is not null")
    if max(c.inside for c in name.values()) <= small:
        values = {r.key: r.v for r in rest.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("v")).select("key", F.element_at("v", at_place(name)).alias("v")).collect()}
        return out | {(name[k].of, name[k].place): float(v) for k, v in values.items()}
    deeper = order_statistics(rest, {k: [c.place - c.below] for k, c in name.items()}, {k: c.inside for k, c in name.items()}, small)
    return out | {(name[k].of, name[k].place): v for (k, _), v in deeper.items()}


def at_place(name: dict) -> Column:
    """Where (from 1) in its bracket the wanted value of each key is."""
    return F.coalesce(*[F.when(F.col("key") == k, F.lit(int(c.place - c.below + 1))) for k, c in name.items()])
