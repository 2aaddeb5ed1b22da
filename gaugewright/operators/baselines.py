"""Baselines learned from data: each learner is a few aggregations and gives a DataFrame.

Quantiles are exact (linear interpolation); over whole tables they are looked for by ranks.quantiles, so
no task holds all values. Learners that need a minimum of samples give NULL below it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.exprs import col, corr, decimals, micros, number, ratio, seconds_between
from gaugewright.operators.checks import entity_key
from gaugewright.operators.ranks import previous, quantiles, unpivoted


def bands(df: DataFrame, columns: dict[str, Column], least: int = 0) -> dict[str, dict[str, float | int | None]]:
    """q25, q50, q75 and n of each named column."""
    found = quantiles(unpivoted(df, columns), (0.25, 0.5, 0.75))
    return {name: dict(zip(("q25", "q50", "q75"), q if n >= max(least, 1) else [None] * 3, strict=True)) | {"n": n} for name in columns for n, q in [found.get(name, (0, []))]}


def band(df: DataFrame, x: Column, least: int = 0) -> DataFrame:
    """q25, q50, q75 and n of a column, as one row."""
    return one_row(df, bands(df, {"x": x}, least)["x"], "q25 double, q50 double, q75 double, n long")


def one_row(df: DataFrame, values: Mapping, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(values.values())], schema)


def unpivot(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, metric, value: a row for each metric of each row."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), number(col(m)).alias("value")) for m in metrics])
    return df.select(*[col(k) for k in keys], F.explode(pairs).alias("_p")).select(*keys, "_p.metric", "_p.value")


def statistics(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """AGG-16: mean, std (n - 1), MAD, percentiles, min, max, count per metric. MAD takes a second pass."""
    long = unpivot(df, metrics).where("value is not null")
    v, shares = F.col("value"), (5, 25, 50, 75, 95)
    found = quantiles(long.select(F.col("metric").alias("key"), "value"), [q / 100 for q in shares])
    middle = {m: q[2] for m, (_, q) in found.items()}
    apart = quantiles(unpivoted(df, {m: F.abs(number(col(m)) - F.lit(x)) for m, x in middle.items()}), [0.5]) if middle else {}
    learned = df.sparkSession.createDataFrame([(m, *q, apart[m][1][0]) for m, (_, q) in found.items()], "metric string, " + ", ".join(f"p{q} double" for q in shares) + ", mad double")
    first = long.groupBy("metric").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"))
    return first.join(F.broadcast(learned), "metric")  # a row for each metric


def field_ranges(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """AGG-22: min, max, p01, p99, median, count per metric."""
    v, long = F.col("value"), unpivot(df, metrics)
    found = quantiles(long.select(F.col("metric").alias("key"), "value"), (0.01, 0.99, 0.5))
    learned = df.sparkSession.createDataFrame([(m, *q) for m, (_, q) in found.items()], "metric string, p01 double, p99 double, median double")
    return long.groupBy("metric").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count")).join(F.broadcast(learned), "metric", "left")  # a row for each metric


def histogram(df: DataFrame, metric: str, bins: int = 50, discrete: bool = False) -> DataFrame:
    """AGG-17: bin, low, density. Equal widths from min to max, the last bin closed; unit bins for discrete metrics. Empty bins are there."""
    x = number(col(metric))
    rows = df.select(x.alias("_x")).where("_x is not null")
    low, high, n = rows.agg(F.min("_x"), F.max("_x"), F.count("_x")).first()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "bin long, low double, density double")
    if discrete:
        first, count, width = round(low + 0.5 - 0.5), int(high + 0.5) - int(low + 0.5) + 1, 1.0
        place = F.floor(F.col("_x") + 0.5).cast("long") - F.lit(int(low + 0.5))
        first = float(int(low + 0.5))
    else:
        first, count, width = low, bins, (high - low) / bins or 1.0
        place = F.least(F.floor((F.col("_x") - low) / width).cast("long"), F.lit(bins - 1))
    counts = rows.select(place.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("c"))
    return spark.range(count).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", (F.lit(first) + F.col("bin") * width).alias("low"), (F.coalesce("c", F.lit(0)) / F.lit(float(n))).alias("density"))


def zero_rate_band(df: DataFrame, metric: str, by: str, among_rows: bool = True) -> DataFrame:
    """AGG-19/20: share of zeros per entity or time, then its quartiles over those. The share is of all rows; entities with only NULLs are left out."""
    x = number(col(metric))
    each = df.groupBy(col(by).alias("_by")).agg((F.count_if(x == 0) / (F.count(F.lit(1)) if among_rows else F.count(x))).alias("rate"), F.count(x).alias("some")).where("some > 0")
    return band(each, F.col("rate"))


def correlation(df: DataFrame, x: str, y: str, least: int = 11) -> DataFrame:
    """AGG-18: Pearson correlation of complete pairs, of `least` or more."""
    a, b = number(col(x)), number(col(y))
    n = F.count(F.when(a.isNotNull() & b.isNotNull(), 1))
    return df.agg(F.when(n >= least, corr(a, b)).alias("r"), n.alias("n"))


def correlation_band(df: DataFrame, x: str, y: str, entity: str, least: int = 30) -> DataFrame:
    """AGG-21: Pearson r per entity of `least` pairs or more, then its quartiles."""
    a, b = number(col(x)), number(col(y))
    n = F.count(F.when(a.isNotNull() & b.isNotNull(), 1))
    return band(df.groupBy(col(entity)).agg(F.when(n >= least, corr(a, b)).alias("r")), F.col("r"))


def hourly_template(df: DataFrame, ts: str, entity: str, default_median: float, default_iqr: float) -> DataFrame:
    """AGG-23: median and IQR of the distinct entities of a time, for each hour of the day; 24 rows, defaults where there are no rows."""
    each = df.where(col(ts).isNotNull()).groupBy(col(ts).alias("_ts")).agg(F.countDistinct(col(entity)).alias("_n"))
    found = each.groupBy(F.hour("_ts").alias("hour")).agg(F.percentile("_n", 0.5).alias("m"), (F.percentile("_n", 0.75) - F.percentile("_n", 0.25)).alias("i"))
    return df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(found, "hour", "left").select("hour", F.coalesce("m", F.lit(float(default_median))).alias("median"), F.coalesce("i", F.lit(float(default_iqr))).alias("iqr"))


def gaps(streams: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Gaps in seconds between the distinct times of all streams."""
    times = None
    for df, ts in streams:
        t = df.select(micros(col(ts)).alias("us")).where("us is not null").distinct()
        times = t if times is None else times.unionByName(t)
    return previous(times.distinct(), F.col("us")).select(((F.col("us") - F.col("previous")) / 1e6).alias("gap")).where("gap is not null")


def cadence(streams: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """AGG-24: cadence (median gap) and resolution (least positive gap) in seconds."""
    found = gaps(streams)
    middle = quantiles(found.select(F.lit("gap").alias("key"), F.col("gap").alias("value")), [0.5]).get("gap")
    least = found.agg(F.min(F.when(F.col("gap") > 0, F.col("gap"))).alias("resolution"))
    return least.select(F.lit(middle[1][0] if middle else None).cast("double").alias("cadence"), "resolution")


def printed_decimals(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """AGG-25: the commonest number of digits after the point; the least one on ties."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), decimals(col(m)).alias("d")) for m in metrics])).alias("p")).select("p.metric", "p.d")
    counts = long.where("d is not null").groupBy("metric", "d").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("metric").agg(F.max(F.struct("n", (-F.col("d")).alias("d"))).alias("best")).select("metric", (-F.col("best.d")).alias("decimals"))


def energy_power_band(df: DataFrame, interval: str, power: str, entity: str, ts: str, flags: Sequence[str] = (), least: int = 30) -> DataFrame:
    """AGG-26: quartiles of interval energy over power times the time since the entity's row before."""
    before = F.lag(col(ts)).over(Window.partitionBy(*entity_key(entity, ts)).orderBy(col(ts)))
    hours = seconds_between(col(ts), F.when(col(entity).isNotNull(), before)) / 3600
    r = df.withColumn("_r", ratio(number(col(interval)), number(col(power)) / 1000 * hours))
    for f in flags:
        r = r.withColumn("_r", F.when(~F.coalesce(col(f), F.lit(False)), F.col("_r")))
    return band(r, F.col("_r"), least)


def ratio_band(ratios: DataFrame, value: str = "ratio", least: int = 30) -> DataFrame:
    """AGG-27: quartiles of reconciled ratios."""
    return band(ratios, F.col(value), least)


def learned_slack(residual: Column, df: DataFrame, least: int = 30, most: int = 3) -> DataFrame:
    """AGG-28: p95 of positive residuals, rounded up, between 0 and `most`; 0 with too few samples."""
    r = df.select(residual.alias("_r"))
    slack = slacks(r, {"x": F.col("_r")}, least, most)["x"]
    return r.agg(F.lit(slack).cast("long").alias("slack"), F.count("_r").alias("n"))


def slacks(df: DataFrame, residuals: dict[str, Column], least: int = 30, most: int = 3) -> dict[str, int]:
    """AGG-28 for several residuals: p95 of the positive ones, rounded up, between 0 and `most`; 0 with too few samples."""
    n = df.agg(*[F.count(r).alias(f"n{i}") for i, r in enumerate(residuals.values())]).first()
    p95 = quantiles(unpivoted(df, {name: F.when(r > 0, r) for name, r in residuals.items()}), [0.95])
    return {name: int(min(max(math.ceil(p95[name][1][0]), 0), most)) if n[i] >= least and name in p95 else 0 for i, name in enumerate(residuals)}


def percentile_by_band(df: DataFrame, value: Column, by: str, q: float = 0.99, least: int = 30) -> DataFrame:
    """AGG-30: a percentile for each band and over all (band NULL), in one pass."""
    rows = df.select(value.alias("_v"), col(by).alias("band")).where("_v is not null and band is not null")
    long = rows.select(F.explode(F.array(F.col("band").cast("string"), F.lit(None).cast("string"))).alias("key"), F.col("_v").alias("value"))
    found = quantiles(long, [q])
    return df.sparkSession.createDataFrame([(k, p if n >= least else None, n) for k, (n, (p,)) in found.items()] or [(None, None, 0)], "band string, p double, n long")


def peak_hours(df: DataFrame, ts: str, load: str, q: float = 0.7) -> DataFrame:
    """AGG-31: mean load of each hour of the day, and whether it is at or above the quantile over hours."""
    hours = df.groupBy(F.hour(col(ts)).alias("hour")).agg(F.avg(number(col(load))).alias("mean_load"))
    limit = hours.agg(F.percentile("mean_load", q).alias("limit"))
    return hours.crossJoin(F.broadcast(limit)).select("hour", "mean_load", (F.col("mean_load") >= F.col("limit")).alias("peak"))  # a single row


def dataset_summary(df: DataFrame, entity: str, ts: str, cadence_s: float, slack: float = 5) -> DataFrame:
    """AGG-15: rows, entities, times, first and last, span in hours, whether all gaps are the cadence."""
    even = gaps([(df, ts)]).agg(F.coalesce(F.bool_and(F.abs(F.col("gap") - cadence_s) < slack), F.lit(True)).alias("regular"))
    t = col(ts)
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(col(entity)).alias("entities"), F.countDistinct(t).alias("times"), F.min(t).alias("first"), F.max(t).alias("last"), (seconds_between(F.max(t), F.min(t)) / 3600).alias("hours"))
    return out.crossJoin(F.broadcast(even))  # a single row


def as_document(df: DataFrame, key: str) -> dict:
    """A small learned table as a nested dict, for the JSON artifact."""
    return {str(r[key]): {k: v for k, v in r.asDict().items() if k != key} for r in df.collect()}


#: What is assumed where nothing was learned.
DEFAULT_TEMPLATE = {"cells": {"median": 52.0, "iqr": 5.0}, "ues": {"median": 30.0, "iqr": 10.0}}


def presence_baseline(document: Mapping | None, cells: float = 52, ues: float = 33) -> dict[str, dict[int, float]]:
    """Expected entities by hour, with defaults for all hours that a document doesn't have."""
    document = document or {}
    return {kind: {h: float((document.get(kind) or {}).get(str(h), {}).get("median", default)) for h in range(24)} for kind, default in (("cells", cells), ("ues", ues))}


def range_learned(document: Mapping, name: str) -> bool:
    r = (document or {}).get(name) or {}
    return r.get("min") is not None and r.get("max") is not None

