"""Sliding windows over event time, empty ones included.

Windows are [start, start + size) with starts every `step` seconds from the common start of the
streams. A row is assigned by arithmetic, not by a range join: it lies in size / step windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.exprs import col, micros, window_name
from gaugewright.operators.ranks import row_numbers


def span(streams: Sequence[tuple[DataFrame, str]], common: bool = True) -> tuple[int, int]:
    """First and last time, in microseconds: where all streams overlap (or what any of them covers)."""
    ends = [df.agg(F.min(micros(col(ts))), F.max(micros(col(ts)))).first() for df, ts in streams]
    ends = [e for e in ends if e[0] is not None]
    if not ends:
        raise ValueError("all streams are empty")
    start, end = (max if common else min)(e[0] for e in ends), (min if common else max)(e[1] for e in ends)
    if start > end:
        raise ValueError("the streams don't overlap")
    return start, end


def spine(df: DataFrame, start: int, end: int, size: int, step: int, partial_tail: bool = False) -> DataFrame:
    """A row for each window: window_id, window_number, window_start, window_end. Built on the executors from a range."""
    last = end - (0 if partial_tail else size * 1_000_000)
    n = max(0, (last - start) // (step * 1_000_000) + 1)
    at = F.timestamp_micros(F.lit(start) + F.col("id") * F.lit(step * 1_000_000))
    rows = df.sparkSession.range(n).select(F.col("id").alias("window_number"), at.alias("window_start"), (at + F.make_dt_interval(secs=F.lit(size))).alias("window_end"))
    return rows.select(window_name(F.col("window_number"), F.col("window_start")).alias("window_id"), "*")


def window_numbers(ts: Column, start: int, end: int, size: int, step: int) -> Column:
    """Numbers of the whole windows that hold a time."""
    at, last = micros(ts) - F.lit(start), (end - start - size * 1_000_000) // (step * 1_000_000)
    high = F.floor(at / (step * 1_000_000))
    low = F.greatest(F.floor((at - size * 1_000_000) / (step * 1_000_000)) + 1, F.lit(0))
    return F.when((high >= low) & (low <= last), F.sequence(low, F.least(high, F.lit(last))))


def assign(df: DataFrame, ts: str, start: int, end: int, size: int, step: int) -> DataFrame:
    """df with a row for each window that it lies in, and window_number and window_start."""
    out = df.where(col(ts).isNotNull()).withColumn("window_number", F.explode(window_numbers(col(ts), start, end, size, step)))
    return out.withColumn("window_start", F.timestamp_micros(F.lit(start) + F.col("window_number") * F.lit(step * 1_000_000)))


def metadata(assigned: DataFrame, windows: DataFrame, ts: str, entity: str, expected: int, minimum: float = 0.8, prefix: str = "") -> DataFrame:
    """Rows, entities, distinct times, completeness and validity of every window; empty windows have zeros."""
    named = lambda n: f"{prefix}{n}"
    # distinct times: as many as fit into a window at the data's resolution
    found = assigned.groupBy("window_number").agg(F.count(F.lit(1)).alias(named("rows")), F.countDistinct(col(entity)).alias(named("entities")), F.array_sort(F.collect_set(col(ts))).alias(named("times")))
    found = found.withColumn(named("ticks"), F.size(named("times")).cast("long"))
    out = windows.join(found, "window_number", "left")
    for n in ("rows", "entities", "ticks"):
        out = out.withColumn(named(n), F.coalesce(named(n), F.lit(0)))
    out = out.withColumn(named("times"), F.coalesce(named("times"), F.array().cast(found.schema[named("times")].dataType)))
    need = int(minimum * expected)
    reason = F.when(F.col(named("rows")) == 0, "empty").when(F.col(named("ticks")) < need, "incomplete")
    return out.withColumn(named("completeness"), F.col(named("ticks")) / F.lit(float(expected))).withColumn(named("valid"), reason.isNull()).withColumn(named("reason"), reason)


def complete(cell_ticks: Column, ue_ticks: Column, expected: int, minimum: float = 0.8) -> Column:
    """Whether each stream that has any times has enough of them, and one has some."""
    enough = lambda c: (c == 0) | (c >= int(minimum * expected))
    return enough(cell_ticks) & enough(ue_ticks) & (cell_ticks + ue_ticks > 0)


def statistics(windows: DataFrame, completeness: str = "completeness", rows: str = "rows") -> DataFrame:
    """One row over all windows."""
    c, r = F.col(completeness), F.col(rows)
    return windows.agg(
        F.count(F.lit(1)).alias("windows"), F.min("window_start").alias("first_start"), F.max("window_end").alias("last_end"),
        F.avg(c).alias("mean_completeness"), F.stddev_pop(c).alias("std_completeness"), F.min(c).alias("min_completeness"), F.max(c).alias("max_completeness"), F.percentile(c, 0.5).alias("median_completeness"),
        F.avg(r).alias("mean_rows"), F.stddev_pop(r).alias("std_rows"), F.sum(r).alias("total_rows"),
    )


def even_stride(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at an even stride of their order (a number or a time)."""
    total = df.count()
    step = max(1, total // max(1, n))
    at = F.col("_n") - 1
    return row_numbers(df, ordinal(df, order), out="_n").where((at % step == 0) & (at < step * n)).drop("_n")


def evenly_spaced(df: DataFrame, order: str, n: int, tiebreak: str | None = None) -> DataFrame:
    """The rows at n evenly spaced places from first to last of their order (a number or a time), ties by the tiebreak."""
    total = df.count()
    places = sorted({int(i * (total - 1) / max(1, n - 1)) for i in range(min(n, total))})
    return row_numbers(df, ordinal(df, order), [tiebreak] if tiebreak else [], "_n").where((F.col("_n") - 1).isin(places)).drop("_n")


def ordinal(df: DataFrame, name: str) -> Column:
    """A number that orders as the column does."""
    return micros(col(name)) if dict(df.dtypes)[name] in ("date", "timestamp", "timestamp_ntz") else col(name)
