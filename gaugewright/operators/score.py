"""The reducer: mean pass rate, all-pass rate and coverage, in one aggregation per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.exprs import row_all
from gaugewright.operators.checks import Check, Dimension


def sums(checks: Sequence[Check], prefix: str = "") -> list[Column]:
    """passed_<check> and total_<check>: sums of parts, so they combine before the shuffle and in streams."""
    out = []
    for i, c in enumerate(checks):
        passed, total = (F.count_if(c.ok), F.count(c.ok)) if c.kind == "row" else (c.passed, c.total)
        out += [F.coalesce(passed, F.lit(0)).cast("double").alias(f"{prefix}passed_{i}"), F.coalesce(total, F.lit(0)).cast("double").alias(f"{prefix}total_{i}")]
    return out


def all_pass(checks: Sequence[Check]) -> Column:
    """APR: share of rows in which every applicable row check passes; 0 without row checks or rows."""
    rows = [c.ok for c in checks if c.kind == "row"]
    if not rows:
        return F.lit(0.0)
    return F.coalesce(F.avg(F.coalesce(row_all(rows), F.lit(True)).cast("double")), F.lit(0.0))


def scores(df: DataFrame, keys: Sequence[str], dimensions: Sequence[Dimension]) -> DataFrame:
    """For each group and dimension: <d>_mpr, <d>_apr, <d>_coverage, <d>_row_fails, <d>_aggregate_fails, <d>_total_fails, and <d>_details."""
    parts = [c for d in dimensions for c in [*sums(d.checks, f"_{d.name}_"), all_pass(d.checks).alias(f"{d.name}_apr")]]
    raw = df.groupBy(*keys).agg(*parts)
    out: list[Column] = [F.col(k) for k in keys]
    for d in dimensions:
        p = [F.col(f"_{d.name}_passed_{i}") for i in range(len(d.checks))]
        n = [F.col(f"_{d.name}_total_{i}") for i in range(len(d.checks))]
        active = sum(((x > 0).cast("int") for x in n), F.lit(0))
        whole = sum(n, F.lit(0.0))
        fails = {kind: sum((n[i] - p[i] for i, c in enumerate(d.checks) if c.kind == kind), F.lit(0.0)) for kind in ("row", "sum")}
        coverage = F.when(active > 0, 1.0).otherwise(0.0) if d.drop_inactive else active / F.lit(float(max(1, len(d.checks))))
        out += [
            F.when(whole > 0, sum(p, F.lit(0.0)) / whole).otherwise(0.0).alias(f"{d.name}_mpr"), F.col(f"{d.name}_apr"), coverage.alias(f"{d.name}_coverage"),
            fails["row"].cast("long").alias(f"{d.name}_row_fails"), fails["sum"].cast("long").alias(f"{d.name}_aggregate_fails"), (fails["row"] + fails["sum"]).cast("long").alias(f"{d.name}_total_fails"),
            F.struct(*[F.when(n[i] > 0, p[i] / n[i]).alias(f"{c.name}_{i}" if [x.name for x in d.checks].count(c.name) > 1 else c.name) for i, c in enumerate(d.checks)]).alias(f"{d.name}_details"),
        ]
    return raw.select(*out)


def flatten(scored: DataFrame, keys: Sequence[str], dimensions: Sequence[str], measure: str = "mpr") -> DataFrame:
    return scored.select(*keys, *[F.col(f"{d}_{measure}") for d in dimensions])


def history(scored: DataFrame, score: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    s = F.col(score)
    return scored.groupBy(*keys).agg(F.count(s).alias("count"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"), F.max_by(s, F.col(order)).alias("last"))


def reason_counts(df: DataFrame, dimension: str, reason_list: str) -> DataFrame:
    """Counts by dimension and reason, with totals (NULL) of each level."""
    return df.select(dimension, F.explode(reason_list).alias("reason")).rollup(dimension, "reason").agg(F.count(F.lit(1)).alias("n"))


def top_reasons(df: DataFrame, reason_list: str, k: int) -> DataFrame:
    """The k commonest reasons: reason, n; ties by name."""
    return df.select(F.explode(reason_list).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(k)
