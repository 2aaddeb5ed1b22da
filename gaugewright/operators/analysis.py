"""Analysis of scores: confusion, agreement, bootstrap, normalisation, ablation, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.exprs import col, corr, js_divergence, ratio
from gaugewright.operators.pca import fit as fit_pca
from gaugewright.operators.ranks import quantiles, unpivoted
from gaugewright.operators.train import regression_metrics


def confusion(truth: Column, guess: Column) -> list[Column]:
    """Counts and rates of two booleans; rates of nothing are 0."""
    t, g = F.coalesce(truth, F.lit(False)), F.coalesce(guess, F.lit(False))
    tp, fp, fn, tn = F.count_if(t & g), F.count_if(~t & g), F.count_if(t & ~g), F.count_if(~t & ~g)
    rate = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    precision, recall = rate(tp, tp + fp), rate(tp, tp + fn)
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), rate(tp + tn, tp + fp + fn + tn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"), rate(fp, fp + tn).alias("fpr"), rate(fn, fn + tp).alias("fnr"),
    ]


def min_max(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """norm_<name> between 0 and 1; 0.5 for a constant column."""
    ends = df.agg(*[f(col(n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("l", F.min), ("h", F.max))])
    out = df.crossJoin(F.broadcast(ends))  # a single row
    made = {f"norm_{n}": F.when(F.col(f"h{i}") > F.col(f"l{i}"), (col(n) - F.col(f"l{i}")) / (F.col(f"h{i}") - F.col(f"l{i}"))).when(col(n).isNotNull(), 0.5) for i, n in enumerate(names)}
    return out.withColumns(made).select(*[col(c) for c in df.columns], *[col(c) for c in made])


def agreement(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """MAE, RMSE, R2 and correlation."""
    return df.agg(*regression_metrics(col(label), col(prediction)), corr(col(label), col(prediction)).alias("correlation"), F.count(F.lit(1)).alias("n"))


def naive_baselines(df: DataFrame, label: str) -> DataFrame:
    """MAE of always guessing the mean or the median."""
    middle = quantiles(unpivoted(df, {label: col(label)}), [0.5]).get(label)
    median = F.lit(middle[1][0] if middle else None).cast("double")
    got = df.agg(F.avg(col(label)).alias("mean"))
    return df.crossJoin(F.broadcast(got)).agg(F.avg(F.abs(col(label) - F.col("mean"))).alias("mean_mae"), F.avg(F.abs(col(label) - median)).alias("median_mae"))  # a single row


def bootstrap_mae(df: DataFrame, label: str, prediction: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """2.5 and 97.5 percentiles of the MAE over Poisson resamples, weighted by a hash of (seed, resample, row): the same however rows are dealt."""
    rows = df.select(F.abs(col(label) - col(prediction)).alias("e"), F.xxhash64(*[F.coalesce(col(c).cast("string"), F.lit("")) for c in df.columns]).alias("h"))
    each = rows.select("e", "h", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("r"))
    u = F.pmod(F.xxhash64(F.lit(seed), "r", "h"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    weight, p, total = F.lit(0.0), 0.36787944117144233, 0.0  # Poisson(1): the number of thresholds that u passes
    term = p
    for k in range(1, 8):
        total += term
        weight = weight + F.when(u >= total, 1.0).otherwise(0.0)
        term /= k
    maes = each.withColumn("w", weight).groupBy("r").agg(ratio(F.sum(F.col("w") * F.col("e")), F.sum("w")).alias("mae"))
    return maes.agg(F.percentile("mae", 0.025).alias("low"), F.avg("mae").alias("mae"), F.percentile("mae", 0.975).alias("high"))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, name: str) -> DataFrame:
    """count, mean, std (n - 1), min, quartiles, max and the distance of the quartiles."""
    x = col(name)
    _, (q25, q50, q75) = quantiles(unpivoted(df, {name: x}), (0.25, 0.5, 0.75)).get(name, (0, [None] * 3))
    value = lambda v: F.lit(v).cast("double")
    return df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).select("count", "mean", "std", "min", value(q25).alias("q25"), value(q50).alias("q50"), value(q75).alias("q75"), "max", (value(q75) - value(q25)).alias("iqr"))


def low_quality(df: DataFrame, label: str = "label", mpr: str = "mpr") -> DataFrame:
    return df.where((col(label) < 0.5) & (col(mpr) <= 0.95))


def ablation(scores: DataFrame, dimensions: Sequence[str], base: str = "label") -> DataFrame:
    """For all dimensions and for all but one each: explained variance, and how far labels move from the full ones."""
    full = fit_pca(scores, dimensions).transform(scores, base)
    rows = None
    for left_out in (None, *dimensions):
        used = [d for d in dimensions if d != left_out]
        model = fit_pca(full, used)
        got = model.transform(full, "_other").agg(F.avg(F.abs(F.col("_other") - F.col(base))).alias("mae_from_full"), corr(F.col("_other"), F.col(base)).alias("correlation"))
        got = got.select(F.lit(left_out or "none").alias("left_out"), F.lit(model.explained).alias("explained"), "*")
        rows = got if rows is None else rows.unionByName(got)
    return rows.orderBy("mae_from_full")


def drift(reference: DataFrame, current: DataFrame, bin_col: str = "bin", density: str = "density", limit: float = 0.08) -> DataFrame:
    """Jensen-Shannon divergence of two histograms with the same bins, and whether it is above the limit."""
    both = reference.select(bin_col, F.col(density).alias("p")).join(current.select(bin_col, F.col(density).alias("q")), bin_col, "full").select(bin_col, F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    rows = both.agg(F.array_sort(F.collect_list(F.struct(bin_col, "p", "q"))).alias("b"))  # one element a bin
    jsd = js_divergence(F.col("b.p"), F.col("b.q"))
    return rows.select(jsd.alias("jsd"), (jsd > limit).alias("drifted"))


def compare_to_baseline(metrics: DataFrame, run: str, base: str, measure: str = "mae") -> DataFrame:
    """Runs by their measure, with the difference from the base run."""
    one = metrics.where(F.col(run) == base).select(F.col(measure).alias("_base"))
    return metrics.crossJoin(F.broadcast(one)).withColumn("delta", F.col(measure) - F.col("_base")).drop("_base").orderBy(measure)  # a single row
