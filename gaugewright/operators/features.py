"""The feature row: one wide aggregation per window, and a locked column order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.exprs import col, missed, number, off_grid, ratio, seconds_between


def counts(prefix: str, entity: str) -> list[Column]:
    return [F.count(F.lit(1)).alias(f"{prefix}_rows"), F.countDistinct(col(entity)).alias(f"unique_{prefix}s")]


def duplicates(df: DataFrame, keys: Sequence[str], out: str = "duplicate") -> DataFrame:
    """Marks every row that shares its keys with another; NULLs are equal."""
    return df.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy(*[col(k) for k in keys])) > 1)


def summaries(prefix: str, metrics: Sequence[str]) -> list[Column]:
    """mean, std (population), min, max, median, q25, q75 of each metric."""
    out = []
    for m in metrics:
        x, name = number(col(m)), f"{prefix}_{m}"
        out += [F.avg(x).alias(f"{name}_mean"), F.stddev_pop(x).alias(f"{name}_std"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max")]
        out += [F.percentile(x, q).alias(f"{name}_{label}") for label, q in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))]
    return out


def null_fraction(prefix: str, metrics: Sequence[str]) -> Column:
    """Mean over the numeric columns of their share of NULLs."""
    missing = sum((F.count_if(col(m).isNull()) for m in metrics), F.lit(0))
    return (missing / (F.lit(max(1, len(metrics))) * F.count(F.lit(1)))).alias(f"{prefix}_null_frac")


def with_gaps(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: str, out: str = "gap") -> DataFrame:
    """Seconds since the row before in the group, over all entities."""
    before = F.lag(col(ts)).over(Window.partitionBy(*[col(k) for k in keys]).orderBy(col(ts), col(tiebreak)))
    return df.withColumn(out, seconds_between(col(ts), before))


def cadence(prefix: str, ts: str, expected: float, gap: str = "gap") -> list[Column]:
    """min, median and max gap; off-grid and missing intervals; rows of what the span holds. NULL for fewer than two rows."""
    g, n = col(gap), F.count(col(gap))
    apart = seconds_between(F.max(col(ts)), F.min(col(ts)))
    held = F.floor(apart / expected) + 1
    some = lambda c: F.when(n > 0, c)
    return [
        F.min(g).alias(f"{prefix}_dt_min"), F.percentile(g, 0.5).alias(f"{prefix}_dt_median"), F.max(g).alias(f"{prefix}_dt_max"),
        some(F.count_if(off_grid(g, expected))).alias(f"{prefix}_offgrid_count"), some(F.sum(missed(g, expected)).cast("long")).alias(f"{prefix}_missing_intervals"), some(F.count(col(ts)) / held).alias(f"{prefix}_coverage_ratio"),
    ]


def ratios(prefix: str, name: str, top: str, bottom: str, labels: Sequence[str] = ("mean", "q25", "q75"), add: float = 0.0) -> list[Column]:
    r = ratio(number(col(top)), number(col(bottom)) + add)
    made = {"mean": F.avg(r), "q25": F.percentile(r, 0.25), "median": F.percentile(r, 0.5), "q75": F.percentile(r, 0.75)}
    return [made[label].alias(f"{prefix}_{name}_{label}") for label in labels]


def violations(rules: dict[str, Column]) -> list[Column]:
    """How many rows break each rule."""
    return [F.count_if(c).alias(f"viol_{name}") for name, c in rules.items()]


#: The names of telecom_violations(), known without a session.
VIOLATIONS = ("prb_used_gt_avail_dl", "prb_used_gt_avail_ul", "conn_mean_gt_max_cnt", "thp_pos_prb_zero_dl", "thp_pos_prb_zero_ul")


def telecom_violations() -> dict[str, Column]:
    n = lambda c: number(col(c))
    out = {f"prb_used_gt_avail_{s.lower()}": n(f"RRU.PrbUsed{s}") > n(f"RRU.PrbAvail{s}") for s in ("Dl", "Ul")}
    out["conn_mean_gt_max_cnt"] = n("RRC.ConnMean") > n("RRC.ConnMax")
    return out | {f"thp_pos_prb_zero_{s.lower()}": (n(f"DRB.UEThp{s}") > 0.001) & (n(f"RRU.PrbUsed{s}") <= 0) for s in ("Dl", "Ul")}


def energy_residuals(df: DataFrame, keys: Sequence[str], energy: str, power: str, ts: str, entity: str, out: str = "energy_resid", tiebreak: str | None = None) -> DataFrame:
    """Energy step less power (W) times time (s), both against the row before by (time, entity) in the group."""
    order = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(ts), col(entity), *([col(tiebreak)] if tiebreak else []))
    step = number(col(energy)) - F.lag(number(col(energy))).over(order)
    return df.withColumn(out, step - F.lag(number(col(power))).over(order) * seconds_between(col(ts), F.lag(col(ts)).over(order)))


CELL_METRICS = ("DRB.UEThpDl", "DRB.UEThpUl", "RRU.PrbUsedDl", "RRU.PrbUsedUl", "RRU.PrbAvailDl", "RRU.PrbAvailUl", "RRC.ConnMean", "RRC.ConnMax", "PEE.AvgPower", "PEE.Energy_interval")
UE_METRICS = ("DRB.UEThpUl", "RRU.PrbUsedUl", "DRB.UEThpDl", "RRU.PrbUsedDl")


def feature_columns() -> list[str]:
    """The locked order of the feature row, made by rule."""
    both = ("cell", "ue")
    stats = ("mean", "std", "min", "max", "median", "q25", "q75")
    out = ["meta_hour_of_day", "meta_day_of_week", "meta_window_id", "meta_start_time", "meta_end_time", "cell_rows", "ue_rows", "total_rows", "unique_cells", "unique_ues", "cell_duplicate_rows", "ue_duplicate_rows"]
    out += [f"{p}_{x}" for p in both for x in ("dt_min", "dt_median", "dt_max", "offgrid_count", "missing_intervals", "coverage_ratio")]
    out += [f"t2_{x}_slots" for x in ("expected", "aligned", "missing")] + [f"{p}_null_frac" for p in both]
    out += [f"ue_thp_per_prb_{s}_{x}" for s in ("dl", "ul") for x in ("mean", "q25", "q75")] + ["cell_energy_per_thp_dl_mean", "cell_energy_per_thp_dl_q75"]
    out += [f"viol_{v}" for v in VIOLATIONS] + ["cell_energy_resid_abs_mean", "cell_energy_resid_abs_q75"]
    out += [f"recon_{m}_{s}_median" for m in ("thp", "prb") for s in ("dl", "ul")]
    return out + [f"cell_{m}_{x}" for m in CELL_METRICS for x in stats] + [f"ue_{m}_{x}" for m in UE_METRICS for x in stats] + ["label", "window_id"]


def difference(have: Sequence[str], expected: Sequence[str]) -> dict[str, list[str]]:
    """Columns that are missing, and those that nothing asks for."""
    return {"missing": [c for c in expected if c not in have], "extra": [c for c in have if c not in expected]}


def align(df: DataFrame, columns: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Exactly these columns in this order; only columns that aren't there are filled, NULLs stay."""
    return df.select(*[col(c).alias(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def feature_rows(cells: DataFrame, ues: DataFrame, windows: DataFrame, cadence_s: float = 60.0, tiebreak: str | None = None) -> DataFrame:
    """A feature row for each window, from assigned cell and UE reports (with window_number) and the spine."""
    from gaugewright.operators.checks import grid_alignment, reconcile

    key, cell, ue, ts = ["window_number"], "Viavi.Cell.Name", "Viavi.UE.Name", "timestamp"
    cells = energy_residuals(with_gaps(duplicates(cells, [*key, cell, ts]), key, ts, cell), key, "PEE.Energy", "PEE.AvgPower", ts, cell, tiebreak=tiebreak)
    ues = with_gaps(duplicates(ues, [*key, ue, ts]), key, ts, ue)
    has = lambda df, names: [m for m in names if m in df.columns]
    numeric = lambda df: [c for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint", "smallint") and c not in ("window_number", "gap", "energy_resid", tiebreak)]
    by_cell = cells.groupBy(*key).agg(
        *counts("cell", cell), F.count_if("duplicate").alias("cell_duplicate_rows"), *cadence("cell", ts, cadence_s), null_fraction("cell", numeric(cells)), *violations(telecom_violations()),
        *ratios("cell", "energy_per_thp_dl", "PEE.Energy_interval", "DRB.UEThpDl", ("mean", "q75"), 1e-9), F.avg(F.abs("energy_resid")).alias("cell_energy_resid_abs_mean"), F.percentile(F.abs("energy_resid"), 0.75).alias("cell_energy_resid_abs_q75"),
        *summaries("cell", has(cells, CELL_METRICS)),
    )
    by_ue = ues.groupBy(*key).agg(
        *counts("ue", ue), F.count_if("duplicate").alias("ue_duplicate_rows"), *cadence("ue", ts, cadence_s), null_fraction("ue", numeric(ues)),
        *[r for s in ("Dl", "Ul") for r in ratios("ue", f"thp_per_prb_{s.lower()}", f"DRB.UEThp{s}", f"RRU.PrbUsed{s}")], *summaries("ue", has(ues, UE_METRICS)),
    )
    out = windows.join(by_cell, key, "left").join(by_ue, key, "left")
    grid = grid_alignment(cells.select(*key, ts).unionByName(ues.select(*key, ts)), key, ts, cadence_s, max(1, int(0.1 * cadence_s)))
    out = out.join(grid.select(*key, *[F.col(f"{x}_slots").cast("double").alias(f"t2_{x}_slots") for x in ("expected", "aligned", "missing")]), key, "left")
    for short, measure in (("thp", "DRB.UEThp"), ("prb", "RRU.PrbUsed")):
        for s in ("Dl", "Ul"):
            medians = reconcile(cells, ues, key, ts, f"{measure}{s}").groupBy(*key).agg(F.percentile("ratio", 0.5).alias(f"recon_{short}_{s.lower()}_median"))
            out = out.join(medians, key, "left")
    zero = ("cell_rows", "ue_rows", "unique_cells", "unique_ues", "cell_duplicate_rows", "ue_duplicate_rows")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).withColumn("total_rows", F.col("cell_rows") + F.col("ue_rows"))
    out = out.withColumns({"meta_hour_of_day": F.hour("window_start"), "meta_day_of_week": F.weekday("window_start"), "meta_window_id": F.col("window_id"), "meta_start_time": F.col("window_start").cast("string"), "meta_end_time": F.col("window_end").cast("string")})
    return align(out, [c for c in feature_columns() if c != "label"])
