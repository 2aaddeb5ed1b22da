"""The pipelines from end to end: learn a baseline, score and label windows, make training rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.exprs import col, number, ratio
from gaugewright.operators import baselines, checks, convert, dimensions, features, pca, windows
from gaugewright.sources import writers
from gaugewright.sources.readers import CELL, CELL_FIELDS, CELL_PATTERN, GROUPS, UE, UE_FIELDS

TS = "timestamp"
SIDES = (("dl", "Dl"), ("ul", "Ul"))
STEPS = ("convert", "baseline", "artifacts", "report")


def learn_baseline(cells: DataFrame, ues: DataFrame, root: str, bands: Mapping[str, Mapping[str, float]] | None = None, cadence: float = 60) -> dict:
    """Convert, learn every baseline, write the artifacts and a report; what each step came to.

    The converted table is written once and every learner reads its own columns of that.
    """
    raw, spark = cells, cells.sparkSession
    writers.parquet(convert.with_band(convert.convert_cells(raw, CELL, TS, cadence), CELL, CELL_PATTERN), f"{root}/processed/cells")
    writers.parquet(ues, f"{root}/processed/ues")
    cells, ues = (spark.read.parquet(f"{root}/processed/{k}") for k in ("cells", "ues"))
    one = lambda df: df.first().asDict()
    found = one(baselines.cadence([(cells, TS), (ues, TS)]))
    n = lambda c: number(col(c))
    usable = ~F.coalesce(col("PEE.Energy_reset"), F.lit(False)) & ~F.coalesce(col("PEE.Energy_imputed"), F.lit(False))
    hours = checks.with_previous(cells, CELL, TS, "_prev")
    learned = baselines.bands(
        hours,
        {
            "energy": F.when(usable, ratio(n("PEE.Energy_interval"), n("PEE.AvgPower") / 1000 * (F.unix_micros(col(TS)) - F.unix_micros("_prev")) / 3.6e9)),
            **{f"thp_{k}": F.when(n(f"RRU.PrbUsed{s}") > 0, ratio(n(f"DRB.UEThp{s}") * 1000, n(f"RRU.PrbUsed{s}"))) for k, s in SIDES},
        },
        30,
    )
    slack = baselines.slacks(cells, {f"{rule}_{k}": made(s) for k, s in SIDES for rule, made in (
        ("tot_le_avail", lambda s: n(f"RRU.PrbTot{s}_abs") - n(f"RRU.PrbAvail{s}")), ("used_le_tot", lambda s: n(f"RRU.PrbUsed{s}") - n(f"RRU.PrbTot{s}_abs")))})
    document = {
        "cadence_sec": found["cadence"], "ts_resolution_sec": found["resolution"],
        "prb_pct_decimals": {k: v["decimals"] for k, v in baselines.as_document(baselines.printed_decimals(cells, [f"RRU.PrbTot{s}" for _, s in SIDES]), "metric").items()},
        "energy_power_band": {{"q25": "ratio_q1", "q75": "ratio_q3"}.get(k, k): v for k, v in learned["energy"].items()},
        "ue_cell_thp_ratio": {k: one(baselines.ratio_band(checks.reconcile(cells, ues, [], TS, f"DRB.UEThp{s}"))) for k, s in SIDES},
        "ue_cell_prb_ratio": {k: one(baselines.ratio_band(checks.reconcile(cells, ues, [], TS, f"RRU.PrbUsed{s}"))) for k, s in SIDES},
        "prb_rule_slack_prb": {rule: {k: slack[f"{rule}_{k}"] for k, _ in SIDES} for rule in ("tot_le_avail", "used_le_tot")},
        "accuracy_thp_per_prb_band": {k: learned[f"thp_{k}"] for k, _ in SIDES},
        "accuracy_spectral_eff": spectral_efficiency(cells, bands or {}),
        "field_ranges": {"cell_metrics": baselines.as_document(baselines.field_ranges(cells, CELL_FIELDS), "metric"), "ue_metrics": baselines.as_document(baselines.field_ranges(ues, UE_FIELDS), "metric")},
        "statistics": {"cell": baselines.as_document(baselines.statistics(cells, CELL_FIELDS), "metric"), "ue": baselines.as_document(baselines.statistics(ues, UE_FIELDS), "metric")},
        "hourly": {"cells": baselines.as_document(baselines.hourly_template(cells, TS, CELL, 52, 5), "hour"), "ues": baselines.as_document(baselines.hourly_template(ues, TS, UE, 30, 10), "hour")},
        "mimo_zero_rate": one(baselines.zero_rate_band(cells, GROUPS["mimo"][0], CELL)), "ul_dl_correlation": one(baselines.correlation(cells, "DRB.UEThpDl", "DRB.UEThpUl")),
    }
    about = {"cells": one(baselines.dataset_summary(cells, CELL, TS, cadence)), "ues": one(baselines.dataset_summary(ues, UE, TS, cadence))}
    path = writers.artifact(document, root, "dq_baseline", metadata=about)
    writers.artifact(dataset_metadata(about), root, "dataset_metadata")
    steps = {"converted": convert.summary(raw, cells)["added"] != [], "baseline": path}
    writers.report(f"{root}/report.txt", steps)
    return steps


def spectral_efficiency(cells: DataFrame, bands: Mapping[str, Mapping[str, float]]) -> dict:
    """Percentiles of bits a second and hertz, over all and by band, with each band's own width of a resource; and the caps."""
    banded = convert.band_constants(cells, "Band", {b: dict(v) for b, v in bands.items()})
    out: dict = {"per_prb_khz": 180.0, "abs_cap_global": 30.0, "abs_cap_by_band": {b: v["cap"] for b, v in bands.items() if "cap" in v}}
    for k, s in SIDES:
        used = number(col(f"RRU.PrbUsed{s}"))
        efficiency = F.when(used > 0, ratio(number(col(f"DRB.UEThp{s}")) * 1e9, used * F.col("khz") * 1000))
        p99 = {r.band: r.p for r in baselines.percentile_by_band(banded, efficiency, "Band").collect()}
        out |= {f"{k}_p99": p99.pop(None, None), f"{k}_p99_by_band": p99}
    return out


def dataset_metadata(about: Mapping[str, Mapping], known_issues: Sequence[str] = ("TB.TotNbrDl and TB.TotNbrUl are not reliable", "a CQI of 0 means that nothing was measured", "one of many cells reports layers for most of the time as 0")) -> dict:
    """What the two tables hold, their columns, and what is known to be wrong with them."""
    return {"tables": {k: dict(v) for k, v in about.items()}, "fields": {"cells": list(CELL_FIELDS), "ues": list(UE_FIELDS)}, "groups": {k: list(v) for k, v in GROUPS.items()}, "known_issues": list(known_issues)}


def score_windows(cells: DataFrame, ues: DataFrame, baseline: Mapping, span: tuple[int, int], size: int, step: int, tiebreak: str | None = None, **options) -> DataFrame:
    """Scores of the five dimensions for every window of converted cell reports and of UE reports."""
    return dimensions.window_scores(cells, ues, baseline, span, size, step, baseline.get("hourly"), tiebreak, **options)


def feature_table(cells: DataFrame, ues: DataFrame, span: tuple[int, int], size: int, step: int, cadence: float = 60.0) -> DataFrame:
    """Feature rows of every window of converted cell reports and UE reports."""
    spine = windows.spine(cells, *span, size, step)
    return features.feature_rows(windows.assign(cells, TS, *span, size, step), windows.assign(ues, TS, *span, size, step), spine, cadence)


def label_windows(cells: DataFrame, ues: DataFrame, baseline: Mapping, size: int, step: int, model: pca.Consolidator | None = None, cadence: float = 60, converted: bool = False, tiebreak: str | None = None, **options) -> DataFrame:
    """Feature rows with labels: scores of the dimensions, consolidated by a given model or one fitted here. Scores, features and labels share one span and spine."""
    cells = cells if converted else convert.convert_cells(cells, CELL, TS, cadence, tiebreak=tiebreak)
    span = windows.span([(cells, TS), (ues, TS)])
    scored = score_windows(cells, ues, baseline, span, size, step, tiebreak, **options).select("window_id", *[F.col(f"{d}_mpr").alias(d) for d in dimensions.DIMENSIONS])
    labels = (model or pca.fit(scored, tuple(dimensions.DIMENSIONS))).transform(scored).select("window_id", "label")
    return features.align(feature_table(cells, ues, span, size, step, cadence).join(labels, "window_id"), features.feature_columns())
