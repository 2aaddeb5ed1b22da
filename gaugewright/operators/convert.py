"""Unit conversion: percentages, cumulative counters, bands, constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.exprs import col, extract, missing, number, seconds_between
from gaugewright.operators.checks import entity_key


def percent_to_absolute(df: DataFrame, percent: str, available: str, out: str, flag: str | None = None) -> DataFrame:
    """percent / 100 * available where there is some available."""
    p, a = number(col(percent)), number(col(available))
    df = df.withColumn(out, F.when((a > 0) & p.isNotNull(), p / 100 * a))
    return df.withColumn(flag, F.lit(True)) if flag else df


def previous(value: Column, entity: str, order: list[str]) -> Column:
    """The entity's value one row before; rows without an entity have none."""
    before = F.lag(value).over(Window.partitionBy(*entity_key(entity, order[0])).orderBy(*[col(o) for o in order]))
    return F.when(col(entity).isNotNull(), before)


def cumulative_to_interval(df: DataFrame, counter: str, entity: str, ts: str, cadence: float, power: str | None = None, prefix: str = "interval", tiebreak: str | None = None) -> DataFrame:
    """A counter's increase since the entity's row before.

    Adds <prefix>, <prefix>_reset (the counter fell), and with a power column in watts <prefix>_expected
    (power times the time since) and <prefix>_imputed: where there is no increase the expected one is
    taken. Without power the first row of an entity stays NULL.
    """
    order = [ts, *([tiebreak] if tiebreak else [])]
    delta = number(col(counter)) - previous(number(col(counter)), entity, order)
    hours = F.greatest(F.coalesce(seconds_between(col(ts), previous(col(ts), entity, order)), F.lit(float(cadence))) / 3600, F.lit(1e-9))
    df = df.withColumn("_delta", delta).withColumn("_hours", hours)
    df = df.withColumn(f"{prefix}_reset", F.coalesce(F.col("_delta") < 0, F.lit(False))).withColumn(prefix, F.when(F.col("_delta") >= 0, F.col("_delta")))
    if power and power in df.columns:
        df = df.withColumn(f"{prefix}_expected", number(col(power)) / 1000 * F.col("_hours")).withColumn(f"{prefix}_imputed", col(prefix).isNull())
        df = df.withColumn(prefix, F.coalesce(col(prefix), col(f"{prefix}_expected")))
    return df.drop("_delta", "_hours")


def with_band(df: DataFrame, name: str, pattern: str, out: str = "Band") -> DataFrame:
    return df.withColumn(out, extract(col(name), pattern))


def zero_to_null(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.nullif(col(n), F.lit(0)) for n in names if n in df.columns})


def band_constants(df: DataFrame, band: str, table: dict[str, dict[str, float]], default_khz: float = 180.0, default_cap: float = 30.0) -> DataFrame:
    """khz and cap of each row's band, from literals; kHz from bandwidth and count where they aren't given."""
    khz = {b: v.get("khz", v["bandwidth_mhz"] * 1000 / v["prb_count"] if "bandwidth_mhz" in v else default_khz) for b, v in table.items()}
    cap = {b: v.get("cap", default_cap) for b, v in table.items()}

    def looked_up(values: dict[str, float], default: float) -> Column:
        if not values:
            return F.lit(default)
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), col(band)), F.lit(default))

    return df.withColumn("khz", looked_up(khz, default_khz)).withColumn("cap", looked_up(cap, default_cap))


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    return df.withColumns({n: missing(col(n)) for n, kind in df.dtypes if kind in ("float", "double")})


def convert_cells(df: DataFrame, entity: str, ts: str, cadence: float = 60, percent: bool = True, energy: bool = True, flows: bool = True, tiebreak: str | None = None) -> DataFrame:
    """The conversions of a cell report, each behind its switch; columns that aren't there are passed over."""
    df = no_nan(df)
    for side in ("Dl", "Ul"):
        if percent and {f"RRU.PrbTot{side}", f"RRU.PrbAvail{side}"} <= set(df.columns):
            df = percent_to_absolute(df, f"RRU.PrbTot{side}", f"RRU.PrbAvail{side}", f"RRU.PrbTot{side}_abs", "prb_conversion_applied")
    if energy and "PEE.Energy" in df.columns:
        df = cumulative_to_interval(df, "PEE.Energy", entity, ts, cadence, "PEE.AvgPower", "PEE.Energy_interval", tiebreak).withColumn("energy_conversion_applied", F.lit(True))
        df = df.withColumnsRenamed({f"PEE.Energy_interval_{x}": f"PEE.Energy_{x}" for x in ("reset", "imputed", "expected")})
    if flows and any(c.startswith("QosFlow.") for c in df.columns):
        df = df.withColumn("qos_flow_1s_semantics", F.lit(True))
    return df


def summary(before: DataFrame, after: DataFrame) -> dict[str, list[str]]:
    """Columns that a conversion added, and flags among them."""
    new = [c for c in after.columns if c not in before.columns]
    return {"added": new, "flags": [c for c in new if dict(after.dtypes)[c] == "boolean"]}
