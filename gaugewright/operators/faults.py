"""Fault injection, seeded by hashes of keys: the same faults however rows are dealt.

A draw is xxhash64(seed, label, keys) scaled to [0, 1). Probabilities are parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.exprs import col, number

KINDS = ("missing", "out_of_range", "inconsistent", "timeliness")


@dataclass(frozen=True)
class Rates:
    """How likely each extra violation is."""

    micro_jitter: float = 0.65
    macro_jitter: float = 0.35
    drop_time: float = 0.20
    low_rate: float = 0.30
    zero_resource: float = 0.25
    above_available: float = 0.25
    mean_above_max: float = 0.20
    energy_spike: float = 0.20
    mismatch: float = 0.20


def draw(seed: int, label: str, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(label), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def pick(u: Column, values: Sequence) -> Column:
    """One of the values, by a draw."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.least(F.floor(u * len(values)).cast("int"), F.lit(len(values) - 1)))


def time_column(df: DataFrame, preferred: str | None = None) -> str:
    """The preferred column, a usual name, any name with "time" in it, or the first timestamp column."""
    for name in (preferred, "timestamp", "ts", "time", "datetime", "event_time"):
        if name and name in df.columns:
            return name
    for name, kind in df.dtypes:
        if "time" in name.lower() or kind.startswith("timestamp"):
            return name
    raise ValueError("no time column")


def updates(df: DataFrame, kind: Column, where: Column, rules: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Where it holds, each column takes the value that its rule has for the row's kind of fault. All rules see the old row."""
    made = {}
    for name, by_kind in rules.items():
        if name in df.columns:
            out = col(name)
            for k, value in by_kind.items():
                out = F.when(where & (kind == k), value.cast(df.schema[name].dataType)).otherwise(out)
            made[name] = out
    return df.withColumns(made)


#: What each kind of fault does to a report.
def cell_rules(entity: str = "Viavi.Cell.Name") -> dict[str, dict[str, Column]]:
    null, sides = F.lit(None), ("Dl", "Ul")
    rules: dict[str, dict[str, Column]] = {entity: {"missing": null}, "PEE.AvgPower": {"inconsistent": number(col("PEE.AvgPower")) * 0.6}, "RRC.ConnMean": {"missing": null, "inconsistent": F.lit(3)}}
    for s in sides:
        rules[f"RRU.PrbAvail{s}"] = {"missing": null}
        rules[f"DRB.UEThp{s}"] = {"missing": null, "out_of_range": number(col(f"DRB.UEThp{s}")) * 3}
        rules[f"RRU.PrbUsed{s}"] = {"missing": null, "inconsistent": number(col(f"RRU.PrbAvail{s}")) + 5}
        rules[f"RRU.PrbTot{s}"] = {"out_of_range": number(col(f"RRU.PrbTot{s}")) * 1.5 + 20}
    return rules


def ue_rules(entity: str = "Viavi.UE.Name") -> dict[str, dict[str, Column]]:
    null = F.lit(None)
    rules: dict[str, dict[str, Column]] = {entity: {"missing": null}}
    for s in ("Dl", "Ul"):
        rules[f"DRB.UECqi{s}"] = {"missing": null, "out_of_range": F.lit(25)}
        rules[f"DRB.UEThp{s}"] = {"missing": null, "inconsistent": F.lit(50.0)}
        rules[f"RRU.PrbUsed{s}"] = {"out_of_range": number(col(f"RRU.PrbUsed{s}")) * 3, "inconsistent": F.lit(0)}
    return rules


def extra_violations(df: DataFrame, where: Column, seed: int, keys: Sequence[str], rates: Rates = Rates(), cell: bool = True) -> DataFrame:
    """Violations on top of the kind of fault, each with its own probability; those further down win."""
    ids = [col(k) for k in keys]
    hit = lambda label, p: where & (draw(seed, label, *ids) < p)
    u = lambda label: draw(seed, label, *ids)
    made: dict[str, Column] = {}

    def put(name: str, condition: Column, value: Column) -> None:
        if name in df.columns:
            made[name] = F.when(condition, value.cast(df.schema[name].dataType)).otherwise(made.get(name, col(name)))

    for s in ("Dl", "Ul"):
        rate, used, available = f"DRB.UEThp{s}", f"RRU.PrbUsed{s}", f"RRU.PrbAvail{s}"
        if cell:
            if {rate, used} <= set(df.columns):
                put(used, hit("zero", rates.zero_resource), F.lit(0))
                put(rate, hit("zero", rates.zero_resource), F.greatest(F.lit(0.01), F.coalesce(number(col(rate)), F.lit(0.01))))
            if {used, available} <= set(df.columns):
                put(used, hit("above", rates.above_available) & col(available).isNotNull(), number(col(available)) + 1 + F.floor(u("above_by") * 6))
            put(rate, hit("low", rates.low_rate), pick(u(f"low{s}"), [0.0, 0.001, 0.005]))
        else:
            for name in (used, rate):
                put(name, hit("mismatch", rates.mismatch) & col(name).isNotNull() if name in df.columns else F.lit(False), (number(col(name)) if name in df.columns else F.lit(0.0)) * (0.6 + 0.8 * u(f"scale{name}")))
    if cell:
        if {"RRC.ConnMean", "RRC.ConnMax"} <= set(df.columns):
            put("RRC.ConnMax", hit("conn", rates.mean_above_max), F.greatest(F.lit(0.0), F.coalesce(number(col("RRC.ConnMean")), F.lit(3.0)) - 1 - F.floor(u("conn_by") * 3)))
        if "PEE.Energy" in df.columns:
            put("PEE.Energy", hit("energy", rates.energy_spike), F.coalesce(number(col("PEE.Energy")), F.lit(0.0)) * (1.3 + 0.7 * u("energy_by")))
        elif "PEE.AvgPower" in df.columns:
            put("PEE.AvgPower", hit("energy", rates.energy_spike), F.coalesce(number(col("PEE.AvgPower")), F.lit(0.0)) * (1.5 + u("energy_by")))
    return df.withColumns(made)


def fault_kind(window_number: Column, seed: int, *keys: Column) -> Column:
    """timeliness in even windows and by half the draws elsewhere; else one of the four kinds."""
    return F.when((F.pmod(window_number, F.lit(2)) == 0) | (draw(seed, "late", *keys) < 0.5), "timeliness").otherwise(pick(draw(seed, "kind", *keys), KINDS))


def inject(df: DataFrame, ts: str, keys: Sequence[str], windows: DataFrame, start: int, size: int, step: int, share: float = 0.15, rows: float = 0.3, seed: int = 0, rates: Rates = Rates(), cell: bool = True) -> tuple[DataFrame, DataFrame]:
    """In-place faults in a share of windows, and the manifest (window_id, kind, n, keys).

    A row's fault window is the last one that begins at or before it. In chosen windows some times are
    dropped or shifted, and a share of the rows takes the mutations of its kind.
    """
    number_ = F.floor((F.unix_micros(col(ts)) - F.lit(start)) / F.lit(step * 1_000_000))
    marked = df.withColumn("_w", number_).withColumn("_key", F.concat_ws("|", *[col(k).cast("string") for k in keys]))
    chosen = draw(seed, "window", F.col("_w")) < share
    hit = F.coalesce(chosen & (draw(seed, "row", F.col("_w"), F.col("_key")) < rows), F.lit(False))
    marked = marked.withColumn("_hit", hit).withColumn("_kind", F.when(F.col("_hit"), fault_kind(F.col("_w"), seed, F.col("_w"), F.col("_key"))))
    out = updates(marked, F.col("_kind"), F.col("_hit"), cell_rules() if cell else ue_rules())
    out = extra_violations(out, F.col("_hit"), seed, ["_key"], rates, cell)
    late = F.col("_hit") & (F.col("_kind") == "timeliness")
    moved = F.when(draw(seed, "drop", F.col("_key")) < rates.drop_time, F.lit(None).cast("timestamp")).when(draw(seed, "micro", F.col("_key")) < rates.micro_jitter, F.timestamp_micros(F.unix_micros(col(ts)) + pick(draw(seed, "micro_by", F.col("_key")), [-20, -10, 10, 20]) * 1_000_000)).otherwise(F.timestamp_micros(F.unix_micros(col(ts)) + pick(draw(seed, "macro_by", F.col("_key")), [-240, -180, -120, 120, 180, 240]) * 1_000_000))
    out = out.withColumn(ts, F.when(late, moved).otherwise(col(ts)))
    manifest = marked.where("_hit").groupBy(F.col("_w").alias("window_number")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("_kind")).alias("fault_types"), F.array_sort(F.collect_set("_key")).alias("keys"))
    return out.drop("_w", "_key", "_hit", "_kind"), windows.join(manifest, "window_number")


def duplicate_with_faults(df: DataFrame, keys: Sequence[str], share: float, seed: int, rules: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """The table and faulty copies of a share of its rows."""
    key = F.concat_ws("|", *[col(k).cast("string") for k in keys])
    return with_copies(df, df.where(draw(seed, "copy", key) < share).withColumn("fault_type", pick(draw(seed, "kind", key), KINDS)), rules)


def with_copies(df: DataFrame, copies: DataFrame, rules: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """The table and given copies of its rows, changed by the rules of their fault_type."""
    return df.withColumn("fault_type", F.lit(None).cast("string")).unionByName(updates(copies, F.col("fault_type"), F.lit(True), rules))


def shift_probe(df: DataFrame, ts: str, slots: Sequence[int], seconds: int, start: int, step: int) -> DataFrame:
    """Times of the named slots moved by so many seconds, to see what a timeliness check makes of it."""
    slot = F.floor((F.unix_micros(col(ts)) - F.lit(start)) / F.lit(step * 1_000_000))
    return df.withColumn(ts, F.when(slot.isin(list(slots)), F.timestamp_micros(F.unix_micros(col(ts)) + F.lit(seconds * 1_000_000))).otherwise(col(ts)))
