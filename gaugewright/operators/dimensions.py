"""Scores of sliding windows over two report streams: every check of the five dimensions.

Row checks don't depend on the window, so rows are counted by time (and by the entity's time before)
first, and these small tables reach the windows, not the rows. What depends on a window's ends (gaps to
the row before, the grid's anchor) is taken from them there. Only the medians of A1 see rows in windows.

A check is (passed, total) for each window; the dimensions add them up. Windows without rows are there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from statistics import median

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.exprs import between_or_any, col, micros, number, ratio, row_all
from gaugewright.operators import checks
from gaugewright.operators.baselines import presence_baseline, range_learned
from gaugewright.operators.windows import spine, window_numbers
from gaugewright.sources.readers import CELL, GROUPS, UE

SIDES, TS = ("Dl", "Ul"), "timestamp"
#: Bounds that hold where nothing was learned, and the floor of A3.
FALLBACK_RANGES = {"RRU.PrbTotDl": (0.0, 100.0), "RRU.PrbTotUl": (0.0, 100.0), "DRB.UECqiDl": (0, 15), "DRB.UECqiUl": (0, 15), "Mac.BlerDl": (0.0, 1.0), "Mac.BlerUl": (0.0, 1.0)}
CONTEXT_FLOOR = 0.002
#: Metric groups that UE reports (False) and cell reports (True) don't carry.
NOT_IN = {False: ("connections", "energy"), True: ("cqi",)}
#: Row checks and aggregate checks of each dimension, and whether inactive ones are left out of coverage.
DIMENSIONS = {
    "timeliness": (("T1", "T3"), ("T2",), False), "completeness": (("C1",), ("C2", "C3", "C4"), False), "validity": (("V1", "V2", "V3", "V4", "V5"), (), True),
    "consistency": (("CS1_1", "CS1_2", "CS1_2b", "CS1_3"), ("CS2", "CS3_thp_dl", "CS3_thp_ul", "CS3_prb_dl", "CS3_prb_ul"), True), "accuracy": (("A2_dl", "A2_ul", "A3_dl", "A3_ul"), ("A1_dl", "A1_ul"), False),
}


@dataclass(frozen=True)
class Rules:
    """A baseline document as the numbers that the checks need. groups: metric groups whose columns V1 and V2 look at."""

    baseline: Mapping
    groups: Sequence[str] = ()
    mandatory: tuple[Sequence[str], Sequence[str]] = ((TS, CELL), (TS, UE))
    range_source: str = "fallback"
    unit_khz: float = 180.0

    @property
    def cadence(self) -> float:
        return float(self.baseline.get("cadence_sec") or 60.0)

    @property
    def resolution(self) -> float:
        return float(self.baseline.get("ts_resolution_sec") or 1.0)

    def ranges(self, kind: str) -> Mapping:
        return (self.baseline.get("field_ranges") or {}).get(f"{kind}_metrics") or {}

    def silence(self) -> float:
        """Below this a rate counts as none: the median of the first percentiles of the rates."""
        found = [self.ranges(k)[f"DRB.UEThp{s}"]["p01"] for k in ("cell", "ue") for s in SIDES if self.ranges(k).get(f"DRB.UEThp{s}", {}).get("p01") is not None]
        return float(median(found)) if found else 0.001

    def decimals(self, side: str) -> int:
        known = self.baseline.get("prb_pct_decimals") or {}
        return int(known.get(f"RRU.PrbTot{side}", known.get(side.lower(), 2)))

    def slack(self, rule: str, side: str) -> Column:
        return checks.rule_slack(number(col(f"RRU.PrbAvail{side}")), self.decimals(side), ((self.baseline.get("prb_rule_slack_prb") or {}).get(rule) or {}).get(side.lower()) or 0)

    def bounds(self, name: str) -> tuple[float, float] | None:
        """Bounds of V2. "learned" takes what was learned, padded; the default is the fallback, as windows have been scored."""
        for kind in ("cell", "ue"):
            got = self.ranges(kind).get(name) or {}
            low, high = got.get("p01", got.get("min")), got.get("p99", got.get("max"))
            if self.range_source == "learned" and low is not None and high is not None:
                return checks.padded(name, low, high, self.cadence, self.resolution)
        return FALLBACK_RANGES.get(name)

    def percent_learned(self, side: str) -> bool:
        return any(range_learned(self.ranges(k), f"RRU.PrbTot{side}") for k in ("cell", "ue"))

    def cap(self, side: str) -> float:
        known = self.baseline.get("accuracy_spectral_eff") or {}
        p99, most = known.get(f"{side.lower()}_p99"), float(known.get("abs_cap_global") or 30.0)
        return min(most, 1.2 * float(p99)) if p99 is not None else most

    def energy_band(self) -> tuple[float, float] | None:
        band = self.baseline.get("energy_power_band") or {}
        known = band.get("ratio_q1") is not None and band.get("ratio_q3") is not None
        return (float(band["ratio_q1"]), float(band["ratio_q3"])) if known and ((band.get("n") or 0) == 0 or band["n"] >= 30) else None

    def quartiles(self, key: str, side: str) -> tuple[float, float] | None:
        band = (self.baseline.get(key) or {}).get(side.lower()) or {}
        return (float(band["q25"]), float(band["q75"])) if band.get("q25") is not None and band.get("q75") is not None else None


def problems(cells: DataFrame, ues: DataFrame) -> list[str]:
    """What keeps the two streams from being scored at all."""
    return [f"{kind} reports have no column {c}" for kind, df, need in (("cell", cells, (TS, CELL)), ("UE", ues, (TS, UE))) for c in need if c not in df.columns]


def both_sides(make) -> Column:
    return row_all([x for s in SIDES for x in make(s)])


def row_checks(rules: Rules, columns: Sequence[str], cell: bool) -> dict[str, Column]:
    """The tri-state row checks for which a table has the columns."""
    has = lambda *names: set(names) <= set(columns)
    groups = [m for g in rules.groups if g not in NOT_IN[cell] for m in GROUPS[g] if m in columns and (cell or "Prb" not in m or "Used" in m)]
    out: dict[str, Column] = {"C1": checks.mandatory(rules.mandatory[0 if cell else 1])}
    if groups:
        out["V1"] = checks.parsable(groups)
        bounds = {m: b for m in groups if (b := rules.bounds(m))}
        if bounds:
            out["V2"] = checks.ranges(bounds)
    floor = rules.silence()
    if not cell:
        if has("RRC.ConnMean", "DRB.UEThpDl", "DRB.UEThpUl"):
            out["CS1_2b"] = checks.idle_means_silent("RRC.ConnMean", ["DRB.UEThpDl", "DRB.UEThpUl"], floor)
        return out
    sides = [s for s in SIDES if has(f"RRU.PrbUsed{s}", f"RRU.PrbAvail{s}")]
    if sides:
        out["V3"] = checks.used_within_available([(f"RRU.PrbUsed{s}", f"RRU.PrbAvail{s}") for s in sides])
    sides = [s for s in sides if has(f"RRU.PrbTot{s}", f"RRU.PrbTot{s}_abs")]
    if sides:
        names = lambda s: (f"RRU.PrbUsed{s}", f"RRU.PrbTot{s}_abs", f"RRU.PrbAvail{s}")
        out["V4"] = row_all([checks.business_rules(*names(s), None if rules.percent_learned(s) else f"RRU.PrbTot{s}", rules.slack("tot_le_avail", s), rules.slack("used_le_tot", s)) for s in sides])
        out["V5"] = row_all([checks.percent_identity(f"RRU.PrbTot{s}_abs", f"RRU.PrbAvail{s}", f"RRU.PrbTot{s}", rules.decimals(s)) for s in sides])
    rates, used = [f"DRB.UEThp{s}" for s in SIDES], [f"RRU.PrbUsed{s}" for s in SIDES]
    if has("RRC.ConnMean", "RRC.ConnMax"):
        out["CS1_1"] = checks.mean_within_max("RRC.ConnMean", "RRC.ConnMax")
    if has("RRC.ConnMean", *rates):
        out["CS1_2"] = checks.idle_means_silent("RRC.ConnMean", rates, floor)
    if has(*rates, *used):
        out["CS1_3"] = checks.traffic_needs_resources(list(zip(rates, used, strict=True)), floor)
    for s in SIDES:
        if has(f"DRB.UEThp{s}", f"RRU.PrbAvail{s}"):
            out[f"A2_{s.lower()}"] = checks.cap(f"DRB.UEThp{s}", f"RRU.PrbAvail{s}", rules.cap(s), unit=rules.unit_khz * 1e3)
        if has(f"DRB.UEThp{s}", f"RRU.PrbUsed{s}"):
            out[f"A3_{s.lower()}"] = checks.rate_needs_resource(f"DRB.UEThp{s}", f"RRU.PrbUsed{s}", CONTEXT_FLOOR)
    return out


def by_time(df: DataFrame, entity: str, rules: Rules, cell: bool, tiebreak: str | None) -> tuple[DataFrame, list[str]]:
    """Counts of every row check by time and the entity's time before, and the names of the counts."""
    made = row_checks(rules, df.columns, cell)
    skip = {*rules.mandatory[0 if cell else 1], *GROUPS["unreliable"], tiebreak}
    fields = [c for c in df.columns if c not in skip]
    rows = checks.with_previous(df.where(col(TS).isNotNull()), entity, TS, "_prev", tiebreak=tiebreak)
    sums = {f"{e}_{n}": f(c) for n, c in made.items() for e, f in (("p", F.count_if), ("n", F.count))}
    sums |= {"rows": F.count(F.lit(1)), "named": F.count(col(entity)), "p_C4": sum((F.count(col(f)) for f in fields), F.lit(0)), "n_C4": F.lit(len(fields)) * F.count(F.lit(1))}
    if cell:
        fine = [F.coalesce(made[f"A2_{k}"], F.lit(True)) & F.coalesce(made[f"A3_{k}"], F.lit(True)) for k in ("dl", "ul") if f"A2_{k}" in made and f"A3_{k}" in made]
        sums["accurate"] = sum((F.count_if(f) for f in fine), F.lit(0))
        if {"PEE.Energy_interval", "PEE.AvgPower"} <= set(df.columns):
            energy, power = number(col("PEE.Energy_interval")), number(col("PEE.AvgPower"))
            ok = energy.isNotNull() & power.isNotNull()
            for flag in ("PEE.Energy_reset", "PEE.Energy_imputed"):
                ok = ok & ~F.coalesce(col(flag), F.lit(False)) if flag in df.columns else ok
            sums |= {"energy": F.sum(F.when(ok, energy)), "power": F.sum(F.when(ok, power))}
    out = rows.groupBy(micros(col(TS)).alias("us"), micros(col("_prev")).alias("prev")).agg(*[c.cast("double").alias(n) for n, c in sums.items()])
    return out, list(sums)


def into_windows(df: DataFrame, start: int, end: int, size: int, step: int) -> DataFrame:
    """Rows with a time in `us`, one for each window that they lie in."""
    out = df.withColumn("window_number", F.explode(window_numbers(F.timestamp_micros("us"), start, end, size, step)))
    return out.withColumn("low", F.lit(start) + F.col("window_number") * F.lit(step * 1_000_000))


def counted(df: DataFrame, entity: str, rules: Rules, span: tuple[int, int], size: int, step: int, cell: bool, tiebreak: str | None) -> DataFrame:
    """Counts of the row checks of one stream for each window."""
    each, names = by_time(df, entity, rules, cell, tiebreak)
    rows = into_windows(each, *span, size, step)
    before = F.col("prev") >= F.col("low")
    gap = F.when(before, (F.col("us") - F.col("prev")) / 1e6)
    named = F.when(before, F.col("rows"))  # rows with a row before have an entity
    out = [F.sum(n).alias(n) for n in names if n != "power"]
    out += [F.sum(F.when(F.abs(gap - rules.cadence) <= rules.resolution, named)).alias("p_T1"), F.sum(named).alias("n_T1")]
    if "power" in names:
        hours = F.greatest(F.coalesce(gap, F.lit(rules.cadence)) / 3600, F.lit(1e-9))
        out.append(F.sum(F.col("power") / 1000 * hours).alias("spent"))
    return rows.groupBy("window_number").agg(*out)


def ticks(cells: DataFrame, ues: DataFrame) -> DataFrame:
    """For each time: distinct entities of either stream, and sums of what both measure."""
    measures = [f"{m}{s}" for m in ("DRB.UEThp", "RRU.PrbUsed") for s in SIDES]
    value = lambda df, m: number(col(m)) if m in df.columns else F.lit(None).cast("double")
    rows = [df.where(col(TS).isNotNull()).select(micros(col(TS)).alias("us"), F.lit(kind).alias("kind"), col(e).alias("entity"), *[value(df, m).alias(f"m{i}") for i, m in enumerate(measures)]) for df, kind, e in ((cells, "c", CELL), (ues, "u", UE))]
    each = rows[0].unionByName(rows[1]).groupBy("us", "kind").agg(F.countDistinct("entity").alias("entities"), *[F.coalesce(F.sum(f"m{i}"), F.lit(0.0)).alias(f"m{i}") for i in range(4)])
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return each.groupBy("us").agg(*[of(k, c).alias(f"{c}_{k}") for k in "cu" for c in ("entities", "m0", "m1", "m2", "m3")])


def from_ticks(each: DataFrame, rules: Rules, span: tuple[int, int], size: int, step: int, document: Mapping | None) -> tuple[DataFrame, DataFrame]:
    """T2, C2 and C3 of each window; and CS3 of each window."""
    cadence = int(rules.cadence * 1e6)
    whole = Window.partitionBy("window_number")  # the times of one window: its size over the cadence
    rows = into_windows(each, *span, size, step)
    rows = rows.withColumn("first", F.min("us").over(whole)).withColumn("anchor", F.col("first") - F.pmod("first", F.lit(cadence)))
    rows = rows.withColumn("k", F.rint((F.col("us") - F.col("anchor")) / cadence).cast("long"))
    slots = F.floor((F.max("us") - F.min("anchor")) / cadence) + 1
    apart = F.abs(F.col("us") - (F.col("anchor") + F.col("k") * cadence))
    aligned = F.when(apart <= min(rules.resolution, 0.1 * rules.cadence) * 1e6, F.col("k"))
    times, wide = F.count("us"), (F.max("us") - F.min("us")) / 1e6
    agg = rows.groupBy("window_number").agg(
        F.collect_set(aligned).alias("aligned"), slots.cast("double").alias("n_T2"), times.cast("double").alias("p_C3"), F.when(wide > 0, F.rint(wide / rules.cadence) + 1).otherwise(times).cast("double").alias("n_C3"),
        F.avg("entities_c").alias("cells"), F.avg("entities_u").alias("ues"), F.hour(F.timestamp_micros(F.coalesce(F.min(F.when(F.col("entities_c").isNotNull(), F.col("us"))), F.min("us")))).alias("hour"),
    )
    expected = presence_baseline(document)
    want = {k: F.get(F.array(*[F.lit(float(expected[kind][h])) for h in range(24)]), F.col("hour")) for k, kind in (("c", "cells"), ("u", "ues"))}
    got = {"c": F.coalesce("cells", F.lit(0.0)), "u": F.coalesce("ues", F.lit(0.0))}
    covered = F.least(got["c"], F.floor(want["c"]).cast("double")) + F.least(got["u"], F.floor(want["u"]).cast("double"))
    agg = agg.select(
        "window_number", "n_T2", "p_C3", "n_C3", F.size(F.filter("aligned", lambda k: k < F.col("n_T2"))).cast("double").alias("p_T2"), F.floor(covered).cast("double").alias("p_C2"), F.floor(want["c"] + want["u"]).cast("double").alias("n_C2"),
        ratio(got["c"], want["c"]).alias("ratio_cells"), ratio(got["u"], want["u"]).alias("ratio_ues"),
    )
    at = rows.groupBy("window_number", "k").agg(*[F.sum(f"m{i}_{x}").alias(f"{x}{i}") for i in range(4) for x in "cu"]).where("c0 is not null and u0 is not null")
    recon = []
    for i, name in enumerate(f"CS3_{m}_{s.lower()}" for m in ("thp", "prb") for s in SIDES):
        band = rules.quartiles(f"ue_cell_{name[4:7]}_ratio", name[8:])
        if band:
            low, high = band
            wide_ = 1.5 * max(high - low, 1e-9)
            r = F.when(F.col(f"c{i}") > 0, ratio(F.col(f"u{i}"), F.col(f"c{i}")))
            enough = F.count(r) >= 5
            passed = F.percentile(r, 0.5).between(low - wide_, high + wide_) | (F.avg(r.between(low, high).cast("double")) >= 0.5)
            recon += [F.when(enough & passed, 1.0).otherwise(0.0).alias(f"p_{name}"), F.when(enough, 1.0).otherwise(0.0).alias(f"n_{name}")]
    return agg, at.groupBy("window_number").agg(*recon or [F.lit(0.0).alias("_none")])


def efficiencies(cells: DataFrame, rules: Rules, span: tuple[int, int], size: int, step: int) -> DataFrame:
    """A1 of each window: the median rate per resource is within what was learned."""
    made, out = {}, [F.lit(0.0).alias("_nothing")]
    for s in SIDES:
        band = rules.quartiles("accuracy_thp_per_prb_band", s)
        if band and {f"DRB.UEThp{s}", f"RRU.PrbUsed{s}"} <= set(cells.columns):
            used = number(col(f"RRU.PrbUsed{s}"))
            made[f"r_{s.lower()}"] = F.when(used > 0, ratio(number(col(f"DRB.UEThp{s}")) * 1000, used))
            x = F.col(f"r_{s.lower()}")
            enough = F.count(x) >= 10
            out += [F.when(enough & F.percentile(x, 0.5).between(*band), 1.0).otherwise(0.0).alias(f"p_A1_{s.lower()}"), F.when(enough, 1.0).otherwise(0.0).alias(f"n_A1_{s.lower()}")]
    rows = cells.where(col(TS).isNotNull()).select(micros(col(TS)).alias("us"), *[c.alias(n) for n, c in made.items()])
    some = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in made], F.lit(False))
    return into_windows(rows.where(some), *span, size, step).groupBy("window_number").agg(*out)


def window_checks(cells: DataFrame, ues: DataFrame, rules: Rules, span: tuple[int, int], size: int, step: int, presence: Mapping | None = None, tiebreak: str | None = None) -> DataFrame:
    """A row for each window: window_id, window_number, its ends, and p_<check>, n_<check> of every check."""
    grid, recon = from_ticks(ticks(cells, ues), rules, span, size, step, presence)
    of_cells = counted(cells, CELL, rules, span, size, step, True, tiebreak)
    of_ues = counted(ues, UE, rules, span, size, step, False, tiebreak)
    of_ues = of_ues.select("window_number", *[F.col(c).alias(f"ue_{c}") for c in of_ues.columns if c != "window_number"])
    out = spine(cells, *span, size, step)
    for part in (of_cells, of_ues, grid, recon, efficiencies(cells, rules, span, size, step)):
        out = out.join(part, "window_number", "left")
    has, zero = set(out.columns), F.lit(0.0)
    total = lambda name: sum((F.coalesce(c, zero) for c in (name, f"ue_{name}") if c in has), zero)
    names = [n for rows, sums, _ in DIMENSIONS.values() for n in (*rows, *sums)]
    made = {f"{e}_{n}": total(f"{e}_{n}") for n in names for e in "pn"}
    made |= {"p_T3": total("n_T1"), "n_T3": total("n_T1"), "n_C3": F.coalesce("n_C3", F.lit(1.0))}  # in order of time none goes back; no times at all are one that is missing
    if "energy" in has:
        r = F.when(F.col("spent") > 0, F.col("energy") / F.col("spent"))
        inside = r.between(0.5, 2.0) | (r.between(*rules.energy_band()) if rules.energy_band() else F.lit(False))
        made |= {"energy_ratio": r, "p_CS2": F.when(inside, 1.0).otherwise(0.0), "n_CS2": F.when(r.isNotNull(), 1.0).otherwise(0.0)}
    else:
        made["energy_ratio"] = F.lit(None).cast("double")
    made |= {"all_rows": total("rows"), "cell_rows": F.coalesce("rows", zero), "named_rows": total("named"), "accurate_rows": F.coalesce("accurate", zero)}
    return out.select("window_id", "window_number", "window_start", "window_end", *[c.alias(n) for n, c in made.items()], "ratio_cells", "ratio_ues")


def reduced(df: DataFrame) -> DataFrame:
    """<dimension>_mpr, _apr, _coverage, _row_fails, _aggregate_fails and _total_fails from the checks' counts."""
    zero = F.lit(0.0)
    p, n = (lambda k: F.col(f"p_{k}")), (lambda k: F.col(f"n_{k}"))
    add = lambda f, names: sum((f(k) for k in names), zero)
    active = lambda c: (c > 0).cast("int")
    out: dict[str, Column] = {}
    for d, (rows, sums, drop) in DIMENSIONS.items():
        whole = add(n, (*rows, *sums))
        fails = {"row": add(n, rows) - add(p, rows), "aggregate": add(n, sums) - add(p, sums)}
        out[f"{d}_mpr"] = F.when(whole > 0, add(p, (*rows, *sums)) / whole).otherwise(0.0)
        out |= {f"{d}_{k}_fails": v.cast("long") for k, v in fails.items()} | {f"{d}_total_fails": (fails["row"] + fails["aggregate"]).cast("long")}
    of = lambda good, rows: F.when(rows > 0, good / rows).otherwise(0.0)
    # rows of stacked checks: of each that is active, all rows; of those that both streams have, the rows of both
    stacked = {"V1": "all_rows", "V2": "all_rows"}

    def stack(names: Sequence[str]) -> Column:
        rows = sum((F.when(n(k) > 0, F.col(stacked.get(k, "cell_rows"))).otherwise(0.0) for k in names), zero)
        return of(rows - sum((n(k) - p(k) for k in names), zero), rows)

    out["timeliness_apr"] = of(F.col("named_rows") - (n("T1") - p("T1")), F.col("named_rows"))
    out["completeness_apr"] = of(p("C1"), n("C1"))
    out["validity_apr"], out["consistency_apr"] = stack(DIMENSIONS["validity"][0]), stack(DIMENSIONS["consistency"][0])
    out["accuracy_apr"] = of(F.col("accurate_rows"), 2 * F.col("cell_rows"))
    a1 = active(n("A1_dl")) + active(n("A1_ul"))
    out["timeliness_coverage"] = (2 * active(F.col("named_rows")) + active(n("T2"))) / 3.0
    out["completeness_coverage"] = (active(n("C1")) + active(n("C2")) + active(n("C3")) + active(n("C4"))) / 4.0
    for d in ("validity", "consistency"):
        out[f"{d}_coverage"] = (add(n, (*DIMENSIONS[d][0], *DIMENSIONS[d][1])) > 0).cast("double")
    out["accuracy_coverage"] = (2 * active(F.col("cell_rows")) + a1) / (2.0 + a1)
    return df.withColumns(out)


#: The names of reasons, and what makes each: a share of passed rows below a limit, or a condition of its own.
SHARES = {
    "timeliness": (("T1_interarrival_issues", ("T1",), 0.80), ("T2_poor_grid_coverage", ("T2",), 0.70), ("T3_timestamp_disorder", ("T3",), 1.0)),
    "completeness": (("C4_sparse_data", ("C4",), 0.6),),
    "validity": (("V2_out_of_range", ("V2",), 0.80), ("V4_prb_violations", ("V4",), 0.90)),
    "consistency": (("CS1_intra_inconsistency", ("CS1_1", "CS1_2", "CS1_2b", "CS1_3"), 0.90),),
    "accuracy": (("A2_spectral_cap_dl", ("A2_dl",), 0.90), ("A2_spectral_cap_ul", ("A2_ul",), 0.90)),
}
OWN = {
    "completeness": (("C2_insufficient_cells", "ratio_cells < 0.7"), ("C2_low_ue_count", "ratio_ues < 0.6")),
    "consistency": (("CS2_energy_mismatch", "energy_ratio < 0.6 or energy_ratio > 1.8"),),
    "accuracy": (("A1_inefficient_dl", "n_A1_dl > 0 and p_A1_dl = 0"), ("A1_inefficient_ul", "n_A1_ul > 0 and p_A1_ul = 0")),
}


def reasons(df: DataFrame) -> DataFrame:
    """<dimension>_reasons: the names of what failed in each window."""
    add = lambda e, names: sum((F.col(f"{e}_{k}") for k in names), F.lit(0.0))
    out = {}
    for d in DIMENSIONS:
        found = [F.when((add("n", k) > 0) & (add("p", k) < add("n", k) * limit), F.lit(name)) for name, k, limit in SHARES.get(d, ())]
        found += [F.when(F.expr(condition), F.lit(name)) for name, condition in OWN.get(d, ())]
        out[f"{d}_reasons"] = F.array_compact(F.array(*found))
    return df.withColumns(out)


def window_scores(cells: DataFrame, ues: DataFrame, baseline: Mapping, span: tuple[int, int], size: int, step: int, presence: Mapping | None = None, tiebreak: str | None = None, **options) -> DataFrame:
    """Checks, scores and reasons of every window, and a status.

    Streams that can't be scored at all give windows with scores of 0 and status ERROR. A dimension whose
    columns can't be read as what its checks need has a score of 0 for that dimension only.
    """
    rules = Rules(baseline, **options)
    wrong = problems(cells, ues)
    if wrong:
        zeros = {f"{d}_{k}": F.lit(0.0) for d in DIMENSIONS for k in ("mpr", "apr", "coverage")}
        return spine(cells, *span, size, step).withColumns(zeros | {"status": F.lit("ERROR"), "error": F.lit("; ".join(wrong))})
    cells, ues, bad = readable(cells, ues, rules)
    out = reasons(reduced(window_checks(cells, ues, rules, span, size, step, presence, tiebreak)))
    return out.withColumns({"status": F.lit("ERROR" if bad else "OK"), "error": F.lit("; ".join(bad) or None).cast("string")})


def readable(cells: DataFrame, ues: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame, list[str]]:
    """The streams without columns that no check can read as numbers (arrays, structs), and what was left out."""
    out, bad = [], []
    for df in (cells, ues):
        for name, kind in df.dtypes:
            if name in (TS, CELL, UE) or kind in ("string", "boolean", "timestamp", "timestamp_ntz", "date") or name.startswith("_"):
                continue
            try:
                df.select(number(col(name)))
            except AnalysisException:
                bad.append(f"{name} is {kind}")
                df = df.drop(name)
        out.append(df)
    return out[0], out[1], bad


def failing_fields(df: DataFrame, fields: Mapping[str, Column], k: int = 5) -> DataFrame:
    """The k fields with the most rows that fail their check: field, fails."""
    counts = df.agg(*[F.count_if(~c).alias(f"f{i}") for i, c in enumerate(fields.values())])
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"f{i}").alias("fails")) for i, name in enumerate(fields)])
    return counts.select(F.inline(pairs)).where("fails > 0").orderBy(F.desc("fails"), "field").limit(k)


def range_fields(rules: Rules, columns: Sequence[str]) -> dict[str, Column]:
    """V2 of each field on its own, for reports on which fields fail."""
    return {m: between_or_any(number(col(m)), *b) for g in rules.groups for m in GROUPS[g] if m in columns and (b := rules.bounds(m))}
