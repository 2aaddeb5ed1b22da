"""Queries over report-shaped rows: cell and UE reports made from the event stream, scored, labelled and turned into features.

Expressions that only shape the input are one text for both engines; everything after that is written twice.
The two streams start at different times, have off-grid and tied times, missing names and values, and
counters that are reset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewright.operators import convert, dimensions, features, score, windows
from gaugewright.plans.catalogue import DAY, FIVE, HOUR, PARAMETERS, events, query, rounded
from gaugewright.sources.readers import CELL, UE

TS = "timestamp"
AT = "raw - raw % 3600000000 + CASE WHEN event_id % 5 = 0 THEN 240000000 WHEN event_id % 7 = 0 THEN 600000000 WHEN event_id % 11 = 0 THEN 1800000000 ELSE 0 END"
CELL_NAME = "CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('S', CAST(user_id % 4 + 1 AS STRING), '/B', CAST(user_id % 3 + 1 AS STRING), '/C', CAST(user_id % 2 + 1 AS STRING)) END"
UE_NAME = "CASE WHEN event_id % 89 = 0 THEN NULL ELSE concat('UE', CAST(user_id % 7 AS STRING)) END"
IS_CELL = "event_type IN ('click', 'view', 'error')"
IS_UE = "event_type IN ('signup', 'purchase') AND raw >= 1704326400000000"
CELL_VALUES = {
    "DRB.UEThpDl": "CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 23 = 0 THEN CAST(0 AS DOUBLE) ELSE value / 1013 END", "DRB.UEThpUl": "value / 4001",
    "RRU.PrbUsedDl": "k * CAST(0.5 AS DOUBLE)", "RRU.PrbUsedUl": "k * CAST(0.3 AS DOUBLE)",
    "RRU.PrbAvailDl": "CASE WHEN event_id % 61 = 0 THEN 0 WHEN event_id % 53 = 0 THEN NULL ELSE 100 END", "RRU.PrbAvailUl": "75",
    "RRU.PrbTotDl": "k * CAST(0.5 AS DOUBLE) - event_id % 4", "RRU.PrbTotUl": "k * CAST(0.3 AS DOUBLE) + CASE WHEN event_id % 13 = 0 THEN 90 ELSE 0 END",
    "RRC.ConnMean": "CASE WHEN event_id % 37 = 0 THEN NULL ELSE CAST(k % 9 AS DOUBLE) END", "RRC.ConnMax": "CAST(k % 10 + 1 AS DOUBLE)", "PEE.AvgPower": "CAST(100 + k AS DOUBLE)",
}
UE_VALUES = {
    "DRB.UEThpDl": "value / 1301", "DRB.UEThpUl": "value / 5003", "RRU.PrbUsedDl": "k * CAST(0.4 AS DOUBLE)", "RRU.PrbUsedUl": "k * CAST(0.2 AS DOUBLE)",
    "RRC.ConnMean": "CAST(k % 5 AS DOUBLE)", "DRB.UECqiDl": "CAST(k % 20 AS DOUBLE)", "TB.TotNbrDl": "CAST(k AS DOUBLE)",
}
#: The counter: a running sum of whole numbers, so that both engines agree to the last digit.
ENERGY = "CASE WHEN event_id % 50 = 0 THEN 0 ELSE run END * CAST(0.02 AS DOUBLE)"
BASELINE = {
    "cadence_sec": 3600, "ts_resolution_sec": 300, "prb_pct_decimals": {"RRU.PrbTotDl": 1, "RRU.PrbTotUl": 1}, "energy_power_band": {"ratio_q1": 0.9, "ratio_q3": 1.1, "n": 100},
    "ue_cell_thp_ratio": {"dl": {"q25": 0.4, "q75": 0.6}, "ul": {"q25": 0.2, "q75": 0.3}}, "ue_cell_prb_ratio": {"dl": {"q25": 0.5, "q75": 0.9}, "ul": {"q25": 0.9, "q75": 1.2}},
    "prb_rule_slack_prb": {"tot_le_avail": {"dl": 1, "ul": 2}, "used_le_tot": {"dl": 0, "ul": 3}}, "accuracy_thp_per_prb_band": {"dl": {"q25": 1.0, "q75": 1.6}, "ul": {"q25": 0.1, "q75": 0.5}},
    "accuracy_spectral_eff": {"dl_p99": 6.0, "ul_p99": 1.0}, "field_ranges": {"cell_metrics": {"DRB.UEThpDl": {"p01": 0.002}, "DRB.UEThpUl": {"p01": 0.004}}, "ue_metrics": {"DRB.UEThpUl": {"p01": 0.02}}},
}
PRESENCE = {"cells": {"0": {"median": 2}, "6": {"median": 3.5}, "12": {"median": 1}, "18": {"median": 4}}, "ues": {"0": {"median": 1.5}, "6": {"median": 2}}}
GROUPS_USED = ("throughput", "prb", "connections", "energy", "cqi")
SIZE, STEP = DAY, 6 * HOUR


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf).withColumn("raw", F.unix_micros("ts")).withColumn("k", F.col("k").cast("bigint"))
    return ev.withColumn("us", F.expr(AT))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Converted cell reports."""
    rows = raw_rows(spark, sf).where(IS_CELL).select(F.timestamp_micros("us").alias(TS), F.expr(CELL_NAME).alias(CELL), *[F.expr(x).alias(n) for n, x in CELL_VALUES.items()], "event_id", "k")
    run = F.sum("k").over(Window.partitionBy(f"`{CELL}`").orderBy(TS, "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("run", run).withColumn("PEE.Energy", F.expr(ENERGY)).drop("run", "k")
    return convert.convert_cells(rows, CELL, TS, HOUR, tiebreak="event_id")


def ues(spark: SparkSession, sf: str) -> DataFrame:
    return raw_rows(spark, sf).where(IS_UE).select(F.timestamp_micros("us").alias(TS), F.expr(UE_NAME).alias(UE), *[F.expr(x).alias(n) for n, x in UE_VALUES.items()], "event_id")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    c, u = cells(spark, sf), ues(spark, sf)
    return dimensions.window_scores(c, u, BASELINE, windows.span([(c, TS), (u, TS)]), SIZE, STEP, PRESENCE, "event_id", groups=GROUPS_USED)


def _columns(values: dict[str, str]) -> str:
    return ", ".join(f'{x} AS "{n}"' for n, x in values.items())


REPORTS = f"""
e AS (SELECT *, epoch_us(ts) AS raw, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), r AS (SELECT *, {AT} AS us FROM e),
c0 AS (SELECT event_id, us, k, {CELL_NAME} AS ent, {_columns(CELL_VALUES)} FROM r WHERE {IS_CELL}),
c1 AS (SELECT *, {ENERGY.replace("run", "sum(k) OVER (PARTITION BY ent ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)")} AS energy FROM c0),
c2 AS (SELECT *, CASE WHEN ent IS NOT NULL THEN lag(us) OVER w END AS prev, CASE WHEN ent IS NOT NULL THEN energy - lag(energy) OVER w END AS delta FROM c1 WINDOW w AS (PARTITION BY ent ORDER BY us, event_id)),
c AS (SELECT *, coalesce(delta < 0, false) AS reset, coalesce(delta < 0, true) AS imputed, coalesce(CASE WHEN delta >= 0 THEN delta END, "PEE.AvgPower" / 1000 * greatest(coalesce((us - prev) / 1e6, 3600) / 3600, 1e-9)) AS step,
      CASE WHEN "RRU.PrbAvailDl" > 0 THEN "RRU.PrbTotDl" / 100 * "RRU.PrbAvailDl" END AS tdl, "RRU.PrbTotUl" / 100 * "RRU.PrbAvailUl" AS tul FROM c2),
u0 AS (SELECT event_id, us, {UE_NAME} AS ent, {_columns(UE_VALUES)} FROM r WHERE {IS_UE}),
u AS (SELECT *, CASE WHEN ent IS NOT NULL THEN lag(us) OVER (PARTITION BY ent ORDER BY us, event_id) END AS prev FROM u0),
ends AS (SELECT greatest((SELECT min(us) FROM c), (SELECT min(us) FROM u)) AS s, least((SELECT max(us) FROM c), (SELECT max(us) FROM u)) AS t),
spine AS (SELECT i AS window_number, s + i * {STEP}000000 AS lo, s + i * {STEP}000000 + {SIZE}000000 AS hi FROM ends, unnest(generate_series(0, (t - s - {SIZE}000000) // {STEP}000000)) AS g(i)),
xc AS (SELECT window_number, lo, CASE WHEN prev >= lo THEN prev END AS before, c.* FROM c JOIN spine ON us >= lo AND us < hi),
xu AS (SELECT window_number, lo, CASE WHEN prev >= lo THEN prev END AS before, u.* FROM u JOIN spine ON us >= lo AND us < hi)"""


def _all(*rules: str) -> str:
    """Tri-state: passes if all that apply do."""
    return f"CASE WHEN {' OR '.join(f'({x}) IS NOT NULL' for x in rules)} THEN {' AND '.join(f'coalesce({x}, true)' for x in rules)} END"


def _side(s: str) -> dict[str, str]:
    return {"u": f'"RRU.PrbUsed{s}"', "a": f'"RRU.PrbAvail{s}"', "p": f'"RRU.PrbTot{s}"', "t": f"t{s.lower()}", "x": f'"DRB.UEThp{s}"'}


def _slack(a: str, learned: int) -> str:
    return f"greatest(coalesce(least(greatest(ceil(0.5 * 0.1 / 100 * {a}), 1), 3), 1), {learned})"


def _row_rules() -> dict[str, str]:
    sides = {k.lower(): _side(k) for k in ("Dl", "Ul")}
    slack = BASELINE["prb_rule_slack_prb"]
    v3 = [r for v in sides.values() for r in (f"{v['u']} >= 0", f"{v['a']} >= 0", f"{v['u']} <= {v['a']} * 1.000001")]
    v4 = [
        r for k, v in sides.items() for r in (
            f"{v['t']} <= ({v['a']} + {_slack(v['a'], slack['tot_le_avail'][k])}) * 1.000001", f"{v['u']} <= ({v['t']} + {_slack(v['a'], slack['used_le_tot'][k])}) * 1.000001",
            f"CASE WHEN {v['a']} = 0 THEN {v['u']} = 0 END", f"{v['p']} BETWEEN 0 AND 100",
        )
    ]
    clip = lambda x: f"least(greatest({x}, 0), 100)"
    v5 = [f"CASE WHEN {v['a']} > 0 AND {v['t']} IS NOT NULL THEN abs({clip(v['t'] + ' / ' + v['a'] + ' * 100')} - {clip(v['p'])}) <= 0.05 + 1e-9 END" for v in sides.values()]
    xd, xu = (v["x"] for v in sides.values())
    out = {
        "C1": "ent IS NOT NULL", "V2": _all(*[f"{v['p']} BETWEEN 0 AND 100" for v in sides.values()]), "V3": _all(*v3), "V4": _all(*v4), "V5": _all(*v5),
        "CS1_1": 'coalesce("RRC.ConnMean" <= "RRC.ConnMax", false)', "CS1_2": f'CASE WHEN "RRC.ConnMean" = 0 THEN coalesce(abs({xd}) <= 0.004 AND abs({xu}) <= 0.004, false) END',
        "CS1_3": f"CASE WHEN coalesce({xd} > 0.004, false) OR coalesce({xu} > 0.004, false) THEN coalesce({sides['dl']['u']} > 0, false) OR coalesce({sides['ul']['u']} > 0, false) END",
    }
    out["V1"] = "true"  # every value that is there is a number, and every row has one
    for k, v in sides.items():
        out[f"A2_{k}"] = f"{v['x']} * 1e9 / nullif({v['a']} * 180e3, 0) <= {min(30.0, 1.2 * BASELINE['accuracy_spectral_eff'][k + '_p99'])}"
        out[f"A3_{k}"] = f"CASE WHEN {v['x']} IS NOT NULL AND {v['u']} IS NOT NULL THEN {v['x']} <= 0.002 OR {v['u']} > 0 END"
    return out


UE_RULES = {"C1": "ent IS NOT NULL", "V1": "true", "V2": '"DRB.UECqiDl" BETWEEN 0 AND 15', "CS1_2b": 'CASE WHEN "RRC.ConnMean" = 0 THEN coalesce(abs("DRB.UEThpDl") <= 0.004 AND abs("DRB.UEThpUl") <= 0.004, false) END'}


def _tally(rules: dict[str, str], source: str, extra: str) -> str:
    flags = ", ".join(f'{x} AS "k_{n}"' for n, x in rules.items())
    counts = ", ".join(f'count(*) FILTER (WHERE "k_{n}") AS "p_{n}", count("k_{n}") AS "n_{n}"' for n in rules)
    t1 = "count(*) FILTER (WHERE abs((us - before) / 1e6 - 3600) <= 300) AS p_t1, count(before) AS n_t1, count(*) AS n_rows, count(ent) AS n_named"
    return f"SELECT window_number, {counts}, {t1}, {extra} FROM (SELECT *, {flags} FROM {source}) GROUP BY window_number"


def _expected(kind: str, default: float) -> str:
    return "CASE hr " + " ".join(f"WHEN {h} THEN {v['median']}" for h, v in PRESENCE[kind].items()) + f" ELSE {default} END"


def _checks_sql() -> str:
    filled = "15 * count(*) + " + " + ".join(f"count({c})" for c in ('"DRB.UEThpDl"', '"RRU.PrbAvailDl"', '"RRC.ConnMean"', "tdl", "tul"))
    usable = "NOT reset AND NOT imputed"
    spent = f'sum(CASE WHEN {usable} THEN "PEE.AvgPower" / 1000 * greatest(coalesce((us - before) / 1e6, 3600) / 3600, 1e-9) END)'
    extra = f"{filled} AS p_c4, 20 * count(*) AS n_c4, sum(CASE WHEN {usable} THEN step END) / nullif({spent}, 0) AS energy_ratio, "
    for k, s in (("dl", "Dl"), ("ul", "Ul")):
        v, band = _side(s), BASELINE["accuracy_thp_per_prb_band"][k]
        x = f"CASE WHEN {v['u']} > 0 THEN {v['x']} * 1000 / {v['u']} END"
        extra += f"CAST(coalesce(count({x}) >= 10 AND quantile_cont({x}, 0.5) BETWEEN {band['q25']} AND {band['q75']}, false) AS INT) AS p_a1_{k}, CAST(count({x}) >= 10 AS INT) AS n_a1_{k}, "
    fine = " + ".join(f'count(*) FILTER (WHERE coalesce("k_A2_{k}", true) AND coalesce("k_A3_{k}", true))' for k in ("dl", "ul"))
    extra += f"{fine} AS accurate"
    recon = []
    for i, (m, key) in enumerate((("DRB.UEThp", "thp"), ("RRU.PrbUsed", "prb"))):
        for k, s in (("dl", "Dl"), ("ul", "Ul")):
            band = BASELINE[f"ue_cell_{key}_ratio"][k]
            low, high = band["q25"], band["q75"]
            wide, r = 1.5 * (high - low), f"r_{key}_{k}"
            recon.append((f'sum("{m}{s}") AS "s{i}{k}"', f"CASE WHEN a.s{i}{k} > 0 THEN b.s{i}{k} / a.s{i}{k} END AS {r}", f"CAST(count({r}) >= 5 AND coalesce(quantile_cont({r}, 0.5) BETWEEN {low - wide} AND {high + wide} OR avg(CAST({r} BETWEEN {low} AND {high} AS INT)) >= 0.5, false) AS INT) AS p_cs3_{key}_{k}, CAST(count({r}) >= 5 AS INT) AS n_cs3_{key}_{k}"))
    sums = ", ".join(f"coalesce({x.split(' AS ')[0]}, 0) AS {x.split(' AS ')[1]}" for x, _, _ in recon)
    snapped = "CAST(round_even((us - anchor) / 3600000000, 0) AS BIGINT)"
    return f"""{REPORTS},
gc AS ({_tally(_row_rules(), "xc", extra)}),
gu AS ({_tally(UE_RULES, "xu", "6 * count(*) AS p_c4, 6 * count(*) AS n_c4")}),
ts AS (SELECT window_number, us, min(us) OVER w - min(us) OVER w % 3600000000 AS anchor, max(us) OVER w AS hi FROM (SELECT window_number, us FROM xc UNION SELECT window_number, us FROM xu) WINDOW w AS (PARTITION BY window_number)),
grid AS (SELECT window_number, count(DISTINCT CASE WHEN abs(us - anchor - {snapped} * 3600000000) <= 300000000 AND {snapped} <= (hi - anchor) // 3600000000 THEN {snapped} END) AS p_t2, min(hi - anchor) // 3600000000 + 1 AS n_t2,
  count(*) AS p_c3, CASE WHEN max(us) > min(us) THEN round_even((max(us) - min(us)) / 3600000000, 0) + 1 ELSE count(*) END AS n_c3 FROM ts GROUP BY window_number),
anchors AS (SELECT window_number, min(anchor) AS anchor FROM ts GROUP BY window_number),
a AS (SELECT window_number, {snapped} AS tick, {sums} FROM xc JOIN anchors USING (window_number) GROUP BY ALL),
b AS (SELECT window_number, {snapped} AS tick, {sums} FROM xu JOIN anchors USING (window_number) GROUP BY ALL),
ratios AS (SELECT a.window_number, {", ".join(r for _, r, _ in recon)} FROM a JOIN b ON a.window_number = b.window_number AND a.tick = b.tick),
gr AS (SELECT window_number, {", ".join(x for _, _, x in recon)} FROM ratios GROUP BY window_number),
nc AS (SELECT window_number, avg(n) AS cells FROM (SELECT window_number, us, count(DISTINCT ent) AS n FROM xc GROUP BY ALL) GROUP BY ALL),
nu AS (SELECT window_number, avg(n) AS ues FROM (SELECT window_number, us, count(DISTINCT ent) AS n FROM xu GROUP BY ALL) GROUP BY ALL),
hours AS (SELECT window_number, (coalesce((SELECT min(us) FROM xc WHERE xc.window_number = spine.window_number), (SELECT min(us) FROM xu WHERE xu.window_number = spine.window_number)) // 3600000000) % 24 AS hr FROM spine),
presence AS (SELECT window_number, hr, coalesce(cells, 0) AS cells, coalesce(ues, 0) AS ues, {_expected("cells", 52)} AS ec, {_expected("ues", 33)} AS eu FROM hours LEFT JOIN nc USING (window_number) LEFT JOIN nu USING (window_number)),
checked AS (SELECT window_number, lo,
  {", ".join(f'coalesce(gc."{e}_{n}", 0)' + (f' + coalesce(gu."{e}_{n}", 0)' if n in UE_RULES else "") + f' AS "{e}_{n}"' for n in _row_rules() for e in "pn")}, coalesce(gu."p_CS1_2b", 0) AS "p_CS1_2b", coalesce(gu."n_CS1_2b", 0) AS "n_CS1_2b",
  coalesce(gc.p_t1, 0) + coalesce(gu.p_t1, 0) AS "p_T1", coalesce(gc.n_t1, 0) + coalesce(gu.n_t1, 0) AS "n_T1", coalesce(gc.n_t1, 0) + coalesce(gu.n_t1, 0) AS "p_T3", coalesce(gc.n_t1, 0) + coalesce(gu.n_t1, 0) AS "n_T3",
  coalesce(p_t2, 0) AS "p_T2", coalesce(n_t2, 0) AS "n_T2", CASE WHEN hr IS NULL THEN 0 ELSE floor(least(cells, floor(ec)) + least(ues, floor(eu))) END AS "p_C2", CASE WHEN hr IS NULL THEN 0 ELSE floor(ec + eu) END AS "n_C2",
  coalesce(p_c3, 0) AS "p_C3", coalesce(n_c3, 1) AS "n_C3", coalesce(gc.p_c4, 0) + coalesce(gu.p_c4, 0) AS "p_C4", coalesce(gc.n_c4, 0) + coalesce(gu.n_c4, 0) AS "n_C4",
  energy_ratio, CAST(coalesce(energy_ratio BETWEEN 0.5 AND 2 OR energy_ratio BETWEEN 0.9 AND 1.1, false) AS INT) AS "p_CS2", CAST(energy_ratio IS NOT NULL AS INT) AS "n_CS2",
  {", ".join(f'coalesce({e}_cs3_{m}_{s}, 0) AS "{e}_CS3_{m}_{s}"' for m in ("thp", "prb") for s in ("dl", "ul") for e in "pn")}, {", ".join(f'coalesce({e}_a1_{s}, 0) AS "{e}_A1_{s}"' for s in ("dl", "ul") for e in "pn")},
  cells / nullif(ec, 0) AS ratio_cells, ues / nullif(eu, 0) AS ratio_ues, hr IS NOT NULL AS known, coalesce(gc.n_rows, 0) AS cell_rows, coalesce(gc.n_rows, 0) + coalesce(gu.n_rows, 0) AS all_rows, coalesce(gc.n_named, 0) + coalesce(gu.n_named, 0) AS named, coalesce(accurate, 0) AS accurate
  FROM spine LEFT JOIN gc USING (window_number) LEFT JOIN gu USING (window_number) LEFT JOIN grid USING (window_number) LEFT JOIN gr USING (window_number) LEFT JOIN presence USING (window_number))"""


CHECKED = _checks_sql()
NAMES = [n for rows, sums, _ in dimensions.DIMENSIONS.values() for n in (*rows, *sums)]


@query(f"WITH {CHECKED} SELECT window_number, " + ", ".join(f'CAST("{e}_{n}" AS BIGINT) AS "{e}_{n}"' for n in NAMES for e in "pn") + ", round(energy_ratio, 6) AS energy_ratio FROM checked")
def report_checks(spark, sf):
    """Passed and total of every check for each window."""
    out = scored(spark, sf)
    return rounded(out.select("window_number", *[F.col(f"{e}_{n}").cast("long").alias(f"{e}_{n}") for n in NAMES for e in "pn"], "energy_ratio"))


def _score_sql() -> str:
    out = []
    for d, (rows, sums, _) in dimensions.DIMENSIONS.items():
        add = lambda e, names: " + ".join(f'"{e}_{n}"' for n in names) or "0"
        n, p = add("n", (*rows, *sums)), add("p", (*rows, *sums))
        out += [f"CASE WHEN {n} > 0 THEN ({p}) / ({n}) ELSE 0 END AS {d}_mpr", f"{add('n', rows)} - ({add('p', rows)}) AS {d}_row_fails", f"{add('n', sums)} - ({add('p', sums)}) AS {d}_aggregate_fails"]
    stack = lambda names: f"coalesce(1 - ({' + '.join(f'n_{n} - p_{n}' for n in names)}) / nullif({' + '.join(f'CASE WHEN n_{n} > 0 THEN {dict(V1='all_rows', V2='all_rows').get(n, 'cell_rows')} ELSE 0 END' for n in names)}, 0), 0)"
    out += [
        "coalesce((named - n_T1 + p_T1) / nullif(named, 0), 0) AS timeliness_apr", "coalesce(p_C1 / nullif(n_C1, 0), 0) AS completeness_apr", f"{stack(dimensions.DIMENSIONS['validity'][0])} AS validity_apr",
        f"{stack(dimensions.DIMENSIONS['consistency'][0])} AS consistency_apr", "coalesce(accurate / nullif(2 * cell_rows, 0), 0) AS accuracy_apr",
        "(2 * CAST(named > 0 AS INT) + CAST(n_T2 > 0 AS INT)) / 3 AS timeliness_coverage", "(CAST(n_C1 > 0 AS INT) + CAST(n_C2 > 0 AS INT) + CAST(n_C3 > 0 AS INT) + CAST(n_C4 > 0 AS INT)) / 4 AS completeness_coverage",
        "CAST(n_V1 + n_V2 + n_V3 + n_V4 + n_V5 > 0 AS DOUBLE) AS validity_coverage", "CAST(n_CS1_1 + n_CS1_2 + n_CS1_2b + n_CS1_3 + n_CS2 + n_CS3_thp_dl + n_CS3_thp_ul + n_CS3_prb_dl + n_CS3_prb_ul > 0 AS DOUBLE) AS consistency_coverage",
        "(2 * CAST(cell_rows > 0 AS INT) + n_A1_dl + n_A1_ul) / (2 + n_A1_dl + n_A1_ul) AS accuracy_coverage",
    ]
    return f"{CHECKED}, scored AS (SELECT *, {', '.join(out)} FROM checked)"


SCORED = _score_sql()
MEASURES = ("mpr", "apr", "coverage")


@query(f"WITH {SCORED} SELECT window_number, " + ", ".join(f"round({d}_{m}, 6) AS {d}_{m}" for d in FIVE for m in MEASURES) + ", " + ", ".join(f"CAST({d}_{k}_fails AS BIGINT) AS {d}_{k}_fails" for d in FIVE for k in ("row", "aggregate")) + " FROM scored")
def report_scores(spark, sf):
    """The five dimensions of each window: MPR, APR, coverage and fails."""
    out = scored(spark, sf)
    return rounded(out.select("window_number", *[F.col(f"{d}_{m}").alias(f"{d}_{m}") for d in FIVE for m in MEASURES], *[f"{d}_{k}_fails" for d in FIVE for k in ("row", "aggregate")]))


LABELS = f"""{SCORED}, z AS (SELECT window_number, lo, least(greatest(({" + ".join(f"(round({c}_mpr, 9) - {m}) / {s} * ({w})" for c, m, s, w in zip(PARAMETERS.columns, PARAMETERS.means, PARAMETERS.stds, PARAMETERS.pc1, strict=True))}) / 1.9, -3), 3) AS z FROM scored),
labels AS (SELECT window_number, 'window_' || lpad(CAST(window_number AS VARCHAR), 6, '0') || '_' || strftime(make_timestamp(lo), '%Y%m%d_%H%M%S') AS window_id, round_even(1 - (z + 3) / 6, 2) AS label FROM z)"""


@query(f"WITH {LABELS} SELECT window_id, label FROM labels")
def report_labels(spark, sf):
    """The label of each window by a given consolidator."""
    out = scored(spark, sf).select("window_id", *[F.round(F.col(f"{d}_mpr"), 9).alias(d) for d in FIVE])
    return PARAMETERS.transform(out).select("window_id", "label")


def _reasons_sql() -> str:
    rows = []
    for d in FIVE:
        for name, names, limit in dimensions.SHARES.get(d, ()):
            n, p = (" + ".join(f'"{e}_{k}"' for k in names) for e in "np")
            rows.append(f"SELECT window_number, '{d}' AS dimension, '{name}' AS reason FROM scored WHERE {n} > 0 AND {p} < ({n}) * {limit}")
        rows += [f"SELECT window_number, '{d}', '{name}' FROM scored WHERE known AND ({condition})" for name, condition in dimensions.OWN.get(d, ())]
    return f"{SCORED}, found AS ({' UNION ALL '.join(rows)})"


@query(f"WITH {_reasons_sql()} SELECT dimension, reason, count(*) AS n FROM found GROUP BY ROLLUP (dimension, reason)")
def report_reasons(spark, sf):
    """How often each reason is found, by dimension and over all."""
    out = dimensions.reasons(scored(spark, sf))
    long = out.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"{d}_reasons").alias("reasons")) for d in FIVE])).alias("x")).select("x.*")
    return score.reason_counts(long, "dimension", "reasons")


@query(f"WITH {_reasons_sql()} SELECT reason, count(*) AS n FROM found GROUP BY reason ORDER BY n DESC, reason LIMIT 3")
def report_top_reasons(spark, sf):
    """The three commonest reasons."""
    out = scored(spark, sf)
    return score.top_reasons(out.select(F.concat(*[f"{d}_reasons" for d in FIVE]).alias("reasons")), "reasons", 3)


def _digits(column: str) -> int:
    """To how many digits a column is compared: few where its numbers are large."""
    return 1 if "energy_per_thp" in column or "resid" in column else 10


def _feature_sql() -> str:
    def stats(prefix: str, names: dict[str, str]) -> list[str]:
        made = (("mean", "avg({x})"), ("std", "stddev_pop({x})"), ("min", "min({x})"), ("max", "max({x})"), ("median", "quantile_cont({x}, 0.5)"), ("q25", "quantile_cont({x}, 0.25)"), ("q75", "quantile_cont({x}, 0.75)"))
        return [f'CAST({f.format(x=x)} AS DOUBLE) AS "{prefix}_{n}_{k}"' for n, x in names.items() for k, f in made]

    def cadence(p: str) -> list[str]:
        off = "NOT (g % 3600 <= 360) AND NOT ((3600 - g % 3600) % 3600 <= 360)"
        return [
            f"CAST(min(g) AS DOUBLE) AS {p}_dt_min, CAST(quantile_cont(g, 0.5) AS DOUBLE) AS {p}_dt_median, CAST(max(g) AS DOUBLE) AS {p}_dt_max, CASE WHEN count(g) > 0 THEN count(*) FILTER (WHERE {off}) END AS {p}_offgrid_count",
            f"CASE WHEN count(g) > 0 THEN CAST(sum(greatest(floor(g / 3600) - 1, 0)) AS BIGINT) END AS {p}_missing_intervals, CASE WHEN count(g) > 0 THEN count(*) / ((max(us) - min(us)) // 3600000000 + 1) END AS {p}_coverage_ratio",
        ]

    def ratio(p: str, name: str, x: str, labels: tuple[str, ...] = ("mean", "q25", "q75")) -> list[str]:
        made = {"mean": f"avg({x})", "q25": f"quantile_cont({x}, 0.25)", "q75": f"quantile_cont({x}, 0.75)"}
        return [f"{made[k]} AS {p}_{name}_{k}" for k in labels]

    def nulls(p: str, names: list[str]) -> str:
        return "(" + " + ".join(f"count(*) - count({n})" for n in names) + f") / ({len(names)} * count(*)) AS {p}_null_frac"

    q = lambda n: f'"{n}"'
    cell_names = {m: "step" if m == "PEE.Energy_interval" else q(m) for m in features.CELL_METRICS}
    rules = {f"prb_used_gt_avail_{s.lower()}": f'"RRU.PrbUsed{s}" > "RRU.PrbAvail{s}"' for s in ("Dl", "Ul")} | {"conn_mean_gt_max_cnt": '"RRC.ConnMean" > "RRC.ConnMax"'}
    rules |= {f"thp_pos_prb_zero_{s.lower()}": f'"DRB.UEThp{s}" > 0.001 AND "RRU.PrbUsed{s}" <= 0' for s in ("Dl", "Ul")}
    numbers = [q(n) for n in CELL_VALUES] + ["energy", "tdl", "tul", "step", '"PEE.AvgPower"']  # the expected energy is there whenever the power is
    cell = [
        "count(*) AS cell_rows, count(DISTINCT ent) AS unique_cells, count(*) FILTER (WHERE same > 1) AS cell_duplicate_rows", *cadence("cell"), nulls("cell", numbers), *[f"count(*) FILTER (WHERE {r}) AS viol_{n}" for n, r in rules.items()],
        *ratio("cell", "energy_per_thp_dl", 'step / nullif("DRB.UEThpDl" + 1e-9, 0)', ("mean", "q75")), "avg(abs(resid)) AS cell_energy_resid_abs_mean, quantile_cont(abs(resid), 0.75) AS cell_energy_resid_abs_q75", *stats("cell", cell_names),
    ]
    ue = [
        "count(*) AS ue_rows, count(DISTINCT ent) AS unique_ues, count(*) FILTER (WHERE same > 1) AS ue_duplicate_rows", *cadence("ue"), nulls("ue", [q(n) for n in UE_VALUES]),
        *[r for s in ("Dl", "Ul") for r in ratio("ue", f"thp_per_prb_{s.lower()}", f'"DRB.UEThp{s}" / nullif("RRU.PrbUsed{s}", 0)')], *stats("ue", {m: q(m) for m in features.UE_METRICS}),
    ]
    recon = [(m, s, f"{short}_{s.lower()}") for short, m in (("thp", "DRB.UEThp"), ("prb", "RRU.PrbUsed")) for s in ("Dl", "Ul")]
    sums = ", ".join(f'coalesce(sum("{m}{s}"), 0) AS {n}' for m, s, n in recon)
    medians = ", ".join(f"quantile_cont(CASE WHEN a.{n} > 0 THEN b.{n} / a.{n} END, 0.5) AS recon_{n}_median" for _, _, n in recon)
    zero = ("cell_rows", "ue_rows", "unique_cells", "unique_ues", "cell_duplicate_rows", "ue_duplicate_rows")
    wide = {c: f"coalesce({c}, 0)" for c in zero} | {
        "total_rows": "coalesce(cell_rows, 0) + coalesce(ue_rows, 0)", "meta_hour_of_day": "hour(make_timestamp(lo))", "meta_day_of_week": "isodow(make_timestamp(lo)) - 1", "meta_start_time": "CAST(make_timestamp(lo) AS VARCHAR)", "meta_end_time": f"CAST(make_timestamp(lo + {SIZE}000000) AS VARCHAR)",
        **{f"t2_{k}_slots": f"CAST({x} AS DOUBLE)" for k, x in (("expected", "n_t2"), ("aligned", "p_t2"), ("missing", "greatest(n_t2 - p_t2, 0)"))},
    }
    name = "'window_' || lpad(CAST(spine.window_number AS VARCHAR), 6, '0') || '_' || strftime(make_timestamp(lo), '%Y%m%d_%H%M%S')"
    wide |= {"meta_window_id": name, "window_id": name}
    whole = {"cell_rows", "ue_rows", "total_rows", "meta_hour_of_day", "meta_day_of_week"} | {c for c in features.feature_columns() if c.startswith(("viol_", "unique_")) or c.endswith(("_duplicate_rows", "_offgrid_count", "_missing_intervals"))}
    text = {"meta_window_id", "window_id", "meta_start_time", "meta_end_time"}

    def shown(c: str) -> str:
        x = wide.get(c, f'"{c}"')
        return f'{x} AS "{c}"' if c in text else f'CAST({x} AS BIGINT) AS "{c}"' if c in whole else f'round({x}, {_digits(c)}) AS "{c}"'

    w = "(PARTITION BY window_number ORDER BY us, ent NULLS FIRST, event_id)"
    return f"""{CHECKED},
fc AS (SELECT *, (us - lag(us) OVER {w}) / 1e6 AS g, count(*) OVER (PARTITION BY window_number, ent, us) AS same, energy - lag(energy) OVER {w} - lag("PEE.AvgPower") OVER {w} * ((us - lag(us) OVER {w}) / 1e6) AS resid FROM xc),
fu AS (SELECT *, (us - lag(us) OVER {w}) / 1e6 AS g, count(*) OVER (PARTITION BY window_number, ent, us) AS same FROM xu),
hc AS (SELECT window_number, {", ".join(cell)} FROM fc GROUP BY window_number), hu AS (SELECT window_number, {", ".join(ue)} FROM fu GROUP BY window_number),
sc AS (SELECT window_number, us, {sums} FROM xc GROUP BY ALL), su AS (SELECT window_number, us, {sums} FROM xu GROUP BY ALL),
hr AS (SELECT a.window_number, {medians} FROM sc AS a JOIN su AS b ON a.window_number = b.window_number AND a.us = b.us GROUP BY ALL)
SELECT {", ".join(shown(c) for c in features.feature_columns() if c != "label")}
FROM spine LEFT JOIN hc USING (window_number) LEFT JOIN hu USING (window_number) LEFT JOIN hr USING (window_number) LEFT JOIN grid USING (window_number)"""


@query(f"WITH {_feature_sql()}")
def report_features(spark, sf):
    """All feature columns of each window, in their locked order."""
    c, u = cells(spark, sf), ues(spark, sf)
    span = windows.span([(c, TS), (u, TS)])
    spine = windows.spine(c, *span, SIZE, STEP)
    out = features.feature_rows(windows.assign(c, TS, *span, SIZE, STEP), windows.assign(u, TS, *span, SIZE, STEP), spine, HOUR, "event_id")
    whole = {"meta_hour_of_day", "meta_day_of_week"}
    return out.select(*[F.col(f"`{n}`").cast("long").alias(n) if n in whole else F.round(f"`{n}`", _digits(n)).alias(n) if kind == "double" else F.col(f"`{n}`") for n, kind in out.dtypes])
