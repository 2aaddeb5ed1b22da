"""Query catalogue: each operator over the test tables, with the same query in SQL.

Every query runs over its whole tables. Doubles are rounded and times given in microseconds, so that
both engines give the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewright.functions import exprs as E
from gaugewright.operators import analysis, baselines, checks, convert, faults, features, score, train, windows
from gaugewright.operators import pca as pca_op
from gaugewright.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DAY, HOUR = 86_400, 3_600


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(E.col(n), digits).alias(n) if kind == "double" else E.col(n) for n, kind in df.dtypes])


def us(c: str) -> Column:
    return E.micros(F.col(c))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream table: entity user_id, time ts, rate value, resource k (from JSON), arrival event_id."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", E.number(F.get_json_object("props", "$.k")))


EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"


# scans, projections, casts


@query("SELECT event_id, epoch_us(ts) AS ts_us, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def scan_project_filter(spark, sf):
    at = table(spark, sf, "events")
    return at.where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"))).select("event_id", E.micros(F.col("ts")).alias("ts_us"), "user_id", "value")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS bad, CAST(try_cast(json_extract_string(props, '$.none') AS BIGINT) AS BIGINT) AS absent FROM events")
def cast_coerce(spark, sf):
    return events(spark, sf).select("event_id", "k", E.number(F.col("event_type")).alias("bad"), F.get_json_object("props", "$.none").try_cast("bigint").alias("absent"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_extract_metric(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("k").cast("bigint")).alias("k"))


@query("SELECT p_partkey, nullif(regexp_extract(p_brand, '#(\\d)\\d', 1), '') AS maker, nullif(regexp_extract(p_brand, '^x(\\d)$', 1), '') AS none FROM part")
def regex_extract_band(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", E.extract(F.col("p_brand"), r"#(\d)\d").alias("maker"), E.extract(F.col("p_brand"), r"^x(\d)$").alias("none"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 2) AS band, CASE WHEN len(string_split(o_orderpriority, '/')) = 3 THEN string_split(o_orderpriority, '/')[2] ELSE 'UNKNOWN' END AS part FROM orders")
def split_part_band(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("band"), E.band_of(F.col("o_orderpriority")).alias("part"))


# conversions


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice > 0 THEN l_discount * 100 / 100 * l_extendedprice END, 4) AS absolute FROM lineitem")
def pct_to_abs(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("pct", F.col("l_discount") * 100)
    return convert.percent_to_absolute(li, "pct", "l_extendedprice", "absolute").select("l_orderkey", "l_linenumber", r6("absolute", 4).alias("absolute"))


@query(f"""
WITH {EV}, run AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN 0 ELSE sum(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS total FROM ev),
d AS (SELECT *, total - lag(total) OVER w AS delta, greatest(coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 60) / 3600, 1e-9) AS h FROM run WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(coalesce(CASE WHEN delta >= 0 THEN delta END, value / 1000 * h), 6) AS step, coalesce(delta < 0, false) AS step_reset, (delta IS NULL OR delta < 0) AS step_imputed FROM d""")
def cumulative_to_interval(spark, sf):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = events(spark, sf).withColumn("total", F.when(F.col("event_id") % 50 == 0, 0.0).otherwise(F.sum("k").over(by)))
    return convert.cumulative_to_interval(run, "total", "user_id", "ts", 60, "value", "step", "event_id").select("event_id", r6("step").alias("step"), "step_reset", "step_imputed")


@query("SELECT n_nationkey, CAST(CASE n_name WHEN 'FRANCE' THEN 200 ELSE 180 END AS DOUBLE) AS khz, CAST(CASE n_name WHEN 'FRANCE' THEN 25 WHEN 'CHINA' THEN 28 ELSE 30 END AS DOUBLE) AS cap, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def broadcast_band_lookup(spark, sf):
    known = {"FRANCE": {"bandwidth_mhz": 20, "prb_count": 100, "cap": 25.0}, "CHINA": {"cap": 28.0}}
    n = convert.band_constants(table(spark, sf, "nation"), "n_name", known)
    return n.join(table(spark, sf, "region"), n["n_regionkey"] == F.col("r_regionkey"), "left").select("n_nationkey", F.col("khz").cast("double"), "cap", "r_name")


# timeliness


@query("SELECT event_id, abs((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 - 26000) <= 13000 AS ok FROM events")
def interarrival_check(spark, sf):
    ev = checks.with_previous(events(spark, sf), "user_id", "ts")
    return ev.select("event_id", checks.interarrival("ts", 26000, 13000).alias("ok"))


@query("SELECT event_id, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY (event_id * 7919) % 10007, event_id) AS ok FROM events")
def monotonic_check(spark, sf):
    ev = events(spark, sf).withColumn("arrived", F.struct((F.col("event_id") * 7919 % 10007).alias("a"), F.col("event_id").alias("b")))
    return checks.with_previous(ev, "user_id", "ts", "prev_arrived", "arrived").select("event_id", checks.monotonic("ts").alias("ok"))


@query("""
WITH t AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events),
e AS (SELECT user_id, min(us) - min(us) % 300000000 AS a, max(us) AS hi FROM t GROUP BY user_id),
s AS (SELECT user_id, us, a, CAST(floor((hi - a) / 300000000) AS BIGINT) + 1 AS n, CAST(round_even((us - a) / 300000000, 0) AS BIGINT) AS k FROM t JOIN e USING (user_id))
SELECT user_id, n AS expected_slots, count(DISTINCT k) FILTER (WHERE abs(us - (a + k * 300000000)) <= 30000000 AND k < n) AS aligned_slots,
       greatest(n - count(DISTINCT k) FILTER (WHERE abs(us - (a + k * 300000000)) <= 30000000 AND k < n), 0) AS missing_slots FROM s GROUP BY user_id, n""")
def grid_alignment(spark, sf):
    return checks.grid_alignment(events(spark, sf), ["user_id"], "ts", 300, 60)


# windows


def day_windows(spark: SparkSession, sf: str, size: int = DAY, step: int = 6 * HOUR) -> tuple[DataFrame, DataFrame]:
    """The event stream's windows: the spine, and the assigned rows."""
    ev = events(spark, sf)
    start, end = windows.span([(ev, "ts")])
    return windows.spine(ev, start, end, size, step), windows.assign(ev, "ts", start, end, size, step)


def spine_sql(size: int, step: int) -> str:
    return f"""ends AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events),
spine AS (SELECT i AS window_number, a + i * {step}000000 AS s, a + (i * {step} + {size}) * 1000000 AS e FROM ends, unnest(generate_series(0, CAST(floor((b - a - {size}000000) / {step}000000) AS BIGINT))) AS t(i))"""


DAYS = spine_sql(DAY, 6 * HOUR)


@query(f"""
WITH {EV}, {DAYS}
SELECT window_number, s AS window_start_us, count(event_id) AS n, count(DISTINCT user_id) AS users, round(avg(CAST(k IS NULL AS INT)), 9) AS null_fraction, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std,
       round(quantile_cont(value, 0.25), 9) AS q25, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.75), 9) AS q75, count(*) FILTER (WHERE value > k) AS violations,
       round((count(*) FILTER (WHERE user_id IS NOT NULL) + count(*) FILTER (WHERE value <= k)) / (count(*) + count(*) FILTER (WHERE value <= k OR value > k)), 9) AS mpr
FROM spine LEFT JOIN ev ON epoch_us(ts) >= s AND epoch_us(ts) < e GROUP BY window_number, s""")
def sliding_window_profile(spark, sf):
    spine, rows = day_windows(spark, sf)
    some = [checks.row("C1", "completeness", checks.mandatory(["user_id", "ts"])), checks.row("V3", "validity", F.col("value") <= F.col("k"))]
    v = F.col("value")
    made = rows.groupBy("window_number").agg(
        F.count("event_id").alias("n"), F.countDistinct("user_id").alias("users"), F.avg(F.col("k").isNull().cast("int")).alias("null_fraction"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        *[F.percentile(v, q).alias(n) for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))], F.count_if(v > F.col("k")).alias("violations"), *score.sums(some),
    )
    mpr = (F.col("passed_0") + F.col("passed_1")) / (F.col("total_0") + F.col("total_1"))
    out = spine.join(made, "window_number", "left").select("window_number", us("window_start").alias("window_start_us"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("users", F.lit(0)).alias("users"), "null_fraction", "mean", "std", "q25", "median", "q75", F.coalesce("violations", F.lit(0)).alias("violations"), mpr.alias("mpr"))
    return rounded(out, 9)


@query(f"""
WITH {DAYS}, m AS (SELECT window_number, count(event_id) AS rows, count(DISTINCT user_id) AS entities, count(DISTINCT ts) AS ticks FROM spine LEFT JOIN events ON epoch_us(ts) >= s AND epoch_us(ts) < e GROUP BY window_number)
SELECT *, round(ticks / 1440, 6) AS completeness, NOT (rows = 0 OR ticks < 288) AS valid, CASE WHEN rows = 0 THEN 'empty' WHEN ticks < 288 THEN 'incomplete' END AS reason FROM m""")
def window_metadata(spark, sf):
    spine, rows = day_windows(spark, sf)
    return windows.metadata(rows, spine, "ts", "user_id", 1440, 0.2).select("window_number", "rows", "entities", "ticks", r6("completeness").alias("completeness"), "valid", "reason")


@query(f"WITH {spine_sql(300, 300)} SELECT window_number, count(event_id) AS n FROM spine LEFT JOIN events ON epoch_us(ts) >= s AND epoch_us(ts) < e GROUP BY window_number")
def window_spine_empty(spark, sf):
    spine, rows = day_windows(spark, sf, 300, 300)
    return spine.join(rows.groupBy("window_number").agg(F.count(F.lit(1)).alias("n")), "window_number", "left").select("window_number", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""
WITH {DAYS}, m AS (SELECT window_number, s, e, count(DISTINCT ts) / 1440 AS c, count(event_id) AS r FROM spine LEFT JOIN events ON epoch_us(ts) >= s AND epoch_us(ts) < e GROUP BY ALL)
SELECT count(*) AS windows, min(s) AS first_us, max(e) AS last_us, round(avg(c), 6) AS mean_completeness, round(stddev_pop(c), 6) AS std_completeness, round(min(c), 6) AS min_completeness, round(max(c), 6) AS max_completeness,
       round(quantile_cont(c, 0.5), 6) AS median_completeness, round(avg(r), 6) AS mean_rows, round(stddev_pop(r), 6) AS std_rows, CAST(sum(r) AS BIGINT) AS total_rows FROM m""")
def window_statistics(spark, sf):
    spine, rows = day_windows(spark, sf)
    out = windows.statistics(windows.metadata(rows, spine, "ts", "user_id", 1440))
    return rounded(out.select("windows", us("first_start").alias("first_us"), us("last_end").alias("last_us"), *[c for c in out.columns if c not in ("windows", "first_start", "last_end")]))


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM o WHERE i % greatest(n // 50, 1) = 0 AND i < greatest(n // 50, 1) * 50")
def even_stride_sample(spark, sf):
    return windows.even_stride(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 50)


# features


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) > 1 AS d FROM lineitem) WHERE d GROUP BY ALL")
def duplicate_rows(spark, sf):
    return features.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"]).where("duplicate").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")


LD = "ld AS (SELECT doc_id, source, lang, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"WITH {LD} SELECT source, round((count(*) FILTER (WHERE quality IS NULL) + count(*) FILTER (WHERE toxic IS NULL) + count(*) FILTER (WHERE n_chars IS NULL)) / (3 * count(*)), 6) AS d_null_frac FROM ld GROUP BY source")
def null_density(spark, sf):
    return rounded(labelled_documents(spark, sf).groupBy("source").agg(features.null_fraction("d", ["quality", "toxic", "n_chars"])))


@query("""
WITH g AS (SELECT user_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events),
o AS (SELECT *, gap - floor(gap / 3600) * 3600 AS r FROM g)
SELECT user_id, round(min(gap), 7) AS e_dt_min, round(quantile_cont(gap, 0.5), 7) AS e_dt_median, round(max(gap), 7) AS e_dt_max,
       CASE WHEN count(gap) > 0 THEN count(*) FILTER (WHERE NOT r <= 360 AND NOT (3600 - r) - floor((3600 - r) / 3600) * 3600 <= 360) END AS e_offgrid_count,
       CASE WHEN count(gap) > 0 THEN CAST(sum(greatest(floor(gap / 3600) - 1, 0)) AS BIGINT) END AS e_missing_intervals,
       round(CASE WHEN count(gap) > 0 THEN count(ts) / (floor((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / 3600) + 1) END, 7) AS e_coverage_ratio FROM o GROUP BY user_id""")
def cadence_features(spark, sf):
    return rounded(features.with_gaps(events(spark, sf), ["user_id"], "ts", "event_id").groupBy("user_id").agg(*features.cadence("e", "ts", 3600)), 7)


@query("""
WITH t AS (SELECT DISTINCT event_type, epoch_us(ts) AS us FROM events),
e AS (SELECT event_type, min(us) - min(us) % 3600000000 AS a, max(us) AS hi FROM t GROUP BY event_type),
s AS (SELECT event_type, us, a, CAST(floor((hi - a) / 3600000000) AS BIGINT) + 1 AS n, CAST(round_even((us - a) / 3600000000, 0) AS BIGINT) AS k FROM t JOIN e USING (event_type)),
c AS (SELECT event_type, n, count(DISTINCT k) FILTER (WHERE abs(us - (a + k * 3600000000)) <= 360000000 AND k < n) AS c FROM s GROUP BY event_type, n)
SELECT event_type, n AS expected_slots, c AS aligned_slots, greatest(n - c, 0) AS missing_slots FROM c""")
def grid_coverage(spark, sf):
    return checks.grid_alignment(events(spark, sf), ["event_type"], "ts", HOUR, 360)


@query(f"WITH {EV}, r AS (SELECT event_type, value / nullif(k, 0) AS r FROM ev) SELECT event_type, round(avg(r), 6) AS e_per_k_mean, round(quantile_cont(r, 0.25), 6) AS e_per_k_q25, round(quantile_cont(r, 0.75), 6) AS e_per_k_q75 FROM r GROUP BY event_type")
def ratio_features(spark, sf):
    return rounded(events(spark, sf).groupBy("event_type").agg(*features.ratios("e", "per_k", "value", "k")))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 45) AS viol_big, count(*) FILTER (WHERE l_discount > 0.05 AND l_tax <= 0) AS viol_untaxed FROM lineitem GROUP BY l_returnflag")
def violation_counts(spark, sf):
    rules = {"big": F.col("l_quantity") > 45, "untaxed": (F.col("l_discount") > 0.05) & (F.col("l_tax") <= 0)}
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*features.violations(rules))


@query(f"""
WITH {EV}, {DAYS}, j AS (SELECT * FROM spine JOIN ev ON epoch_us(ts) >= s AND epoch_us(ts) < e),
d AS (SELECT *, count(*) OVER (PARTITION BY window_number, user_id, event_type) > 1 AS dup, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY window_number ORDER BY ts, event_id)) / 1e6 AS gap FROM j)
SELECT window_number, count(*) AS e_rows, count(DISTINCT user_id) AS unique_es, count(*) FILTER (WHERE dup) AS duplicate_rows, round(quantile_cont(gap, 0.5), 9) AS dt_median, round(count(*) FILTER (WHERE k IS NULL) / count(*), 9) AS e_null_frac,
       round(avg(value), 9) AS e_value_mean, round(stddev_pop(value), 9) AS e_value_std, min(value) AS e_value_min, max(value) AS e_value_max, round(quantile_cont(value, 0.5), 9) AS e_value_median, round(quantile_cont(value, 0.25), 9) AS e_value_q25, round(quantile_cont(value, 0.75), 9) AS e_value_q75
FROM d GROUP BY window_number""")
def feature_row(spark, sf):
    _, rows = day_windows(spark, sf)
    rows = features.with_gaps(features.duplicates(rows, ["window_number", "user_id", "event_type"]), ["window_number"], "ts", "event_id")
    out = rows.groupBy("window_number").agg(*features.counts("e", "user_id"), F.count_if("duplicate").alias("duplicate_rows"), F.percentile("gap", 0.5).alias("dt_median"), features.null_fraction("e", ["k"]), *features.summaries("e", ["value"]))
    return rounded(out, 9)


# reconciliation


def order_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two streams of amounts by day: orders, and their lines."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey"), F.col("o_orderpriority").alias("band"), F.to_date("o_orderdate").alias("tick"), F.col("o_totalprice").cast("double").alias("amount"))
    lines = table(spark, sf, "lineitem").join(orders.select("o_orderkey", "band", "tick"), F.col("l_orderkey") == F.col("o_orderkey")).select("band", "tick", F.col("l_extendedprice").cast("double").alias("amount"))
    return orders.select("band", "tick", "amount"), lines


RECON = """m AS (SELECT o_orderpriority AS band, CAST(o_orderdate AS DATE) AS tick, sum(o_totalprice) AS m FROM orders GROUP BY ALL HAVING sum(o_totalprice) > 0),
d AS (SELECT o_orderpriority AS band, CAST(o_orderdate AS DATE) AS tick, sum(l_extendedprice) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
ratio AS (SELECT band, tick, d / m AS ratio FROM m JOIN d USING (band, tick))"""


@query(f"WITH {RECON} SELECT round(quantile_cont(ratio, 0.25), 6) AS q25, round(quantile_cont(ratio, 0.5), 6) AS q50, round(quantile_cont(ratio, 0.75), 6) AS q75, count(ratio) AS n FROM ratio")
def recon_ratio_band(spark, sf):
    return rounded(baselines.ratio_band(checks.reconcile(*order_lines(spark, sf), ["band"], "tick", "amount")))


@query(f"""
WITH {RECON}, s AS (SELECT band, count(ratio) AS ticks, quantile_cont(ratio, 0.5) AS median, avg(CAST(ratio BETWEEN 0.5 AND 1.5 AS INT)) AS inside FROM ratio GROUP BY band)
SELECT band, ticks, round(median, 6) AS median, round(inside, 6) AS inside, CAST(ticks >= 5 AND (median BETWEEN -1.0 AND 3.0 OR inside >= 0.5) AS INT) AS passed, CAST(ticks >= 5 AS INT) AS total FROM s""")
def recon_outlier_pass(spark, sf):
    return rounded(checks.reconciled(checks.reconcile(*order_lines(spark, sf), ["band"], "tick", "amount"), ["band"], (0.5, 1.5)))


# baselines


@query(f"""
WITH {EV}, long AS (SELECT 'value' AS metric, value AS v FROM ev UNION ALL SELECT 'k', k FROM ev)
SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(mad(v), 6) AS mad, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
       round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95, min(v) AS min, max(v) AS max, count(v) AS count FROM long WHERE v IS NOT NULL GROUP BY metric""")
def stat_baseline(spark, sf):
    return rounded(baselines.statistics(events(spark, sf), ["value", "k"]))


@query("""
WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n FROM lineitem),
c AS (SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, count(*) AS c FROM lineitem, e GROUP BY 1)
SELECT b AS bin, round(lo + b * ((hi - lo) / 50), 6) AS low, round(coalesce(c, 0) / n, 6) AS density FROM e, unnest(generate_series(0, 49)) AS t(b) LEFT JOIN c ON bin = b""")
def histogram_pdf(spark, sf):
    return rounded(baselines.histogram(table(spark, sf, "lineitem"), "l_quantity"))


@query("""
WITH long AS (UNPIVOT (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME metric VALUE v)
SELECT metric, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.01), 6) AS p01, round(quantile_cont(v, 0.99), 6) AS p99, round(quantile_cont(v, 0.5), 6) AS median, count(v) AS count FROM long GROUP BY metric""")
def field_ranges(spark, sf):
    return rounded(baselines.field_ranges(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


@query("""
WITH t AS (SELECT date_trunc('hour', ts) AS h, count(DISTINCT user_id) AS n FROM events GROUP BY 1),
f AS (SELECT hour(h) AS hour, quantile_cont(n, 0.5) AS m, quantile_cont(n, 0.75) - quantile_cont(n, 0.25) AS i FROM t GROUP BY 1)
SELECT CAST(x AS INT) AS hour, round(coalesce(m, 52), 6) AS median, round(coalesce(i, 5), 6) AS iqr FROM unnest(generate_series(0, 23)) AS s(x) LEFT JOIN f ON hour = x""")
def hod_templates(spark, sf):
    by_hour = events(spark, sf).withColumn("tick", F.date_trunc("hour", "ts"))
    return rounded(baselines.hourly_template(by_hour, "tick", "user_id", 52, 5))


@query("WITH z AS (SELECT l_suppkey, count(*) FILTER (WHERE l_discount = 0) / count(*) AS r FROM lineitem GROUP BY 1 HAVING count(l_discount) > 0) SELECT round(quantile_cont(r, 0.25), 6) AS q25, round(quantile_cont(r, 0.5), 6) AS q50, round(quantile_cont(r, 0.75), 6) AS q75, count(r) AS n FROM z")
def zero_rate_band(spark, sf):
    return rounded(baselines.zero_rate_band(table(spark, sf, "lineitem"), "l_discount", "l_suppkey"))


@query("WITH c AS (SELECT l_suppkey, CASE WHEN count(*) >= 30 THEN corr(l_quantity, l_extendedprice) END AS r FROM lineitem GROUP BY 1) SELECT round(quantile_cont(r, 0.25), 6) AS q25, round(quantile_cont(r, 0.5), 6) AS q50, round(quantile_cont(r, 0.75), 6) AS q75, count(r) AS n FROM c")
def corr_band(spark, sf):
    return rounded(baselines.correlation_band(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_suppkey"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem")
def correlation(spark, sf):
    return rounded(baselines.correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query("WITH t AS (SELECT DISTINCT epoch_us(ts) AS us FROM events), g AS (SELECT (us - lag(us) OVER (ORDER BY us)) / 1e6 AS gap FROM t) SELECT round(quantile_cont(gap, 0.5), 7) AS cadence, round(min(gap) FILTER (WHERE gap > 0), 7) AS resolution FROM g")
def cadence_detect(spark, sf):
    ev = events(spark, sf)
    split = F.col("event_type") == "click"
    return rounded(baselines.cadence([(ev.where(split), "ts"), (ev.where(~split), "ts")]), 7)


@query("""
WITH d AS (SELECT 'value' AS metric, length(split_part(CAST(value AS VARCHAR), '.', 2)) AS d FROM events UNION ALL SELECT 'user_id', length(split_part(CAST(user_id AS VARCHAR), '.', 2)) FROM events),
c AS (SELECT metric, d, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY ALL)
SELECT metric, CAST(d AS INT) AS decimals FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY n DESC, d) AS i FROM c) WHERE i = 1""")
def decimals_mode(spark, sf):
    return baselines.printed_decimals(events(spark, sf), ["value", "user_id"])


@query("WITH r AS (SELECT l_quantity - 48.5 AS r FROM lineitem) SELECT CAST(CASE WHEN count(r) >= 30 THEN least(greatest(ceil(coalesce(quantile_cont(r, 0.95) FILTER (WHERE r > 0), 0)), 0), 3) ELSE 0 END AS BIGINT) AS slack, count(r) AS n FROM r")
def rule_slack(spark, sf):
    return baselines.learned_slack(F.col("l_quantity").cast("double") - 48.5, table(spark, sf, "lineitem"))


@query("SELECT l_returnflag AS band, round(CASE WHEN count(*) >= 30 THEN quantile_cont(CAST(l_extendedprice AS DOUBLE) / nullif(CAST(l_quantity AS DOUBLE), 0), 0.99) END, 4) AS p, count(*) AS n FROM lineitem WHERE l_quantity <> 0 GROUP BY GROUPING SETS ((l_returnflag), ())")
def band_percentile_rollup(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(baselines.percentile_by_band(li, E.ratio(F.col("l_extendedprice"), F.col("l_quantity")), "l_returnflag"), 4)


@query("WITH h AS (SELECT hour(ts) AS hour, avg(value) AS m FROM events GROUP BY 1) SELECT CAST(hour AS INT) AS hour, round(m, 6) AS mean_load, m >= (SELECT quantile_cont(m, 0.7) FROM h) AS peak FROM h")
def peak_hours(spark, sf):
    return rounded(baselines.peak_hours(events(spark, sf), "ts", "value"))


@query("""
WITH g AS (SELECT (us - lag(us) OVER (ORDER BY us)) / 1e6 AS gap FROM (SELECT DISTINCT epoch_us(ts) AS us FROM events))
SELECT count(*) AS rows, count(DISTINCT user_id) AS entities, count(DISTINCT ts) AS times, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 3600, 6) AS hours, (SELECT coalesce(bool_and(abs(gap - 60) < 5), true) FROM g WHERE gap IS NOT NULL) AS regular FROM events""")
def dataset_summary(spark, sf):
    out = baselines.dataset_summary(events(spark, sf), "user_id", "ts", 60)
    return rounded(out.select("rows", "entities", "times", us("first").alias("first_us"), us("last").alias("last_us"), "hours", "regular"))


@query(f"""
WITH {EV}, d AS (SELECT k / nullif(value / 1000 * ((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 / 3600), 0) AS r FROM ev)
SELECT round(quantile_cont(r, 0.25), 4) AS q25, round(quantile_cont(r, 0.5), 4) AS q50, round(quantile_cont(r, 0.75), 4) AS q75, count(r) AS n FROM d""")
def energy_band(spark, sf):
    return rounded(baselines.energy_power_band(events(spark, sf), "k", "value", "user_id", "ts"), 4)


# completeness, validity, consistency, accuracy


def passes(df: DataFrame, keys: list[str], *some: checks.Check) -> DataFrame:
    """passed and total of each check by group, and the mean pass rate."""
    sums = df.groupBy(*keys).agg(*score.sums(some))
    total = sum((F.col(f"total_{i}") for i in range(len(some))), F.lit(0.0))
    rate = F.when(total > 0, sum((F.col(f"passed_{i}") for i in range(len(some))), F.lit(0.0)) / total).otherwise(0.0)
    return sums.select(*keys, *[F.col(f"{what}_{i}").cast("bigint").alias(f"{what}_{i}") for i in range(len(some)) for what in ("passed", "total")], r6(rate).alias("mpr"))


def passes_sql(frm: str, keys: str, *ok: str) -> str:
    """The same over tri-state boolean expressions."""
    p = [f"count(*) FILTER (WHERE {c})" for c in ok]
    n = [f"count({c})" for c in ok]
    cols = ", ".join(f"{a} AS passed_{i}, {b} AS total_{i}" for i, (a, b) in enumerate(zip(p, n, strict=True)))
    return f"SELECT {keys}, {cols}, round(CASE WHEN {' + '.join(n)} > 0 THEN ({' + '.join(p)}) / ({' + '.join(n)}) ELSE 0 END, 6) AS mpr FROM {frm} GROUP BY {keys}"


@query(f"WITH {LD} " + passes_sql("ld", "source", "(quality IS NOT NULL AND toxic IS NOT NULL)"))
def mandatory_fields_mpr(spark, sf):
    return passes(labelled_documents(spark, sf), ["source"], checks.row("C1", "completeness", checks.mandatory(["quality", "toxic"])))


@query("""
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS tick, count(DISTINCT user_id) AS n FROM events GROUP BY ALL), m AS (SELECT event_type, avg(n) AS mean FROM h GROUP BY 1),
f AS (SELECT event_type, hour(arg_min(ts, event_id)) AS hour FROM events GROUP BY 1)
SELECT event_type, round(mean, 6) AS mean_entities, CAST(floor(least(mean, CASE WHEN hour < 12 THEN 2 ELSE 5 END)) AS BIGINT) AS passed, CAST(CASE WHEN hour < 12 THEN 2 ELSE 5 END AS BIGINT) AS total FROM m JOIN f USING (event_type)""")
def entity_presence(spark, sf):
    ev = events(spark, sf)
    hourly = ev.withColumn("tick", F.date_trunc("hour", "ts"))
    return rounded(checks.entity_presence(hourly, ["event_type"], "tick", "user_id", {h: 2.0 for h in range(12)}, 5.9, "event_id"))


@query("""
SELECT event_type, count(DISTINCT ts) AS passed_0, CAST(CASE WHEN max(ts) = min(ts) THEN greatest(count(DISTINCT ts), 1) ELSE greatest(round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 600, 0) + 1, 1) END AS BIGINT) AS total_0,
       round(count(DISTINCT ts) / CASE WHEN max(ts) = min(ts) THEN greatest(count(DISTINCT ts), 1) ELSE greatest(round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 600, 0) + 1, 1) END, 6) AS mpr FROM events GROUP BY event_type""")
def time_continuity(spark, sf):
    return passes(events(spark, sf), ["event_type"], checks.time_continuity("ts", 600))


@query(f"WITH {LD} SELECT source, count(quality) + count(toxic) + count(lang) AS passed_0, 3 * count(*) AS total_0, round((count(quality) + count(toxic) + count(lang)) / (3 * count(*)), 6) AS mpr FROM ld GROUP BY source")
def field_completeness(spark, sf):
    return passes(labelled_documents(spark, sf), ["source"], checks.field_completeness(["quality", "toxic", "lang"]))


@query(f"WITH {EV}, p AS (SELECT user_id, json_extract_string(props, '$.k') AS raw, event_type FROM ev) " + passes_sql("p", "user_id", "CASE WHEN raw IS NOT NULL THEN try_cast(raw AS DOUBLE) IS NOT NULL END", "CASE WHEN event_type IS NOT NULL THEN try_cast(event_type AS DOUBLE) IS NOT NULL END"))
def types_parsability(spark, sf):
    ev = events(spark, sf).withColumn("raw", F.get_json_object("props", "$.k"))
    return passes(ev, ["user_id"], checks.row("V1", "validity", checks.parsable(["raw"])), checks.row("V1", "validity", checks.parsable(["event_type"])))


@query(passes_sql("lineitem", "l_linestatus", "(l_quantity BETWEEN 2 AND 49 AND l_discount <= 0.09)"))
def range_check(spark, sf):
    return passes(table(spark, sf, "lineitem"), ["l_linestatus"], checks.row("V2", "validity", checks.ranges({"l_quantity": (2, 49), "l_discount": (None, 0.09)})))


@query(f"WITH {EV} " + passes_sql("ev", "event_type", "CASE WHEN value IS NOT NULL OR k IS NOT NULL THEN coalesce(value >= 0, true) AND coalesce(k >= 0, true) AND coalesce(value <= k * 1.000001, true) END"))
def row_all_constraints(spark, sf):
    return passes(events(spark, sf), ["event_type"], checks.row("V3", "validity", checks.used_within_available([("value", "k")])))


@query(f"""WITH {EV}, s AS (SELECT *, value / 2 AS u, k * 1.01 AS a, greatest(least(greatest(ceil(0.5 * 0.1 / 100 * (k * 1.01)), 1.0), 3.0), 2.0) AS slack FROM ev) """ + passes_sql("s", "event_type", "(value <= (a + slack) * 1.000001 AND u <= (value + slack) * 1.000001 AND coalesce(CASE WHEN a = 0 THEN u = 0 END, true))"))
def business_rules_slack(spark, sf):
    ev = events(spark, sf).withColumn("u", F.col("value") / 2).withColumn("a", F.col("k") * 1.01)
    return passes(ev, ["event_type"], checks.row("V4", "validity", checks.business_rules("u", "value", "a", None, checks.rule_slack(F.col("a"), 1, 2.0))))


@query(passes_sql("(SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) * CAST(l_discount AS DOUBLE) AS t, round(CAST(l_discount AS DOUBLE) * 100 + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END, 4) AS p FROM lineitem)", "l_returnflag", "CASE WHEN a > 0 THEN abs(least(greatest(t / a * 100, 0), 100) - least(greatest(p, 0), 100)) <= 0.5 * 0.1 + 1e-9 END"))
def percent_identity(spark, sf):
    a, d = F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double")
    li = table(spark, sf, "lineitem").select("l_returnflag", a.alias("a"), (a * d).alias("t"), F.round(d * 100 + F.when(F.col("l_linenumber") == 3, 1).otherwise(0), 4).alias("p"))
    return passes(li, ["l_returnflag"], checks.row("V5", "validity", checks.percent_identity("t", "a", "p", 1)))


@query(f"WITH {EV} " + passes_sql("ev", "event_type", "coalesce(value <= k, false)", "CASE WHEN k < 50 THEN NULL ELSE value > 1 END", "CASE WHEN value > 10 THEN k > 0 END", "(value <= 0.002 OR k > 0)"))
def implication_rules(spark, sf):
    some = [checks.row("CS1", "c", checks.mean_within_max("value", "k")), checks.row("i", "c", E.implies(F.col("k") >= 50, F.col("value") > 1)), checks.row("CS1_3", "c", checks.traffic_needs_resources([("value", "k")], 10)), checks.row("A3", "a", checks.rate_needs_resource("value", "k"))]
    return passes(events(spark, sf), ["event_type"], *some)


@query(f"WITH {EV} SELECT user_id, CAST((coalesce(sum(value) / nullif(sum(k), 0), 0) BETWEEN 0.5 AND 2) OR (sum(value) / nullif(sum(k), 0) BETWEEN 0.3 AND 0.6) AS BIGINT) AS passed_0, CAST(sum(k) <> 0 AS BIGINT) AS total_0, CAST(round(CASE WHEN sum(k) <> 0 THEN CAST((sum(value) / sum(k) BETWEEN 0.5 AND 2) OR (sum(value) / sum(k) BETWEEN 0.3 AND 0.6) AS INT) ELSE 0 END, 6) AS DOUBLE) AS mpr FROM ev GROUP BY user_id")
def sum_ratio_identity(spark, sf):
    return passes(events(spark, sf), ["user_id"], checks.sum_ratio(F.col("value"), F.col("k"), (0.3, 0.6)))


@query(f"WITH {EV}, x AS (SELECT user_id, CASE WHEN k > 0 THEN value * 1000 / k END AS x FROM ev), m AS (SELECT user_id, count(x) AS n, quantile_cont(x, 0.5) AS q FROM x GROUP BY 1) SELECT user_id, CAST(n >= 10 AND q BETWEEN 300 AND 700 AS BIGINT) AS passed_0, CAST(n >= 10 AS BIGINT) AS total_0, CAST(n >= 10 AND q BETWEEN 300 AND 700 AS DOUBLE) AS mpr FROM m")
def efficiency_band(spark, sf):
    return passes(events(spark, sf), ["user_id"], checks.efficiency_band("value", "k", (300, 700)))


@query(f"WITH {EV} " + passes_sql("ev", "event_type", "(value * 1000 / nullif(k, 0) <= 900)"))
def cap_check(spark, sf):
    return passes(events(spark, sf), ["event_type"], checks.row("A2", "accuracy", checks.cap("value", "k", 900, 1000, 1)))


# scores and labels


FIVE = ("timeliness", "completeness", "validity", "consistency", "accuracy")


def five_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """All five dimensions of the event stream's day windows, in one aggregation."""
    ev = checks.with_previous(events(spark, sf), "user_id", "ts")
    start, end = windows.span([(ev, "ts")])
    rows = windows.assign(ev, "ts", start, end, DAY, 6 * HOUR)
    some = [
        checks.Dimension("timeliness", [checks.row("T1", "timeliness", checks.interarrival("ts", 26000, 13000, window_start="window_start"))]),
        checks.Dimension("completeness", [checks.row("C1", "completeness", checks.mandatory(["user_id", "k"])), checks.field_completeness(["value", "k"])]),
        checks.Dimension("validity", [checks.row("V2", "validity", checks.ranges({"value": (1, 90), "k": (0, 95)})), checks.row("V3", "validity", checks.used_within_available([("value", "k")]))], True),
        checks.Dimension("consistency", [checks.row("CS1", "consistency", checks.traffic_needs_resources([("value", "k")], 5)), checks.sum_ratio(F.col("value"), F.col("k"), (0.9, 1.1))], True),
        checks.Dimension("accuracy", [checks.row("A2", "accuracy", checks.cap("value", "k", 900, 1000, 1)), checks.efficiency_band("value", "k", (300, 700))]),
    ]
    return score.scores(rows, ["window_number"], some)


FIVE_SQL = f"""{EV}, {DAYS},
p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM ev),
c AS (SELECT window_number, value, k, CASE WHEN epoch_us(prev) >= s THEN abs((epoch_us(ts) - epoch_us(prev)) / 1e6 - 26000) <= 13000 END AS t1, (user_id IS NOT NULL AND k IS NOT NULL) AS c1,
      CASE WHEN value IS NOT NULL OR k IS NOT NULL THEN coalesce(value BETWEEN 1 AND 90, true) AND coalesce(k BETWEEN 0 AND 95, true) END AS v2, CASE WHEN value IS NOT NULL OR k IS NOT NULL THEN coalesce(value >= 0, true) AND coalesce(k >= 0, true) AND coalesce(value <= k * 1.000001, true) END AS v3,
      CASE WHEN coalesce(value > 5, false) THEN coalesce(k > 0, false) END AS cs, value * 1000 / nullif(k, 0) <= 900 AS a2, CASE WHEN k > 0 THEN value * 1000 / k END AS x FROM p JOIN spine ON epoch_us(ts) >= s AND epoch_us(ts) < e),
g AS (SELECT window_number, count(*) FILTER (WHERE t1) AS t1p, count(t1) AS t1n, count(*) FILTER (WHERE c1) AS c1p, count(c1) AS c1n, count(value) + count(k) AS c4p, 2 * count(*) AS c4n, count(*) FILTER (WHERE v2) + count(*) FILTER (WHERE v3) AS vp, count(v2) + count(v3) AS vn,
      count(*) FILTER (WHERE cs) AS csp, count(cs) AS csn, CAST(coalesce(sum(value) / nullif(sum(k), 0) BETWEEN 0.5 AND 2, false) OR coalesce(sum(value) / nullif(sum(k), 0) BETWEEN 0.9 AND 1.1, false) AS INT) AS rp, CAST(nullif(sum(k), 0) IS NOT NULL AS INT) AS rn,
      count(*) FILTER (WHERE a2) AS ap, count(a2) AS an, CAST(count(x) >= 10 AND quantile_cont(x, 0.5) BETWEEN 300 AND 700 AS INT) AS ep, CAST(count(x) >= 10 AS INT) AS en,
      avg(CAST(coalesce(t1, true) AS INT)) AS ta, avg(CAST(coalesce(c1, true) AS INT)) AS ca, avg(CAST(coalesce(v2, true) AND coalesce(v3, true) AS INT)) AS va, avg(CAST(coalesce(cs, true) AS INT)) AS sa, avg(CAST(coalesce(a2, true) AS INT)) AS aa FROM c GROUP BY window_number),
five AS (SELECT window_number, CASE WHEN t1n > 0 THEN t1p / t1n ELSE 0 END AS timeliness, (c1p + c4p) / (c1n + c4n) AS completeness, vp / vn AS validity, (csp + rp) / (csn + rn) AS consistency, (ap + ep) / (an + en) AS accuracy, ta, ca, va, sa, aa,
         t1n - t1p AS tf, c1n - c1p + c4n - c4p AS cf, vn - vp AS vf, csn - csp + rn - rp AS sf, an - ap + en - ep AS af FROM g)"""


@query(f"WITH {FIVE_SQL} SELECT window_number, " + ", ".join(f"round({d}, 6) AS {d}_mpr, round({a}, 6) AS {d}_apr, CAST({f} AS BIGINT) AS {d}_total_fails" for d, a, f in zip(FIVE, ("ta", "ca", "va", "sa", "aa"), ("tf", "cf", "vf", "sf", "af"), strict=True)) + " FROM five")
def mpr_apr_reducer(spark, sf):
    scored = five_dimensions(spark, sf)
    return rounded(scored.select("window_number", *[f"{d}_{m}" for d in FIVE for m in ("mpr", "apr", "total_fails")]))


PARAMETERS = pca_op.Consolidator(FIVE, (0.4, 0.9, 0.8, 0.9, 0.8), (0.1, 0.05, 0.1, 0.05, 0.1), (-0.31, -0.46, -0.48, -0.5, -0.46), 0.0, 1.9, 0.73)


@query(f"WITH {FIVE_SQL}, z AS (SELECT window_number, least(greatest(({' + '.join(f'(round({c}, 9) - {m}) / {s} * ({w})' for c, m, s, w in zip(PARAMETERS.columns, PARAMETERS.means, PARAMETERS.stds, PARAMETERS.pc1, strict=True))}) / 1.9, -3), 3) AS z FROM five) SELECT window_number, round_even(1 - (z + 3) / 6, 2) AS label FROM z")
def pca_label_transform(spark, sf):
    scored = five_dimensions(spark, sf).select("window_number", *[F.round(F.col(f"{d}_mpr"), 9).alias(d) for d in FIVE])
    return PARAMETERS.transform(scored).select("window_number", "label")


@query()
def pca_fit_label(spark, sf):
    scored = five_dimensions(spark, sf).select("window_number", *[F.col(f"{d}_mpr").alias(d) for d in FIVE])
    return pca_op.fit(scored, FIVE).transform(scored).select("window_number", "label")


@query()
def ablation_runs(spark, sf):
    return rounded(analysis.ablation(five_dimensions(spark, sf).select("window_number", *[F.col(f"{d}_mpr").alias(d) for d in FIVE]), FIVE))


@query(f"WITH {FIVE_SQL} (SELECT window_number, round(validity, 6) AS validity, 'best' AS which FROM five ORDER BY validity DESC, window_number LIMIT 3) UNION ALL (SELECT window_number, round(validity, 6), 'worst' FROM five ORDER BY validity, window_number LIMIT 3)")
def topk_windows(spark, sf):
    v = five_dimensions(spark, sf).select("window_number", F.col("validity_mpr").alias("validity"))
    best = v.orderBy(F.desc("validity"), "window_number").limit(3).withColumn("which", F.lit("best"))
    return rounded(best.unionByName(v.orderBy("validity", "window_number").limit(3).withColumn("which", F.lit("worst"))))


@query(f"WITH {FIVE_SQL} SELECT count(*) AS count, round(avg(validity), 6) AS mean, round(stddev_pop(validity), 6) AS std, round(min(validity), 6) AS min, round(max(validity), 6) AS max, round(arg_max(validity, window_number), 6) AS last FROM five")
def score_history(spark, sf):
    return rounded(score.history(five_dimensions(spark, sf), "validity_mpr", "window_number"))


# splits, metrics


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM n")
def time_split(spark, sf):
    return train.time_split(table(spark, sf, "orders"), ["o_orderdate"], tiebreak="o_orderkey").select("o_orderkey", "part")


@query("""
WITH d AS (SELECT doc_id, n_chars, CAST(quality AS DOUBLE) AS quality FROM documents LEFT JOIN labels USING (doc_id)), f AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n, coalesce(quality, (SELECT quantile_cont(quality, 0.5) FROM d)) AS q FROM d),
m AS (SELECT avg(n) AS mn, stddev_pop(n) AS sn, avg(q) AS mq, stddev_pop(q) AS sq FROM f)
SELECT doc_id, round((n - mn) / CASE WHEN sn > 0 THEN sn ELSE 1 END, 6) AS z_n_chars, round((q - mq) / CASE WHEN sq > 0 THEN sq ELSE 1 END, 6) AS z_quality FROM f, m""")
def median_impute_scale(spark, sf):
    return rounded(train.impute_and_scale(labelled_documents(spark, sf), ["n_chars", "quality"]).select("doc_id", "z_n_chars", "z_quality"))


@query("""
WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND n_chars > 500) AS tp, count(*) FILTER (WHERE quality = 0 AND n_chars > 500) AS fp, count(*) FILTER (WHERE quality = 1 AND n_chars <= 500) AS fn, count(*) FILTER (WHERE quality = 0 AND n_chars <= 500) AS tn FROM documents JOIN labels USING (doc_id))
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS fpr, round(fn / (fn + tp), 6) AS fnr FROM c""")
def confusion_metrics(spark, sf):
    d = labelled_documents(spark, sf).where(F.col("quality").isNotNull())
    return rounded(d.agg(*analysis.confusion(F.col("quality") == 1, F.col("n_chars") > 500)))


@query("""
WITH o AS (SELECT CAST(o_totalprice AS DOUBLE) AS y, avg(CAST(o_totalprice AS DOUBLE)) OVER () * 0.9 AS g FROM orders)
SELECT round(avg(abs(g - y)), 2) AS mae, round(sqrt(avg((g - y) * (g - y))), 2) AS rmse, round(1 - sum((g - y) * (g - y)) / (var_pop(y) * count(*)), 6) AS r2 FROM o""")
def regression_metrics(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_totalprice").cast("double").alias("y"))
    guess = o.agg((F.avg("y") * 0.9).alias("g"))
    out = o.crossJoin(F.broadcast(guess)).agg(*train.regression_metrics(F.col("y"), F.col("g")))  # a single row
    return out.select(r6("mae", 2).alias("mae"), r6("rmse", 2).alias("rmse"), r6("r2").alias("r2"))


@query("WITH m AS (SELECT avg(CAST(o_totalprice AS DOUBLE)) AS a, quantile_cont(CAST(o_totalprice AS DOUBLE), 0.5) AS q FROM orders) SELECT round(avg(abs(o_totalprice - a)), 2) AS mean_mae, round(avg(abs(o_totalprice - q)), 2) AS median_mae FROM orders, m")
def naive_baselines(spark, sf):
    return rounded(analysis.naive_baselines(table(spark, sf, "orders").select(F.col("o_totalprice").cast("double").alias("y")), "y"), 2)


@query("WITH m AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS norm FROM part, m")
def minmax_normalise(spark, sf):
    return analysis.min_max(table(spark, sf, "part"), ["p_retailprice"]).select("p_partkey", r6(F.col("norm_p_retailprice").cast("double")).alias("norm"))


@query()
def bootstrap_mae(spark, sf):
    d = labelled_documents(spark, sf).where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("y"), F.lit(0.8).alias("g"))
    return rounded(analysis.bootstrap_mae(d, "y", "g", 1000))


@query("""
WITH b AS (SELECT range AS bin FROM range(1, 51)), p AS (SELECT l_quantity AS bin, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), q AS (SELECT l_quantity AS bin, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
j AS (SELECT bin, coalesce(p.n, 0) / (SELECT sum(n) FROM p) AS p, coalesce(q.n, 0) / (SELECT sum(n) FROM q) AS q FROM b LEFT JOIN p USING (bin) LEFT JOIN q USING (bin))
SELECT round(0.5 * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END), 6) AS jsd, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) > 0.08 AS drifted FROM j""")
def jsd(spark, sf):
    li = table(spark, sf, "lineitem")
    p, q = (baselines.histogram(li.where(F.col("l_returnflag") == f), "l_quantity", discrete=True).select(F.col("low").alias("bin"), "density") for f in ("A", "R"))
    return rounded(analysis.drift(p, q))


# sets


@query("SELECT DISTINCT epoch_us(ts) AS ts_us FROM (SELECT ts FROM events WHERE event_type = 'click' UNION SELECT ts FROM events WHERE event_type = 'view')")
def union_distinct_ts(spark, sf):
    ev = events(spark, sf).select(us("ts").alias("ts_us"), "event_type", "user_id")
    return ev.where(F.col("event_type") == "click").select("ts_us").union(ev.where(F.col("event_type") == "view").select("ts_us")).distinct()


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").select("o_custkey"))


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").intersect(table(spark, sf, "orders").select("o_custkey"))


# faults


@query("""
WITH f AS (SELECT *, event_id % 7 = 3 AS hit, CASE WHEN event_id % 3 = 0 THEN 'missing' WHEN event_id % 3 = 1 THEN 'out_of_range' ELSE 'inconsistent' END AS kind FROM events)
SELECT event_id, round(CASE WHEN hit AND kind = 'missing' THEN NULL WHEN hit AND kind = 'out_of_range' THEN value * 8 WHEN hit AND kind = 'inconsistent' THEN 0 ELSE value END, 6) AS value, CASE WHEN hit AND kind = 'missing' THEN NULL ELSE user_id END AS user_id FROM f""")
def fault_injection_hash(spark, sf):
    kind = F.when(F.col("event_id") % 3 == 0, "missing").when(F.col("event_id") % 3 == 1, "out_of_range").otherwise("inconsistent")
    rules = {"value": {"missing": F.lit(None), "out_of_range": F.col("value") * 8, "inconsistent": F.lit(0.0)}, "user_id": {"missing": F.lit(None)}}
    return rounded(faults.updates(events(spark, sf), kind, F.col("event_id") % 7 == 3, rules).select("event_id", "value", "user_id"))


@query()
def fault_windows(spark, sf):
    ev = events(spark, sf)
    start, end = windows.span([(ev, "ts")])
    spine = windows.spine(ev, start, end, DAY, DAY, partial_tail=True)
    return faults.inject(ev, "ts", ["event_id"], spine, start, DAY, DAY)[1].select("window_id", "n", F.concat_ws(",", "fault_types").alias("fault_types"))


# messages and streams


@query("""
WITH m AS (SELECT conv_id, turn, length(text) AS n, role FROM conversations)
SELECT conv_id, CAST(max(n) FILTER (WHERE role = 'user') AS DOUBLE) AS longest_user, CAST(max(n) FILTER (WHERE role = 'assistant') AS DOUBLE) AS longest_assistant, count(*) AS n FROM m GROUP BY conv_id""")
def payload_explode(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", F.struct("turn", "role", F.length("text").alias("n")).alias("t")).groupBy("conv_id").agg(F.to_json(F.collect_list("t")).alias("payload"))
    rows = turns.select("conv_id", F.explode(F.from_json("payload", "array<struct<turn:bigint,role:string,n:bigint>>")).alias("t"))
    longest = lambda role: F.max(F.when(F.col("t.role") == role, F.col("t.n"))).cast("double").alias(f"longest_{role}")
    return rows.groupBy("conv_id").agg(longest("user"), longest("assistant"), F.count(F.lit(1)).alias("n"))


@query("""
WITH e AS (SELECT event_id, epoch_us(ts) AS us, value, user_id FROM events), w AS (SELECT *, us - us % 3600000000 - j * 3600000000 AS s FROM e, unnest(generate_series(0, 5)) AS t(j))
SELECT s AS window_start_us, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM w GROUP BY s""")
def stream_sliding_equals_batch(spark, sf):
    """The batch side of the sliding windows by ingest time; tests run the same aggregation as a stream."""
    from gaugewright.streaming import stream

    ev = events(spark, sf)
    out = stream.window_aggregate(ev, "ts", [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), stream.distinct_count(F.col("user_id")).cast("bigint").alias("users")], size="6 hours", step="1 hour")
    return out.select(us("window_start").alias("window_start_us"), "n", r6("total", 4).alias("total"), "users")


def message_text(kind: str, ts: Column, info: str, body: list) -> Column:
    """The text of a report message: {metadata, indicationMessage-<kind>: {measInfoList, ...}}."""
    return F.concat(F.lit('{"metadata":{"event_ts_ms":'), F.unix_millis(ts).cast("string"), F.lit('},"indicationMessage-' + kind + '":{"measInfoList":' + info + ","), *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in body], F.lit("}}"))


def framed(number: Column, body: Column) -> Column:
    """In four framings by turns: bare, with a length in front, with noise behind, one document a line."""
    text = body.cast("binary")
    turns = [text, F.concat(F.unhex(F.lit("00000102")), text), F.concat(body, F.lit(" \n~~")).cast("binary")]
    out = F.concat(F.lit("{not json}\n"), body).cast("binary")
    for i, made in enumerate(turns):
        out = F.when(number % 4 == i, made).otherwise(out)
    return out


CELL_NAMES = '[{"measType":{"measName":"RRC.ConnMean"}},{"measType":{"measTypeName":"RRU.PrbUsedDl"}},{"measType":{}},{"measType":{"measName":"unknown"}},{"measType":{"measName":"DRB.UEThpDl"}},{"measType":{"measName":"PEE.Energy"}}]'


@query("""
WITH e AS (SELECT event_id, epoch_us(ts) // 1000 * 1000 AS us, user_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_id % 31 <> 0 AND event_id % 37 <> 0)
SELECT event_id, part, us AS ts_us, CASE part WHEN 0 THEN 'S' || (user_id % 9) || '/B2/C1' END AS name, CASE part WHEN 0 THEN 'B2' END AS band, CASE part WHEN 0 THEN k ELSE 7 END AS conn_mean, CASE part WHEN 0 THEN round(value, 2) ELSE 0 END AS used, CASE part WHEN 0 THEN CAST(2.5 AS DOUBLE) END AS thp FROM e, (VALUES (0), (1)) AS p(part)""")
def kafka_payload_decode(spark, sf):
    """Cell messages as they are sent, in four framings, some unreadable or without a time: one record of objects, one of bare numbers with fewer values than names."""
    from gaugewright.streaming import decode

    ev = events(spark, sf)
    name = F.concat(F.lit("S"), F.col("user_id") % 9, F.lit("/B2/C1"))
    body = message_text("Format1", F.col("ts"), CELL_NAMES, ['"measData":[{"metadata":{"cell_name":"', name, '","band":"B2"},"measRecord":[{"integer":', F.col("k").cast("bigint"), '},{"real":', F.round("value", 2), '},{"real":9},{"real":0.0,"integer":0,"measValue":2.5}]},{"measRecord":[7,null]}]'])
    body = F.when(F.col("event_id") % 37 == 0, F.replace(body, F.lit("event_ts_ms"), F.lit("other"))).otherwise(body)
    value = F.when(F.col("event_id") % 31 == 0, F.unhex(F.lit("7BFF7D"))).otherwise(framed(F.col("event_id"), body))
    rows = decode.cell_rows(decode.decode(ev.select("event_id", value.alias("value"))), ["event_id"])
    return rows.select("event_id", F.when(E.col("Viavi.Cell.Name").isNull(), 1).otherwise(0).alias("part"), us("timestamp").alias("ts_us"), E.col("Viavi.Cell.Name").alias("name"), "band", E.col("RRC.ConnMean").alias("conn_mean"), E.col("RRU.PrbUsedDl").alias("used"), E.col("DRB.UEThpDl").alias("thp"))


@query("""
SELECT event_id, epoch_us(ts) // 1000 * 1000 AS ts_us, 'UE' || (user_id % 7) AS name, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS cqi, round(value, 2) AS thp FROM events WHERE event_id % 29 <> 0""")
def ue_payload_decode(spark, sf):
    """UE messages: the records of several reports, one after another; messages without a body give nothing."""
    from gaugewright.streaming import decode

    ev = events(spark, sf)
    info = '[{"measType":{"measName":"DRB.UECqiDl"}},{"measType":{"measName":"DRB.UEThpUl"}}]'
    body = message_text("Format3", F.col("ts"), info, ['"ueMeasData":[{"ueID":{"gNB-UEID":{"amf-UE-NGAP-ID":"UE', F.col("user_id") % 7, '"}},"measReport":{"measReportList":[{"measRecord":[', F.col("k").cast("bigint"), ']},{"measRecord":[{"real":', F.round("value", 2), "}]}]}}]"])
    body = F.when(F.col("event_id") % 29 == 0, F.concat(F.lit('{"metadata":{"event_ts_ms":'), F.col("event_id").cast("string"), F.lit("}}"))).otherwise(body)
    rows = decode.ue_rows(decode.decode(ev.select("event_id", framed(F.col("event_id"), body).alias("value"))), ["event_id"])
    return rows.select("event_id", us("timestamp").alias("ts_us"), E.col("Viavi.UE.Name").alias("name"), E.col("DRB.UECqiDl").alias("cqi"), E.col("DRB.UEThpUl").alias("thp"))


@query("SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'unreadable' ELSE 'no event time' END AS problem FROM events WHERE event_id % 31 = 0 OR event_id % 37 = 0")
def dead_letters(spark, sf):
    """Messages that can't be read, or have no event time."""
    from gaugewright.streaming import decode

    body = F.when(F.col("event_id") % 37 == 0, F.lit('{"metadata":{}}')).otherwise(F.lit('{"metadata":{"event_ts_ms":1}}'))
    value = F.when(F.col("event_id") % 31 == 0, F.unhex(F.lit("7BFF7D"))).otherwise(framed(F.col("event_id"), body))
    return decode.dead_letters(events(spark, sf).select("event_id", value.alias("value"))).select("event_id", "problem")
