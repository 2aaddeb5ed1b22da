"""Operators on literal tables of the report shape, and properties."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gaugewright.functions import exprs as E
from gaugewright.operators import baselines, checks, convert, dimensions, faults, features, pca, score, train, windows
from gaugewright.plans import phases
from gaugewright.sources import readers, writers
from gaugewright.streaming import decode, stream

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def cell_report(spark, minutes=30, cells=3):
    rows = []
    for m in range(minutes):
        for c in range(cells):
            used = 10.0 + (m * 7 + c * 3) % 20
            rows.append((START + dt.timedelta(minutes=m), f"S1/B{c}/C1", 0.3 + used / 200, 0.1, used, used / 2, 100, 100, used, used / 2, 4.0, 1.0, 3.0, 5.0, 100.0 * m, 10.0 * m, 600.0, 10.0 * (m + 1)))
    schema = "timestamp timestamp, `Viavi.Cell.Name` string, " + ", ".join(f"`{f}` {'int' if 'Avail' in f else 'double'}" for f in readers.CELL_FIELDS)
    return spark.createDataFrame(rows, schema)


def ue_report(spark, minutes=30, ues=4):
    rows = [(START + dt.timedelta(minutes=m), f"ue{u}", 9.0, 8.0, 0.3, 0.1, 5.0 + u, 2.0, 1.0, 1.0) for m in range(minutes) for u in range(ues)]
    return spark.createDataFrame(rows, "timestamp timestamp, `Viavi.UE.Name` string, " + ", ".join(f"`{f}` double" for f in readers.UE_FIELDS))


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_expressions(spark):
    n = F.lit(None).cast("boolean")
    r = one(
        spark,
        all_na=E.row_all([n, n]), some=E.row_all([n, F.lit(True)]), bad=E.row_all([F.lit(False), n]), clip=E.clip(F.lit(5.0), 0, 3), clip_null=E.clip(F.lit(None).cast("double"), 0, 3),
        ratio=E.ratio(F.lit(1.0), F.lit(0.0)), even=E.half_even(F.lit(0.125), 2), snap=E.snap(F.lit(90_000_000), F.lit(0), 60), band=E.band_of(F.lit("S1/N77/C2")), unknown=E.band_of(F.lit("S1")),
        none=E.extract(F.lit("x"), E.CELL_PATTERNS["band"]), site=E.extract(F.lit("S1/N77/C2"), E.CELL_PATTERNS["site"]), dec=E.decimals(F.lit("1.250")), nan=E.missing(F.lit(float("nan"))), number=E.number(F.lit("x")),
        grade=E.grade(F.lit(0.6), 0.8, 0.5), off=E.off_grid(F.lit(90.0), 60), on=E.off_grid(F.lit(118.0), 60), missed=E.missed(F.lit(180.0), 60), kind=E.message_kind(F.unhex(F.lit("0001FF"))),
        repaired=E.timestamp(F.lit("2024-01-01 00:00:00_jitter")), count=E.occurrences(F.lit("a/b/c"), "/"), jsd=E.js_divergence(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))),
    )
    assert (r.all_na, r.some, r.bad, r.clip, r.clip_null, r.ratio, r.even, r.snap) == (None, True, False, 3.0, None, None, 0.12, 2)
    assert (r.band, r.unknown, r.none, r.site, r.dec, r.nan, r.number, r.grade) == ("N77", "UNKNOWN", None, "S1", 3, None, None, 0.5)
    assert (r.off, r.on, r.missed, r.kind, r["count"], r.jsd) == (True, False, 2, "E2AP_INITIATING", 2, 1.0)
    assert r.repaired.year == 2024


def test_conversion(spark):
    cells = convert.convert_cells(cell_report(spark), readers.CELL, "timestamp")
    first = cells.where("timestamp = '2024-01-01 00:00:00'").first()
    assert first["PEE.Energy_imputed"] and first["PEE.Energy_interval"] == pytest.approx(0.6 / 60)
    later = cells.where("timestamp = '2024-01-01 00:01:00'").first()
    assert later["PEE.Energy_interval"] == 10.0 and not later["PEE.Energy_reset"]
    assert later["RRU.PrbTotDl_abs"] == pytest.approx(later["RRU.PrbTotDl"])
    assert "qos_flow_1s_semantics" in convert.summary(cell_report(spark), cells)["flags"]


def test_window_numbers_and_empty_windows(spark):
    cells = cell_report(spark, 30)
    start, end = windows.span([(cells, "timestamp"), (ue_report(spark, 25), "timestamp")])
    spine = windows.spine(cells, start, end, 300, 60)
    assert spine.count() == (24 * 60 - 300) // 60 + 1
    rows = windows.assign(cells.where("minute(timestamp) < 3 OR minute(timestamp) > 15"), "timestamp", start, end, 300, 60)
    by = {r.window_number: r for r in windows.metadata(rows, spine, "timestamp", readers.CELL, 5).collect()}
    assert by[5].rows == 0 and by[5].reason == "empty" and by[0].rows == 9 and not by[0].valid and by[16].valid
    assert by[0].window_id == "window_000000_20240101_000000"
    with pytest.raises(ValueError):
        windows.span([(cells.limit(0), "timestamp")])


def test_scores_of_clean_and_faulty_reports(spark):
    baseline = {"accuracy_thp_per_prb_band": {s: {"q25": 1.0, "q75": 100.0} for s in ("dl", "ul")}}
    clean = convert.convert_cells(cell_report(spark), readers.CELL, "timestamp")
    baseline["hourly"] = {"cells": {"0": {"median": 3}}, "ues": {"0": {"median": 4}}}
    ues = ue_report(spark)
    span = windows.span([(clean, "timestamp"), (ues, "timestamp")])
    scored = phases.score_windows(clean, ues, baseline, span, 300, 60)
    got = scored.agg(*[F.min(f"{d}_mpr").alias(d) for d in dimensions.DIMENSIONS], F.max("status").alias("status")).first().asDict()
    assert got["timeliness"] == 1.0 and got["validity"] == 1.0 and got["accuracy"] > 0.9 and got["completeness"] == 1.0 and got["status"] == "OK"
    bad = clean.withColumn("RRU.PrbUsedDl", F.lit(500.0))
    worse = phases.score_windows(bad, ues, baseline, span, 300, 60).agg(F.avg("validity_mpr")).first()[0]
    assert worse < 1.0
    nameless = phases.score_windows(clean.drop(readers.CELL), ues, baseline, span, 300, 60).first()
    assert (nameless.status, nameless.validity_mpr) == ("ERROR", 0.0) and "cell reports" in nameless.error
    odd = phases.score_windows(clean.withColumn("RRC.ConnMax", F.array(F.lit(1))), ues, baseline, span, 300, 60).first()
    assert odd.status == "ERROR" and odd.accuracy_mpr > 0.9


def test_labels_stay_on_their_windows(spark):
    cells, ues = cell_report(spark, 40), ue_report(spark, 40).where("minute(timestamp) >= 10")
    late = cells.withColumn("RRU.PrbUsedDl", F.when(F.minute("timestamp") >= 30, 500.0).otherwise(E.col("RRU.PrbUsedDl")))
    model = pca.Consolidator(tuple(dimensions.DIMENSIONS), (0.5,) * 5, (1.0,) * 5, (0.0, 0.0, -1.0, 0.0, 0.0), 0.0, 0.2, 1.0)
    rows = phases.label_windows(late, ues, {}, 300, 60, model).orderBy("window_id").select("window_id", "meta_start_time", "label").collect()
    assert rows[0].window_id == "window_000000_20240101_001000"
    good = {r.label for r in rows if r.meta_start_time < "2024-01-01 00:25"}
    assert len(good) == 1 and all(r.label < min(good) for r in rows if r.meta_start_time >= "2024-01-01 00:27")


def test_exact_quantiles_in_small_steps(spark):
    from gaugewright.operators import ranks

    df = spark.range(40_000).select(F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("key"), F.floor(F.pmod(F.xxhash64("id"), F.lit(30_000)) / 3).cast("double").alias("value"))
    shares = (0.0, 0.01, 0.25, 0.5, 0.777, 1.0)
    want = {r.key: r.q for r in df.groupBy("key").agg(F.percentile("value", F.array(*[F.lit(p) for p in shares])).alias("q")).collect()}
    for small in (10, 300, 10**6):
        got = ranks.quantiles(df, shares, small)
        assert {k: n for k, (n, _) in got.items()} == {"a": 10_000, "b": 30_000}
        assert all(got[k][1] == pytest.approx(want[k]) for k in want)
    assert ranks.quantiles(df.limit(0), shares) == {}


def test_feature_rows(spark):
    cells = convert.convert_cells(cell_report(spark), readers.CELL, "timestamp")
    rows = phases.feature_table(cells, ue_report(spark), windows.span([(cells, "timestamp"), (ue_report(spark), "timestamp")]), 300, 60)
    assert rows.columns == [c for c in features.feature_columns() if c != "label"]
    assert len(features.feature_columns()) == 148
    r = rows.orderBy("window_id").first()
    assert (r.cell_rows, r.ue_rows, r.unique_cells, r.unique_ues, r.t2_expected_slots, r.t2_missing_slots) == (15, 20, 3, 4, 5.0, 0.0)
    assert r["recon_thp_ul_median"] == pytest.approx(0.4 / 0.3)


def test_pca_golden(spark):
    rows = [(0.9, 0.8, 1.0), (0.5, 0.4, 1.0), (0.7, 0.65, 1.0), (0.2, 0.1, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    model = pca.fit(df, ["a", "b", "c"])
    assert model.columns == ("a", "b")
    labels = [r.label for r in model.transform(df).orderBy("a").collect()]
    assert labels == sorted(labels) and all(0 <= x <= 1 for x in labels)
    assert pca.Consolidator.from_json(model.to_json()) == model


def test_train_save_load(spark, tmp_path):
    df = spark.range(60).select(F.col("id").alias("window_end"), (F.col("id") % 7).cast("double").alias("x.y"), F.lit(1.0).alias("same"), ((F.col("id") % 7) / 7.0).alias("label"))
    model = train.fit(df, ["x.y", "same"], order=["window_end"], candidates=[{"depth": 3, "rounds": 5}])
    assert model.names == ["x.y"] and model.meta["mae"] < 0.1
    model.save(str(tmp_path / "m"))
    again = train.Predictor.load(str(tmp_path / "m"))
    assert again.predict(df).agg(F.sum("prediction")).first()[0] == pytest.approx(model.predict(df).agg(F.sum("prediction")).first()[0])
    assert 0 <= again.predict(df.drop("x.y")).agg(F.min("prediction")).first()[0] <= 1


def test_faults_do_not_depend_on_partitions(spark):
    cells = cell_report(spark, 60)
    start, end = windows.span([(cells, "timestamp")])
    spine = windows.spine(cells, start, end, 300, 60, partial_tail=True)
    made = [faults.inject(cells.repartition(n), "timestamp", ["timestamp", readers.CELL], spine, start, 300, 60, share=0.5, rows=0.5, seed=3) for n in (1, 7)]
    one_, seven = (sorted(map(str, m[0].collect())) for m in made)
    assert one_ == seven and len(one_) == 180
    assert made[0][1].count() > 0
    assert sorted(map(str, cells.collect())) != one_


def test_time_column(spark):
    assert faults.time_column(spark.range(1).select(F.lit(1).alias("myTime"))) == "myTime"
    with pytest.raises(ValueError):
        faults.time_column(spark.range(1))


def test_presence_baseline():
    got = baselines.presence_baseline({"cells": {"3": {"median": 7}}})
    assert got["cells"][3] == 7 and got["cells"][4] == 52 and got["ues"][0] == 33


def test_slack_and_padding(spark):
    assert checks.padded("RRU.PrbUsedDl", 0.5, 9.5) == (0.0, 11.0) and checks.padded("RRC.ConnMax", 2.5, 9) == (1.0, 10.0)
    assert checks.padded("x", 0.0, 100.0) == (-1.0, 101.0) and checks.padded("x", 1.0, 1.0) == (1.0, 1.0)
    assert checks.padded("PEE.Energy_interval", 0.1, 0.2, 60, 5) == (55.0, 65.0) and checks.padded("DRB.UEThpDl", 0.5, 1.0) == (0.49, 1.01)
    r = one(spark, a=checks.rule_slack(F.lit(None).cast("double"), 1), b=checks.rule_slack(F.lit(10_000.0), 1), c=checks.rule_slack(F.lit(1.0), 1, 2.0))
    assert (r.a, r.b, r.c) == (1.0, 3.0, 2.0)


def test_coverage(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "g int, x double")
    dims = [checks.Dimension("a", [checks.row("p", "a", F.col("x") > 0), checks.row("q", "a", F.col("g") > 0)]), checks.Dimension("b", [checks.row("p", "b", F.col("x") > 0)], True)]
    r = score.scores(df, ["g"], dims).first()
    assert (r.a_mpr, r.a_apr, r.a_coverage, r.b_mpr, r.b_coverage) == (1.0, 1.0, 0.5, 0.0, 0.0)


def test_sources_and_sinks(spark, tmp_path):
    cells = cell_report(spark, 3).withColumn("timestamp", F.unix_timestamp("timestamp"))
    writers.csv(cells, str(tmp_path / "cells"))
    back = readers.csv_reports(spark, str(tmp_path / "cells"), readers.CELL_SCHEMA)
    assert back.count() == 9 and dict(back.dtypes)["timestamp"] == "timestamp" and dict(back.dtypes)["PEE.Energy"] == "double"
    writers.parquet_windows(back.withColumn("window_start", F.col("timestamp")).withColumn("window_id", F.lit("w1")), str(tmp_path / "w"))
    assert readers.windows(spark, str(tmp_path / "w"), ["w1"]).count() == 9
    first = writers.new_version(back, str(tmp_path / "labels"))
    assert writers.new_version(back, str(tmp_path / "labels")) != first
    path = writers.artifact({"a": 1}, str(tmp_path / "art"), "baseline", stamp="20240101_000000")
    writers.artifact({"a": 2}, str(tmp_path / "art"), "baseline", stamp="20240102_000000")
    assert readers.artifact(spark, path) == {"a": 1} and readers.baseline(str(tmp_path / "art")) == {"a": 2}
    with pytest.raises(ValueError):
        readers.artifact(spark, "x.pkl")
    writers.json_lines(back.select("timestamp"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 9


def test_decode_is_tolerant(spark):
    info = lambda *names: [{"measType": {"measName" if i % 2 else "measTypeName": n}} for i, n in enumerate(names)]
    good = json.dumps({"metadata": {"event_ts_ms": "1000"}, "indicationMessage-Format1": {"measInfoList": info("PEE.Energy", "unknown", "RRC.ConnMax"), "measData": [{"metadata": {"cell_name": "S1/B2/C1", "band": "B2"}, "measRecord": [{"integer": 0, "real": 2.5}, 1]}, {"measRecord": [{"measValue": 3}]}]}}).encode()
    ue = json.dumps({"metadata": {"event_ts_ms": 1000}, "indicationMessage-Format3": {"measInfoList": info("DRB.UECqiDl", "DRB.UEThpDl", "TB.TotNbrDl"), "ueMeasData": [{"ueID": {"gNB-UEID": {"amf-UE-NGAP-ID": 7}}, "measReport": {"measReportList": [{"measRecord": [9]}, {"measRecord": [{"real": 1.5}, {"real": 0.0}]}]}}]}}).encode()
    values = [good, b"\x00\x00\x01\x00" + good, b"\xff\xfe", b"", b"junk\n" + good + b"\n tail", b"{broken}\n" + good, json.dumps({"metadata": {}}).encode(), ue, None]
    df = spark.createDataFrame([(None if v is None else bytearray(v),) for v in values], "value binary")
    rows = decode.cell_rows(decode.decode(df)).collect()
    assert len(rows) == 8 and {r["PEE.Energy"] for r in rows} == {2.5, 3.0} and all(r["RRC.ConnMax"] is None for r in rows)
    (u,) = decode.ue_rows(decode.decode(df)).collect()
    assert (u[readers.UE], u["DRB.UECqiDl"], u["DRB.UEThpDl"], u["TB.TotNbrDl"], u["DRB.UECqiUl"]) == ("7", 9.0, 1.5, 0.0, None)
    assert {(r[readers.CELL], r.band) for r in rows} == {("S1/B2/C1", "B2"), (None, None)}
    assert decode.dead_letters(df).groupBy("problem").count().orderBy("problem").collect() == [("no event time", 1), ("unreadable", 3)]
    replaced = decode.decode(spark.createDataFrame([(bytearray(good.replace(b"B2", b"B\xff")),)], "value binary"), strict=False)
    assert decode.cell_rows(replaced).count() == 2
    wrapped = spark.createDataFrame([(bytearray(b'{"normalized_rows":[{"a":1},{"a":2}]}'),)], "value binary")
    assert [r.a for r in decode.normalised_rows(wrapped, "a:int").collect()] == [1, 2]


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    ev = readers.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    ev.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    measures = [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), stream.distinct_count(F.col("user_id")).alias("users")]
    batch = stream.window_aggregate(ev, "ts", measures, size="6 hours", step="1 hour")
    live = stream.window_aggregate(spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "ts", measures, size="6 hours", step="1 hour", delay="40 days")
    q = stream.to_tables("live_windows", live, str(tmp_path / "cp"), "complete")
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("live_windows").collect())) == sorted(map(str, batch.collect()))


def test_messages(spark):
    scored = spark.createDataFrame([(START, START + dt.timedelta(minutes=5), 0.5)], "window_start timestamp, window_end timestamp, dq_score double")
    m = writers.as_messages(stream.score_messages(scored)).first()
    assert m.key == "window_20240101_000000" and json.loads(m.value)["dq_score"] == 0.5


def test_phases_end_to_end(spark, tmp_path):
    cells = cell_report(spark, 60).withColumn("RRU.PrbUsedDl", F.when(F.minute("timestamp") > 40, 500.0).otherwise(E.col("RRU.PrbUsedDl")))
    steps = phases.learn_baseline(cells, ue_report(spark, 60), str(tmp_path / "art"))
    doc = readers.baseline(str(tmp_path / "art"))
    assert steps["baseline"] and doc["cadence_sec"] == 60.0 and doc["ue_cell_thp_ratio"]["dl"]["n"] == 60
    labelled = phases.label_windows(cells, ue_report(spark, 60), doc, 300, 60)
    assert labelled.columns == features.feature_columns() and labelled.where("label is null").count() == 0


def test_command_line(spark, tmp_path, capsys):
    from gaugewright.__main__ import main

    epoch = lambda df: df.withColumn("timestamp", F.unix_timestamp("timestamp"))
    used = F.when(F.minute("timestamp") > 25, 500.0).otherwise(E.col("RRU.PrbUsedDl"))
    writers.csv(epoch(cell_report(spark, 40).withColumn("RRU.PrbUsedDl", used)), str(tmp_path / "cells"))
    writers.csv(epoch(ue_report(spark, 40)), str(tmp_path / "ues"))
    c, u, art = str(tmp_path / "cells"), str(tmp_path / "ues"), str(tmp_path / "art")
    main(["inspect", c])
    main(["learn", c, u, art])
    main(["inject", c, str(tmp_path / "faulty"), "--share", "0.9"])
    main(["label", c, u, art, str(tmp_path / "labelled")])
    assert "Viavi.Cell.Name" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "labelled_v001")).columns == features.feature_columns()
    assert readers.csv_inferred(spark, str(tmp_path / "faulty" / "manifest")).count() > 0


def test_ranks_over_the_whole_table(spark):
    from gaugewright.operators import ranks

    df = spark.range(500).select(((F.col("id") * 37) % 91).alias("x"), "id").unionByName(spark.createDataFrame([(None, 1000)], "x long, id long")).repartition(7)
    rows = sorted(((r.x if r.x is not None else -1, r.id), r.n) for r in ranks.row_numbers(df, F.col("x"), ["id"]).collect())
    assert [n for _, n in rows] == list(range(1, 502))
    got = {r.x: r.previous for r in ranks.previous(df.where("x is not null").select("x").distinct(), F.col("x")).collect()}
    assert got == {x: (x - 1 if x else None) for x in range(91)}
    assert ranks.row_numbers(df.limit(0), F.col("x")).count() == 0
    assert windows.evenly_spaced(spark.range(101), "id", 3).orderBy("id").collect() == [(0,), (50,), (100,)]
