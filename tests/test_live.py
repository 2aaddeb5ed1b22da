"""Messages from files, one file a micro-batch, to published windows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from gaugewright.streaming import live

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def cell(at, name, value):
    info = [{"measType": {"measName": "DRB.UEThpDl"}}, {"measType": {"measName": "PEE.Energy"}}, {"measType": {"measTypeName": "PEE.AvgPower"}}]
    record = [{"real": value}, value * 10, {"integer": 100}]
    return json.dumps({"metadata": {"event_ts_ms": int(at.timestamp() * 1000)}, "indicationMessage-Format1": {"measInfoList": info, "measData": [{"metadata": {"cell_name": name, "band": "B2"}, "measRecord": record}]}}).encode()


def ue(at, name):
    return json.dumps({"metadata": {"event_ts_ms": int(at.timestamp() * 1000)}, "indicationMessage-Format3": {"measInfoList": [{"measType": {"measName": "DRB.UEThpUl"}}], "ueMeasData": [{"ueID": {"gNB-UEID": {"amf-UE-NGAP-ID": name}}, "measReport": {"measReportList": [{"measRecord": [{"real": 0.5}]}]}}]}}).encode()


def write(spark, folder, number, minutes):
    """Two cells and a UE a minute; one row of minute 4 tells a time three minutes before; some messages can't be read."""
    rows = []
    for m in minutes:
        at = START + dt.timedelta(minutes=m, seconds=5)
        told = at - dt.timedelta(minutes=3) if m == 4 else at
        rows += [(cell(told, "S1/B2/C1", 0.1 * m), at), (cell(at, "S1/B2/C2", 0.2), at + dt.timedelta(seconds=54, milliseconds=999)), (b"\x00\x00\x00\x09" + ue(at, "U1"), at), (b"\xff\xfe{", at), (b'{"metadata":{}}', at)]
    spark.createDataFrame([(bytearray(v), t.replace(tzinfo=None)) for v, t in rows], "value binary, kafka_ts timestamp").coalesce(1).write.parquet(f"{folder}/{number}")


def test_live_windows(spark, tmp_path):
    published, dead = [], []
    engine = live.Live(
        str(tmp_path / "kept"), lambda df: df.withColumn("dq_score", F.lit(0.75)), lambda df, i: published.extend((i, m) for m in live.as_json(df)), dead=lambda df, i: dead.append((i, df.count()))
    )
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    read = lambda: spark.readStream.schema("value binary, kafka_ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    write(spark, folder, 0, range(0, 3))
    engine.start(read(), checkpoint, None).awaitTermination(120)
    write(spark, folder, 1, range(3, 8))
    write(spark, folder, 2, range(8, 9))
    engine.start(read(), checkpoint, None).awaitTermination(120)  # goes on where it was
    ids = [m["window_id"] for _, m in published]
    # the first batch publishes its newest minute; every later minute comes once
    assert sorted(ids) == [f"20240101_00{m:02d}59" for m in range(2, 9)]
    by = {m["window_id"]: m for _, m in published}
    for m in range(2, 9):
        got, held = by[f"20240101_00{m:02d}59"]["metadata"], range(max(0, m - 4), m + 1)
        assert (got["cell_rows"], got["ue_rows"], got["cell_entities"], got["ue_entities"]) == (2 * len(held), len(held), 2, 1)
        assert got["last_kafka_ts_ms"] == int((START + dt.timedelta(minutes=m, seconds=59, milliseconds=999)).timestamp() * 1000) and got["latency_ms"] > 0
    assert by["20240101_000859"]["start_time"] == "2024-01-01T00:04:00Z" and by["20240101_000859"]["dq_score"] == 0.75
    assert sum(n for _, n in dead) == 2 * 9
    kept = {int(p.name.partition("=")[2]) - int(START.timestamp()) // 60 for p in (tmp_path / "kept" / "cells").glob("batch=*/minute=*")}
    assert kept == set(range(5, 9))
    before = len(published)
    engine.batch(spark.read.schema("value binary, kafka_ts timestamp").parquet(f"{folder}/2"), 2)  # a batch that runs again publishes the same window
    assert [m["window_id"] for _, m in published[before:]] == ["20240101_000859"]
