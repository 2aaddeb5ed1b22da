"""Report messages, from a stream, to scored windows: decode, keep, window by ingest time, features, score, publish.

A window is the `size` seconds before a minute's end, by when rows were ingested (late event times still
count). Its minute's end is reached as soon as a row of that minute arrives in either stream, and both
have been seen; each end is published once. Features are the batch operators', over the rows kept.

Everything kept lies in the shared folder `root`: rows by micro-batch and minute, and what each batch
came to. A batch that runs again after a failure writes the same folders anew and publishes the same
window ids, so the sink sees each at least once. Minutes that no later window reaches are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from time import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.functions.exprs import col, iso
from gaugewright.operators import convert, features, windows
from gaugewright.sources.readers import CELL, UE
from gaugewright.streaming import decode

MINUTE = 60_000_000
KINDS = {"cells": CELL, "ues": UE}


@dataclass
class Live:
    """predict: feature rows -> the same with dq_score; publish: (messages, batch id) -> None."""

    root: str
    predict: Callable[[DataFrame], DataFrame]
    publish: Callable[[DataFrame, int], None]
    size: int = 300
    cadence: float = 60.0
    dead: Callable[[DataFrame, int], None] | None = None

    def start(self, messages: DataFrame, checkpoint: str, trigger: str | None = "1 second"):
        """messages: value (binary) and kafka_ts. Without a trigger interval, what is there now is read and the query ends."""
        writer = messages.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()

    # what is kept

    def state(self, spark: SparkSession, before: int) -> dict:
        """What the batches before this one came to."""
        try:
            rows = spark.read.schema("batch long, newest long, last_end long, cells boolean, ues boolean").json(f"{self.root}/state/*").where(F.col("batch") < before)
            found = rows.orderBy(F.desc("batch")).limit(1).collect()
        except AnalysisException:
            found = []
        return found[0].asDict() if found else {"newest": None, "last_end": None, "cells": False, "ues": False}

    def keep(self, rows: DataFrame, kind: str, batch_id: int) -> None:
        rows = rows.where(col(KINDS[kind]).isNotNull() & F.col("timestamp").isNotNull())
        minute = F.floor(F.unix_micros("kafka_ts") / MINUTE)
        rows.withColumn("minute", minute).write.mode("overwrite").partitionBy("minute").parquet(f"{self.root}/{kind}/batch={batch_id}")

    def kept(self, spark: SparkSession, kind: str, low: int, high: int, schema) -> DataFrame:
        """Rows of the minutes from low up to but not including high; other minutes' folders aren't read."""
        return spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(f"{self.root}/{kind}/batch=*").where((F.col("minute") >= low) & (F.col("minute") < high))

    def evict(self, spark: SparkSession, low: int) -> None:
        """Remove minutes before `low`."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for kind in KINDS:
            pattern = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/batch=*/minute=*")
            fs = pattern.getFileSystem(conf)
            for status in fs.globStatus(pattern) or []:
                if int(status.getPath().getName().partition("=")[2]) < low:
                    fs.delete(status.getPath(), True)

    # a micro-batch

    def batch(self, messages: DataFrame, batch_id: int) -> None:
        spark, began = messages.sparkSession, time()
        decoded = decode.decode(messages)
        rows = {"cells": decode.cell_rows(decoded, ["kafka_ts"]).drop("band"), "ues": decode.ue_rows(decoded, ["kafka_ts"])}
        for kind, df in rows.items():
            self.keep(df, kind, batch_id)
        if self.dead:
            self.dead(decode.dead_letters(messages), batch_id)
        state = self.state(spark, batch_id)
        schemas = {kind: df.schema.add("batch", "long").add("minute", "long") for kind, df in rows.items()}
        for kind in KINDS:
            own = spark.read.schema(schemas[kind]).parquet(f"{self.root}/{kind}/batch={batch_id}").agg(F.max(F.unix_micros("kafka_ts"))).first()[0]
            if own is not None:
                state[kind], state["newest"] = True, max(own, state["newest"] or 0)
        if state["newest"] is not None and state["cells"] and state["ues"]:
            end = (state["newest"] // MINUTE + 1) * MINUTE
            first = end if state["last_end"] is None else state["last_end"] + MINUTE
            if first <= end:
                self.publish(self.scored(spark, schemas, first, end, began), batch_id)
                state["last_end"] = end
                self.evict(spark, (end - self.size * 1_000_000) // MINUTE + 1)
        done = [(batch_id, state["newest"], state["last_end"], state["cells"], state["ues"])]
        spark.createDataFrame(done, "batch long, newest long, last_end long, cells boolean, ues boolean").coalesce(1).write.mode("overwrite").json(f"{self.root}/state/batch-{batch_id}")

    def scored(self, spark: SparkSession, schemas: dict, first: int, end: int, began: float) -> DataFrame:
        """The messages of all windows that end from first to end."""
        start, size = first - self.size * 1_000_000, self.size
        assigned = {k: windows.assign(self.kept(spark, k, start // MINUTE, end // MINUTE, schemas[k]).drop("batch", "minute"), "kafka_ts", start, end, size, 60) for k in KINDS}
        spine = windows.spine(assigned["cells"], start, end, size, 60)
        # counters are differences within a window
        named = F.concat_ws("|", F.col("window_number").cast("string"), col(CELL))
        cells = convert.convert_cells(assigned["cells"].drop("kafka_ts", "window_start").withColumn("_named", named), "_named", "timestamp", self.cadence).drop("_named")
        made = self.predict(features.feature_rows(cells, assigned["ues"].drop("kafka_ts", "window_start"), spine, self.cadence))
        both = assigned["cells"].select("window_number", "timestamp", "kafka_ts").unionByName(assigned["ues"].select("window_number", "timestamp", "kafka_ts"))
        last = both.groupBy("window_number").agg(F.max("timestamp").alias("last_event"), F.max(F.unix_millis("kafka_ts")).alias("last_kafka"))
        out = spine.join(made.drop("window_number"), "window_id").join(last, "window_number", "left")
        return out.select(*messages_of(out, began))


def messages_of(out: DataFrame, began: float) -> list[Column]:
    """window_id (its last whole second), ends, score, and what the score rests on."""
    closed = F.col("window_end") - F.make_dt_interval(secs=F.lit(0.001))
    now = F.unix_millis(F.current_timestamp())
    about = F.struct(
        F.col("unique_cells").alias("cell_entities"), F.col("unique_ues").alias("ue_entities"), "cell_rows", "ue_rows", iso(F.col("last_event")).alias("last_event_ts"), F.col("last_kafka").alias("last_kafka_ts_ms"), now.alias("publish_ts_ms"),
        F.greatest(now - F.col("last_kafka"), F.lit(0)).alias("latency_ms"), F.greatest(now - F.lit(int(began * 1000)), F.lit(0)).alias("processing_time_ms"),
    )
    return [
        F.date_format(closed, "yyyyMMdd_HHmmss").alias("window_id"), iso(F.col("window_start")).alias("start_time"), iso(closed).alias("end_time"), F.col("dq_score"), iso(F.current_timestamp()).alias("timestamp"),
        now.alias("publish_ts_ms"), about.alias("metadata"),
    ]


def latencies(messages: DataFrame) -> DataFrame:
    """Latency over all published windows: count, mean, median, largest."""
    x = F.col("metadata.latency_ms")
    return messages.agg(F.count(x).alias("windows"), F.avg(x).alias("mean_ms"), F.percentile_approx(x, 0.5).alias("median_ms"), F.max(x).alias("max_ms"))


def as_json(message: DataFrame) -> list[dict]:
    """For a look: messages as documents."""
    return [json.loads(r[0]) for r in message.select(F.to_json(F.struct("*"))).collect()]
