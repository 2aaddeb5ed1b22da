"""Sliding windows by ingest time, as one streaming query.

Rows belong to windows by when they were ingested, so rows that are late by event time still count.
Windows come out once, when the watermark (the largest ingest time) has passed their end; state is
dropped by the watermark; the checkpoint makes a restart go on where it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.exprs import col, iso


def window_aggregate(df: DataFrame, ingest: str, measures: Sequence[Column], keys: Sequence[str] = (), size: str = "300 seconds", step: str = "60 seconds", delay: str = "0 seconds") -> DataFrame:
    """One row for each window and key. The same call works on a table: a stream's result is the batch's."""
    if df.isStreaming:
        df = df.withWatermark(ingest, delay)
    out = df.groupBy(F.window(col(ingest), size, step).alias("w"), *[col(k) for k in keys]).agg(*measures)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def retained(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Rows no older than so many seconds before the newest."""
    newest = df.agg(F.max(col(ts)).alias("_newest"))
    return df.crossJoin(F.broadcast(newest)).where(F.unix_micros(col(ts)) >= F.unix_micros("_newest") - F.lit(seconds * 1_000_000)).drop("_newest")  # a single row


def distinct_count(c: Column) -> Column:
    """Exact distinct values; unlike countDistinct it can run in a stream."""
    return F.size(F.collect_set(c))


def to_tables(query_name: str, df: DataFrame, checkpoint: str | None = None, mode: str = "append"):
    """Run a stream over what is there now, into a table in memory."""
    writer = df.writeStream.queryName(query_name).format("memory").outputMode(mode).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def score_messages(scored: DataFrame, score: str = "dq_score", extra: Sequence[str] = ()) -> DataFrame:
    """The message of each scored window, keyed by window_id."""
    start, end = F.col("window_start"), F.col("window_end")
    window_id = F.format_string("window_%s", F.date_format(start, "yyyyMMdd_HHmmss"))
    return scored.select(
        window_id.alias("window_id"), iso(start).alias("start_time"), iso(end).alias("end_time"), F.col(score).alias("dq_score"), iso(F.current_timestamp()).alias("timestamp"),
        F.unix_millis(F.current_timestamp()).alias("publish_ts_ms"), F.struct(*[col(c) for c in extra] or [F.lit(None).cast("string").alias("none")]).alias("metadata"),
    )


def latency(scored: DataFrame, last_ingest: str = "last_ingest_ms") -> DataFrame:
    """Milliseconds from the last ingested row of a window to its publication."""
    return scored.withColumn("latency_ms", F.col("publish_ts_ms") - F.col(last_ingest))
