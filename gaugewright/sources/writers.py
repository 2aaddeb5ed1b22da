"""Sinks: partitioned parquet, CSV, JSON lines, versioned artifacts and their registry, Kafka."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.functions.exprs import col


def parquet_windows(df: DataFrame, path: str, start: str = "window_start", mode: str = "overwrite") -> None:
    """Windows as parquet, a folder a day: a window is a column value, so there are no small files for each. Rows of a day meet in few files."""
    dated = df.withColumn("window_date", F.to_date(col(start)))
    dated.write.mode(mode).partitionBy("window_date").option("compression", "snappy").parquet(path)


def window_index(metadata: DataFrame, path: str) -> None:
    """The metadata of all windows as JSON lines: ids, ends, counts, completeness, times."""
    metadata.write.mode("overwrite").json(path)


def windows_summary(metadata: DataFrame, path: str, extra: Mapping | None = None) -> dict:
    """One JSON document on all windows."""
    from gaugewright.operators.windows import statistics

    prefix = next(c.removesuffix("rows") for c in metadata.columns if c.endswith("rows"))
    found = statistics(metadata, f"{prefix}completeness", f"{prefix}rows").first().asDict() | dict(extra or {})
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(found, indent=2, default=str))
    return found


def schema_document(columns: Sequence[str], path: str) -> None:
    """The locked order of a table's columns."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(list(columns), indent=2))


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own below the one that driver and executors share (spark.checkpoint.dir), or a temporary one on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gaugewright-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; arrays, maps and structs as JSON."""
    nested = {n: F.to_json(col(n)) for n, kind in df.dtypes if kind.startswith(("array", "map", "struct"))}
    df.withColumns(nested).write.mode(mode).option("header", True).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def new_version(df: DataFrame, path: str) -> str:
    """Parquet under <path>_vNNN, never over an older version; the name that was free."""
    root = Path(path)
    taken = [int(p.name.rsplit("_v", 1)[1]) for p in root.parent.glob(f"{root.name}_v[0-9][0-9][0-9]")]
    name = f"{path}_v{max(taken, default=0) + 1:03d}"
    df.write.mode("errorifexists").parquet(name)
    return name


def artifact(document: Mapping, root: str, kind: str, version: str = "1", metadata: Mapping | None = None, stamp: str | None = None) -> str:
    """A JSON document as <kind>_v<version>_<time>.json, its metadata beside it, and an entry in the registry."""
    folder = Path(root)
    folder.mkdir(parents=True, exist_ok=True)
    stamp = stamp or time.strftime("%Y%m%d_%H%M%S", time.gmtime())
    path = folder / f"{kind}_v{version}_{stamp}.json"
    path.write_text(json.dumps(document, indent=2, default=str))
    if metadata:
        path.with_suffix(".metadata.json").write_text(json.dumps(metadata, indent=2, default=str))
    registry = folder / "registry" / "artifacts.json"
    registry.parent.mkdir(exist_ok=True)
    entries = json.loads(registry.read_text()) if registry.exists() else []
    registry.write_text(json.dumps([*entries, {"kind": kind, "version": version, "created": stamp, "path": str(path)}], indent=2))
    return str(path)


def report(path: str, steps: Mapping[str, object]) -> None:
    Path(path).write_text(json.dumps({"completed": all(v not in (False, None) for v in steps.values()), "steps": steps}, indent=2, default=str))


def as_messages(df: DataFrame, key: str = "window_id") -> DataFrame:
    """key and value (JSON of the whole row) for a message sink."""
    return df.select(col(key).cast("string").alias("key"), F.to_json(F.struct(*[col(c) for c in df.columns])).alias("value"))


def kafka_stream(df: DataFrame, brokers: str, topic: str, checkpoint: str, trigger: str = "1 second"):
    """Start a streaming write: all replicas acknowledge, writes are idempotent, lz4, 10 ms linger."""
    writer = as_messages(df).writeStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).option("checkpointLocation", checkpoint)
    for k, v in {"acks": "all", "enable.idempotence": "true", "compression.type": "lz4", "linger.ms": "10"}.items():
        writer = writer.option(f"kafka.{k}", v)
    return writer.trigger(processingTime=trigger).start()
