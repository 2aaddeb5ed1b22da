"""Sources: typed and inferred CSV, parquet, JSON documents, artifacts, Kafka."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.functions.exprs import col, missing, timestamp

#: The columns of the two report tables.
CELL_FIELDS = (
    "DRB.UEThpDl", "DRB.UEThpUl", "RRU.PrbUsedDl", "RRU.PrbUsedUl", "RRU.PrbAvailDl", "RRU.PrbAvailUl", "RRU.PrbTotDl", "RRU.PrbTotUl",
    "RRU.MaxLayerDlMimo", "CARR.AverageLayersDl", "RRC.ConnMean", "RRC.ConnMax", "QosFlow.TotPdcpPduVolumeDl", "QosFlow.TotPdcpPduVolumeUl", "PEE.AvgPower", "PEE.Energy",
)
UE_FIELDS = ("DRB.UECqiDl", "DRB.UECqiUl", "DRB.UEThpDl", "DRB.UEThpUl", "RRU.PrbUsedDl", "RRU.PrbUsedUl", "TB.TotNbrDl", "TB.TotNbrUl")
CELL, UE = "Viavi.Cell.Name", "Viavi.UE.Name"
CELL_PATTERN = r"S\d+/([^/]+)/C\d+"
#: Metric groups of the checks; operators take them as arguments.
GROUPS = {
    "prb": ("RRU.PrbUsedDl", "RRU.PrbUsedUl", "RRU.PrbAvailDl", "RRU.PrbAvailUl", "RRU.PrbTotDl", "RRU.PrbTotUl"),
    "throughput": ("DRB.UEThpDl", "DRB.UEThpUl"), "cqi": ("DRB.UECqiDl", "DRB.UECqiUl"), "energy": ("PEE.AvgPower", "PEE.Energy"),
    "connections": ("RRC.ConnMean", "RRC.ConnMax"), "mimo": ("RRU.MaxLayerDlMimo", "CARR.AverageLayersDl"), "flows": ("QosFlow.TotPdcpPduVolumeDl", "QosFlow.TotPdcpPduVolumeUl"), "unreliable": ("TB.TotNbrDl", "TB.TotNbrUl"),
}


def report_schema(entity: str, fields: Sequence[str]) -> T.StructType:
    whole = {"RRU.PrbAvailDl", "RRU.PrbAvailUl"}
    return T.StructType([T.StructField("timestamp", T.LongType()), T.StructField(entity, T.StringType()), *[T.StructField(f, T.IntegerType() if f in whole else T.DoubleType()) for f in fields]])


CELL_SCHEMA, UE_SCHEMA = report_schema(CELL, CELL_FIELDS), report_schema(UE, UE_FIELDS)


def csv_reports(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A typed CSV scan; epoch seconds become timestamps, NaN becomes NULL. Fields are matched by header name."""
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f for f in schema}
    read = spark.read.schema(T.StructType([known.get(h, T.StructField(h, T.StringType())) for h in header])).option("header", True).csv(path)
    out = read.withColumn("timestamp", F.timestamp_seconds("timestamp"))
    return out.withColumns({n: missing(col(n)) for n, kind in out.dtypes if kind == "double"})


def csv_inferred(spark: SparkSession, path: str, ts: str | None = None) -> DataFrame:
    """An inferred CSV scan; a time column is repaired and rows without a time go."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.withColumn(ts, timestamp(col(ts))).na.drop(subset=[ts]) if ts else df


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def windows(spark: SparkSession, root: str, window_ids: Sequence[str] | None = None, schema: str | None = None) -> DataFrame:
    """A dataset of windows; the dates in ids (window_<number>_<date>_<time>) prune its folders. Where there is none, an empty table of the given schema."""
    try:
        df = spark.read.parquet(root)
    except AnalysisException:
        if schema is None:
            raise
        return spark.createDataFrame([], schema)
    if not window_ids:
        return df
    days = [f"{d[:4]}-{d[4:6]}-{d[6:]}" for d in (i.split("_")[-2] for i in window_ids if i.count("_") >= 3) if len(d) == 8 and d.isdigit()]
    if "window_date" in df.columns and len(days) == len(window_ids):
        df = df.where(F.col("window_date").isin([F.lit(d).cast("date") for d in sorted(set(days))]))
    return df.where(F.col("window_id").isin(list(window_ids)))


def document(path: str) -> dict | list:
    """A JSON document (artifact, metadata), or {} if there is none."""
    p = Path(path)
    return json.loads(p.read_text()) if p.exists() else {}


def artifact(spark: SparkSession, path: str):
    """By suffix: parquet and csv as DataFrames, json as a document. Pickles are refused: they can run code."""
    suffix = Path(path).suffix
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".csv":
        return csv_inferred(spark, path)
    if suffix == ".json":
        return document(path)
    if suffix == ".npy":
        import numpy as np

        return np.load(path, allow_pickle=False)
    raise ValueError(f"no reader for {suffix!r}")


def latest_artifact(root: str, pattern: str = "*.json") -> str | None:
    """The artifact with the latest version stamp in its name (name order, so the same on every machine)."""
    found = sorted((p for p in Path(root).glob(pattern) if not p.name.endswith(".metadata.json")), key=lambda p: p.stem.rsplit("_v", 1)[-1])
    return str(found[-1]) if found else None


_baselines: dict[str, Mapping] = {}


def baseline(root: str, default: Mapping | None = None) -> Mapping:
    """The latest baseline of a folder, remembered; the default if there is none."""
    path = latest_artifact(root, "*baseline_v*.json")
    if path is None:
        return default or {}
    if path not in _baselines:
        _baselines[path] = document(path)
    return _baselines[path]


def labelled(spark: SparkSession, path: str) -> DataFrame:
    return csv_inferred(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def config(path: str, default: Mapping | None = None) -> dict:
    """A configuration (JSON or YAML by suffix) over defaults; the defaults alone if there is none or it can't be read."""
    found: Mapping = {}
    p = Path(path)
    try:
        if p.exists() and p.suffix in (".yaml", ".yml"):
            import yaml

            found = yaml.safe_load(p.read_text()) or {}
        elif p.exists():
            found = json.loads(p.read_text())
    except (ImportError, ValueError) as error:
        raise ConfigError(f"{path}: {error}") from error
    return merged(dict(default or {}), found)


def merged(base: dict, over: Mapping) -> dict:
    """base with the values of over; nested ones are merged."""
    return base | {k: merged(dict(base[k]), v) if isinstance(v, Mapping) and isinstance(base.get(k), Mapping) else v for k, v in over.items()}


class EngineError(Exception):
    """Anything that this library raises for a reason of its own."""


class ConfigError(EngineError):
    pass


class DataError(EngineError):
    pass


def kafka_tail(spark: SparkSession, brokers: str, topic: str, n: int = 5, **options: str) -> DataFrame:
    """The first n messages of a topic, for a look at them."""
    return kafka(spark, brokers, topic, False, startingOffsets="earliest", **options).limit(n)


def kafka(spark: SparkSession, brokers: str, topic: str, streaming: bool = True, **options: str) -> DataFrame:
    """key, value, timestamp of a topic (needs Spark's Kafka connector)."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
    for k, v in options.items():
        reader = reader.option(k.replace("_", "."), v)
    return reader.load().select("key", "value", F.col("timestamp").alias("kafka_ts"))


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)
