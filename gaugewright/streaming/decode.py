"""Message decoding: tolerant JSON, and report messages to rows.

A payload is parsed once, into a variant; the message's structure is read from that. Values may be
objects or bare numbers, so they stay variants until they are picked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.sources.readers import CELL, CELL_FIELDS, UE, UE_FIELDS

_NAMES = "measInfoList:array<struct<measType:struct<measName:string,measTypeName:string>>>"
_RECORD = "measRecord:array<variant>"
#: The parts of a message that are read.
MESSAGE = (
    "struct<metadata:struct<event_ts_ms:variant,entity:string>,"
    f"`indicationMessage-Format1`:struct<{_NAMES},measData:array<struct<metadata:struct<cell_name:string,band:string>,{_RECORD}>>>,"
    f"`indicationMessage-Format3`:struct<{_NAMES},ueMeasData:array<struct<ueID:struct<`gNB-UEID`:struct<`amf-UE-NGAP-ID`:string>>,measReport:struct<measReportList:array<struct<{_RECORD}>>>>>>>"
)


def payload(value: Column, strict: bool = True) -> Column:
    """The JSON document in a binary payload, as a variant; NULL if there is none.

    A 4-byte length in front is skipped, as is what stands before the first brace and after the last. Where
    the whole is no document, the first line that is one counts. strict gives NULL for bytes that aren't
    UTF-8; else they are replaced.
    """
    first = F.substring(value, 1, 1)
    body = F.when(first.isin(bytearray(b"{"), bytearray(b"[")), value).otherwise(F.substring(value, 5, 1 << 30))
    text = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")) if strict else F.make_valid_utf8(body.cast("string"))
    found = F.nullif(F.regexp_extract(text, r"(?s)[\{\[].*[\}\]]", 0), F.lit(""))
    lines = F.filter(F.transform(F.split(found, "\n"), lambda x: F.try_parse_json(x)), lambda x: x.isNotNull())
    return F.coalesce(F.try_parse_json(found), F.get(lines, 0))


def decode(df: DataFrame, value: str = "value", strict: bool = True) -> DataFrame:
    """Messages as structs; those that can't be read, or have no event time, go (see dead_letters)."""
    return read(df, value, strict).where(F.col("event_ts").isNotNull())


def read(df: DataFrame, value: str = "value", strict: bool = True) -> DataFrame:
    """df with message and event_ts. As an outer generator, so that no filter, given or inferred, goes below it and reads the payload again."""
    parsed = F.transform(F.array(payload(F.col(value), strict)), lambda v: F.try_variant_get(v, "$", MESSAGE))
    at = lambda m: F.timestamp_millis(F.try_variant_get(m["metadata"]["event_ts_ms"], "$", "bigint"))
    return df.select("*", F.inline_outer(F.transform(parsed, lambda m: F.struct(m.alias("message"), at(m).alias("event_ts")))))


def dead_letters(df: DataFrame, value: str = "value", strict: bool = True) -> DataFrame:
    """The messages that decode() leaves out, with why: unreadable, or without an event time."""
    out = read(df, value, strict).where(F.col("event_ts").isNull())
    return out.withColumn("problem", F.when(F.col("message").isNull(), "unreadable").otherwise("no event time")).drop("message", "event_ts")


def picked(record: Column) -> Column:
    """real, integer or measValue, the first that isn't 0, or a bare number; else 0."""
    of = lambda path: F.try_variant_get(record, path, "double")
    return F.coalesce(F.nullif(of("$.real"), F.lit(0.0)), F.nullif(of("$.integer"), F.lit(0.0)), of("$.measValue"), of("$"), F.lit(0.0))


def names_of(infos: Column) -> Column:
    """The names of a message, those that are none left out."""
    given = F.transform(infos, lambda x: F.coalesce(F.nullif(x["measType"]["measName"], F.lit("")), x["measType"]["measTypeName"]))
    return F.filter(F.coalesce(given, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def with_fields(df: DataFrame, names: str, records: str, known: Sequence[str]) -> DataFrame:
    """The value of each known name, by place, for the two array columns; the shorter of both ends them, and of equal names the last counts."""
    n = F.least(F.size(names), F.size(records))
    df = df.select(*[f"`{c}`" for c in df.columns if c not in (names, records)], F.reverse(F.slice(names, 1, n)).alias("_names"), F.reverse(F.transform(F.slice(records, 1, n), picked)).alias("_values"))
    return df.select(*[f"`{c}`" for c in df.columns if not c.startswith("_")], *[F.get("_values", F.nullif(F.array_position("_names", name), F.lit(0)).cast("int") - 1).alias(name) for name in known])


def cell_rows(decoded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each measurement record of a cell message, with its band; metrics that aren't known go."""
    m = decoded.withColumn("m", F.col("message.`indicationMessage-Format1`")).select(*keep, "event_ts", names_of(F.col("m.measInfoList")).alias("names"), F.explode("m.measData").alias("d"))
    m = m.select(*keep, "event_ts", "names", F.col("d.metadata.cell_name").alias(CELL), F.col("d.metadata.band").alias("band"), F.coalesce("d.measRecord", F.array().cast("array<variant>")).alias("r"))
    return with_fields(m.withColumnRenamed("event_ts", "timestamp"), "names", "r", CELL_FIELDS)


def ue_rows(decoded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each UE of a message that holds no cell reports, its reports' records one after another."""
    m = decoded.where("message.`indicationMessage-Format1`.measInfoList is null and message.`indicationMessage-Format1`.measData is null")
    m = m.withColumn("m", F.col("message.`indicationMessage-Format3`")).select(*keep, "event_ts", names_of(F.col("m.measInfoList")).alias("names"), F.explode("m.ueMeasData").alias("u"))
    records = F.flatten(F.filter(F.transform("u.measReport.measReportList", lambda r: r["measRecord"]), lambda r: r.isNotNull()))
    m = m.select(*keep, "event_ts", "names", F.col("u.ueID.gNB-UEID.amf-UE-NGAP-ID").alias(UE), F.coalesce(records, F.array().cast("array<variant>")).alias("r"))
    return with_fields(m.withColumnRenamed("event_ts", "timestamp"), "names", "r", UE_FIELDS)


def normalised_rows(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Messages that carry their rows already."""
    rows = F.try_variant_get(payload(F.col(value)), "$.normalized_rows", f"array<struct<{schema}>>")
    return df.select(rows.alias("m")).select(F.inline("m"))
