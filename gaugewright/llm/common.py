"""What the corpus operators share: the shared folder, written tables, Arrow batches, folds and samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_ID, TEXT = "doc_id", "text"
#: Tables that cut() wrote, for scratch().
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gaugewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: what follows no longer depends on how it was made.

    The table outlives the call since lazy results may read it; the folder is the cluster's to clean.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gaugewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the folder of a table, as cut() gave it, that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/gaugewright/" in folder:
            remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that cut() writes inside are removed at the end, but for the last one when it is given to keep()."""
    held = _written[:]
    _written.clear()

    def keep(df: DataFrame) -> DataFrame:
        _written.pop()
        return df

    try:
        yield keep
    finally:
        for path in _written:
            remove(spark, path)
        _written[:] = held


def matched(rows: DataFrame, table: DataFrame, key: str, by: Sequence[str], heavy: int = 1024) -> DataFrame:
    """rows with the column `of` of table (key, n, of), where n says how many rows have the key; rows whose key isn't there go.

    Keys with more than 1/heavy of all rows are fewer than `heavy`, so they are broadcast; their rows
    are spread (by these columns) over all tasks of the join, in which every other key has a small share.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * heavy > F.lit(total)
    some = rows.join(F.broadcast(table.where(frequent).select(key, F.col("of").alias("_of"))), key, "left")
    spread = F.pmod(F.xxhash64(*by), F.lit(1 << 20)).cast("int") + 1
    some = some.withColumn("_salt", F.when(F.col("_of").isNotNull(), spread).otherwise(0))
    out = some.join(table.where(~frequent).select(key, F.lit(0).alias("_salt"), "of"), [key, "_salt"], "left")
    return out.withColumn("of", F.coalesce("_of", "of")).where("of is not null").drop("_salt", "_of")


def release(spark: SparkSession) -> None:
    """Let the driver find out now which shuffles nothing refers to any more, so that executors delete their files.

    Spark does this by itself every 30 minutes; an operator that has cut its lineage needn't hold them so long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hand_back() -> None:
    """Memory that this worker has freed goes back to the system, where its allocator can do that: Spark keeps idle workers for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def two_columns(docs: DataFrame, id_col: str = DOC_ID, text_col: str = TEXT) -> DataFrame:
    """Only id and text, under fixed names: other columns, whatever their names, play no part."""
    return docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))


def column(df: DataFrame, name: str) -> Column:
    """A column of df by its whole name, dots and all."""
    return df[f"`{name}`"]


def map_batches(df: DataFrame, function: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str, arrays: bool = False) -> DataFrame:
    """mapInArrow with columns as Python lists (numeric ones without NULLs as numpy arrays if `arrays`), in and out."""
    names, types = df.columns, arrow_schema(schema)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in function({c: b.column(i).to_numpy(zero_copy_only=False) if arrays else b.column(i).to_pylist() for i, c in enumerate(names)} for b in stream):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in types], schema=types)

    return df.mapInArrow(batches, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def fold(id_column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % parts


def spread_sample(df: DataFrame, key: Column, stratum: Column, bound: int) -> DataFrame:
    """About bound rows of each stratum at most, the same on every run: those with small hashes of the key.

    The number of rows is binomial with that mean: twice as many don't occur. Strata are few (labels, languages); their counts cover all rows.
    """
    counts = {r[0]: r[1] for r in df.groupBy(stratum.alias("s")).count().collect()}
    grain = 1 << 30
    keep = F.lit(False)
    for value, n in counts.items():
        if value is not None:
            keep = keep | ((stratum == F.lit(value)) & (F.pmod(F.xxhash64(key, F.lit(7)), F.lit(grain)) < F.lit(min(grain, int(grain * bound / max(n, 1))))))
    return df.where(keep)
