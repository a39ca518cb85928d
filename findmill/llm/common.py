"""Shared pieces of the training-data operators: tables, intermediate results and text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findmill.functions.text import fresh  # noqa: F401
from findmill.sources.store import work_path, written  # noqa: F401  (the operators take them from here)

SLICE_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, read by Spark (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(df: DataFrame) -> None:
    """Remove a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def utf8(text: Column) -> Column:
    """The bytes of a text; null counts as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def arrow_map(
    df: DataFrame, schema: str, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None]
) -> DataFrame:
    """Apply a function of one Arrow batch to slices of every batch; a task holds what one slice makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = per_batch(batch.slice(at, SLICE_ROWS))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def buffers(column: pa.Array) -> Iterator[bytes]:
    """The values of a binary column as bytes; null gives b''."""
    for value in column:
        yield value.as_py() or b""


HUB_ROWS, MOST_HUBS = 100, 10_000


def beside(rows: DataFrame, found: DataFrame, key: str, count: int) -> DataFrame:
    """``rows`` with the columns of ``found``, which has one row for a value of ``key``, and its ``degree``.

    Rows whose value is not in ``found`` go. A value is a hub if its degree, the number of its rows, is above HUB_ROWS and above one in MOST_HUBS of
    all ``count`` rows; so there are at most MOST_HUBS hubs. They are broadcast, and their rows are not dealt by
    the value; all other rows meet theirs in a shuffle.
    """
    most = max(HUB_ROWS, count // MOST_HUBS)
    values = [c for c in found.columns if c not in (key, "degree")]
    hub = found.where(F.col("degree") > most).select(key, F.lit(True).alias("_hub"), *(F.col(c).alias(f"_hub_{c}") for c in values))
    split = rows.join(F.broadcast(hub), key, "left")
    hot = split.where("_hub").select(*rows.columns, *(F.col(f"_hub_{c}").alias(c) for c in values))
    others = found.where(F.col("degree") <= most).drop("degree")
    return hot.union(split.where("_hub IS NULL").select(*rows.columns).join(others, key).select(*hot.columns))
