"""The same aggregations over an unbounded input, by Structured Streaming.

Datasets themselves are finite; these helpers run a reduce or a windowed count as a stream, so that a program can be
moved to arriving files without being rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import BUILT_IN


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def reduce_stream(rows: DataFrame, keys: list[str], value: str, fn: str) -> DataFrame:
    """Running reduce by key (use output mode ``complete`` or ``update``)."""
    return rows.groupBy(*keys).agg(BUILT_IN[fn](F.col(value)).alias(value))


def windowed_count(rows: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by time window and key; windows close once the watermark passes them."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def drain(rows: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now, into an in-memory table: for tests and small folders."""
    query = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.table(name)
