"""Joins of two streams within a time, and sources for trying them out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, ahead: str, back: str = "0 seconds", late: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Pairs of one key whose right time lies from ``back`` before the left time to ``ahead`` after it.

    On streams both sides get a watermark of ``late``, so the state of a row goes when nothing can meet it any more;
    left outer joins then return it without a partner. Columns of both sides must have different names, but for ``by``.
    """
    marked = lambda df, time: df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if df.isStreaming else df
    keys = [f"__right_{c}" for c in by]
    a, b = marked(left, left_time), marked(right, right_time).withColumnsRenamed(dict(zip(by, keys, strict=True)))
    same = " AND ".join(f"`{c}` = `{k}`" for c, k in zip(by, keys, strict=True))
    near = f"`{right_time}` >= `{left_time}` - INTERVAL {back} AND `{right_time}` <= `{left_time}` + INTERVAL {ahead}"
    return a.join(b, F.expr(f"{same} AND {near}" if same else near), how).drop(*keys)


def rate(spark: SparkSession, rows_a_second: int = 10) -> DataFrame:
    """An endless stream of (timestamp, value) rows."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_a_second).load()


def kafka(spark: SparkSession, servers: str, topic: str, start: str = "earliest", most: int = 1_000_000) -> DataFrame:
    """A topic as a stream of (key, value, topic, partition, offset, timestamp); Spark's Kafka package must be on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start, "maxOffsetsPerTrigger": most}
    return spark.readStream.format("kafka").options(**options).load()
