"""Event-time windows. Each function takes a batch or a streaming frame; on streams a watermark bounds the state and drops what comes later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _marked(df: DataFrame, time: str, late: str | None) -> DataFrame:
    """With a watermark on streams; times without a zone are read in the session's."""
    if not (late and df.isStreaming):
        return df
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(df: DataFrame, time: str, width: str, by: Sequence[str], aggregates: Sequence[Column], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates for each window [start, end) and key; with ``slide`` the windows overlap."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = _marked(df, time, late).groupBy(window.alias("w"), *by).agg(*aggregates)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(c for c in out.columns if c != "w"))


def sessions(df: DataFrame, time: str, gap: str, by: Sequence[str], aggregates: Sequence[Column], late: str | None = None) -> DataFrame:
    """Aggregates for each stretch of a key's events without a pause of ``gap``."""
    out = _marked(df, time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*aggregates)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(c for c in out.columns if c != "w"))


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, in Parquet, and stop; the checkpoint makes it resume and never repeat a row."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
