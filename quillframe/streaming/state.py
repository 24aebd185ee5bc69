"""State kept by key over a stream, for what windows cannot express."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) after each batch that brings rows of a key; on a batch frame, once for all rows.

    State is two numbers a key. Its store is checkpointed with the stream, so a lost executor's keys move on.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    if not df.isStreaming:
        return rows.groupBy("k").agg(F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total")).withColumnRenamed("k", key)

    def add(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["v"].sum())
        state.update((n, total))
        yield pd.DataFrame({"k": [k[0]], "n": [n], "total": [total]})

    found = rows.groupBy("k").applyInPandasWithState(add, f"k {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
    return found.withColumnRenamed("k", key)


def distinct_by_watermark(df: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key; on streams the state of a key goes when the watermark passes it."""
    if not df.isStreaming:
        return df.dropDuplicates(keys)
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
