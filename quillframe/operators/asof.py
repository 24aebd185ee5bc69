"""Joins on time: the last row before, and rows inside ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], columns: Sequence[str], ties: Sequence[str] = (), prefix: str = "last_", most: Column | None = None) -> DataFrame:
    """left with right's columns of the last row at or before each row's time, per key: one union and one window, no pairs.

    ``ties`` (columns of right) order right rows of one time; ``most`` is a condition on left's and the found time
    (``<prefix><on>``), beyond which nothing is found.
    """
    l = left.select(*by, F.col(on).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(on, *columns, *ties)).schema[0].dataType).alias("__r"))  # noqa: E741
    r = right.select(*by, F.col(on).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"), F.struct(on, *columns, *ties).alias("__r"))
    w = Window.partitionBy(*by).orderBy("__t", "__side", *(F.col(f"__r.{c}") for c in ties)).rowsBetween(Window.unboundedPreceding, 0)
    found = l.unionAll(r).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    out = found.select("__row.*", *(F.col(f"__r.{c}").alias(prefix + c) for c in (on, *columns)))
    return out if most is None else out.withColumns({prefix + c: F.when(most, F.col(prefix + c)) for c in columns})


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= at < high: both sides meet in cells of ``width``, a range in each cell that it touches."""
    cells = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("__cell", F.floor(F.col(at) / width)).join(cells, "__cell").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__cell")
