"""Functions of a user's own: aggregates of pandas series, and functions that return tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def aggregate(function: Callable[..., float], kind: str = "double") -> Callable[..., Column]:
    """An aggregate of a function from series to a number, for ``agg`` and windows.

    Spark gathers all of a group for it, so it is for groups that fit in a task; what sums up belongs in columns.
    """

    def of(*series: pd.Series) -> float:
        return function(*series)

    of.__annotations__ = {"series": pd.Series, "return": float if kind in ("double", "float") else int}
    return F.pandas_udf(of, kind, F.PandasUDFType.GROUPED_AGG)


def table_function(spark: SparkSession, name: str, function: Callable, schema: str) -> Callable:
    """Registers a function that yields rows of a schema, for LATERAL joins in SQL; returns it for use on columns."""

    class Rows:
        def eval(self, *values):
            yield from function(*values)

    made = F.udtf(Rows, returnType=schema)
    spark.udtf.register(name, made)
    return made
