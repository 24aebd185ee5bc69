"""Grouping: every aggregate asked for in one pass, with partial results on the map side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.errors import InvalidParameterError
from quillframe.functions import quantiles
from quillframe.plans import ordering

NAN = float("nan")


def finite(value: Column) -> Column:
    """value where it is a finite number, else null."""
    wide = value.cast("double")
    return F.when(~F.isnan(wide) & (F.abs(wide) < float("inf")), value)


def _or_nan(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(NAN))


class Grouped:
    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], numeric: Sequence[str]):
        self.df, self.keys, self.order, self.numeric = df, list(keys), list(order), list(numeric)

    def _functions(self) -> dict[str, Callable[[str], Column]]:
        at = F.struct(*self.order) if self.order else None
        return {
            "sum": lambda c: F.coalesce(F.sum(finite(F.col(c))), F.lit(0)),
            "mean": lambda c: _or_nan(F.avg(finite(F.col(c)))),
            "median": lambda c: _or_nan(F.median(finite(F.col(c)))),
            "min": lambda c: _or_nan(F.min(finite(F.col(c)))),
            "max": lambda c: _or_nan(F.max(finite(F.col(c)))),
            "std": lambda c: _or_nan(F.stddev_samp(finite(F.col(c)))),
            "var": lambda c: _or_nan(F.var_samp(finite(F.col(c)))),
            "count": lambda c: F.count(c),
            "first": lambda c: F.min_by(c, at) if at is not None else F.first(c),
            "last": lambda c: F.max_by(c, at) if at is not None else F.last(c),
        }

    def agg(self, wanted: dict[str, str | Sequence[str]]) -> DataFrame:
        """Keys and aggregates: column -> name keeps the column's name, column -> names makes column_name."""
        functions, out, medians = self._functions(), [], {}
        hot = any("median" in ([names] if isinstance(names, str) else names) for names in wanted.values()) and ordering.is_hot(self.df, self.keys)
        for column, names in wanted.items():
            for name in [names] if isinstance(names, str) else names:
                if name not in functions:
                    raise InvalidParameterError(f"unknown aggregate {name!r}", "agg", name)
                alias = column if isinstance(names, str) else f"{column}_{name}"
                if name == "median" and hot:
                    medians[alias] = column
                out.append((F.lit(None) if name == "median" and hot else functions[name](column)).alias(alias))
        found = self.df.groupBy(*self.keys).agg(*out)
        for alias, column in medians.items():  # of groups too large for a task: by counted values, a join each
            own = quantiles.grouped(self.df, self.keys, finite(F.col(column)), (0.5,), ("__median",)).withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(self.keys)})
            same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)]
            found = found.join(own, same).withColumn(alias, _or_nan(F.col("__median"))).drop("__median", *(f"__k{i}" for i in range(len(self.keys))))
        return found

    def _all(self, name: str) -> DataFrame:
        return self.agg(dict.fromkeys(self.numeric, name))

    def sum(self) -> DataFrame:
        return self._all("sum")

    def mean(self) -> DataFrame:
        return self._all("mean")

    def median(self) -> DataFrame:
        return self._all("median")

    def min(self) -> DataFrame:
        return self._all("min")

    def max(self) -> DataFrame:
        return self._all("max")

    def std(self) -> DataFrame:
        return self._all("std")

    def var(self) -> DataFrame:
        return self._all("var")

    def count(self) -> DataFrame:
        return self.agg({c: "count" for c in self.df.columns if c not in self.keys})
