"""A frame: a Spark DataFrame with the columns that order it.

Only what depends on the position of rows uses the order, which must be total (a unique key at its end). Everything is
lazy; nothing is gathered on the driver but schemas, samples for bounds, and what ``to_*`` methods are asked for.
Missing values: null and NaN are both missing for cleaning; statistics skip both and infinite values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.errors import DataValidationError, InvalidParameterError, PositionError
from quillframe.functions.quantiles import quantiles
from quillframe.operators.grouped import Grouped, finite
from quillframe.plans import ordering

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FRACTIONAL = (T.FloatType, T.DoubleType)


class Frame:
    def __init__(self, df: DataFrame, order: Sequence[str] = (), sorted_by: Sequence[tuple[str, bool]] = ()):
        """sorted_by: columns and whether they ascend, by which rows stand before the order columns decide."""
        if len(set(df.columns)) != len(df.columns):
            raise DataValidationError("duplicate column names")
        self.df, self.order, self.sorted_by = df, list(order), list(sorted_by)
        #: the rows of a sorted df before the sort, and an order with the bounds of its buckets: both for what runs along the order
        self._loose: DataFrame | None = None
        self._cuts: tuple[list[str], list[tuple]] | None = None

    # -- shape and access -------------------------------------------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.columns)

    def __getitem__(self, name: str) -> Frame:
        return self.select([name])

    def _with(self, df: DataFrame, order: Sequence[str] | None = None) -> Frame:
        kept = self.sorted_by if order is None and all(c in df.columns for c, _ in self.sorted_by) else ()
        return Frame(df, [c for c in (self.order if order is None else order) if c in df.columns], kept)

    def _places(self) -> tuple[DataFrame, list[str]]:
        """The table with columns that ascend as its rows stand, and their names."""
        made: dict[str, Column] = {}
        for i, (name, ascending) in enumerate(self.sorted_by):
            own, kind = F.col(name), self._type(name)
            missing = F.when(own.isNull(), 2)
            made[f"__last{i}"] = (missing.when(F.isnan(own), 1) if isinstance(kind, FRACTIONAL) else missing).otherwise(0)
            if ascending:
                made[f"__key{i}"] = own
            elif isinstance(kind, NUMERIC):
                made[f"__key{i}"] = -own
            elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                made[f"__key{i}"] = -(F.unix_date(own) if isinstance(kind, T.DateType) else F.unix_micros(own.cast("timestamp")))
            else:  # the bytes of a text turned round; a digit beyond theirs ends it, as a longer text comes first
                made[f"__key{i}"] = F.concat(F.translate(F.hex(own.cast("string")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
        rest = [c for c in self.order if c not in [n for n, _ in self.sorted_by]]
        df = self.df if self._loose is None else self._loose
        return df.withColumns(made) if made else df, [*made, *rest]

    def _bounds(self, df: DataFrame, order: list[str]) -> list[tuple]:
        """Of the buckets of what _places gave; found once for frames of the same rows."""
        if self._cuts is None or self._cuts[0] != order:
            self._cuts = order, ordering.bounds_of(df, order)
        return self._cuts[1]

    def _same_rows(self, df: DataFrame, changed: str) -> Frame:
        """A frame of the same rows, whose order stays if the changed column has no part in it."""
        out = self._with(df)
        if changed not in [*self.order, *(n for n, _ in self.sorted_by)]:
            out._cuts = self._cuts
        return out

    def _known(self, names: Sequence[str]) -> None:
        for n in names:
            if n not in self.columns:
                raise InvalidParameterError(f"no column {n!r}", "columns", n)

    def _type(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def _numeric(self, names: Sequence[str] | None = None) -> list[str]:
        return [c for c in (names or self.columns) if isinstance(self._type(c), NUMERIC)]

    def _missing(self, name: str) -> Column:
        own = F.col(name)
        return own.isNull() | F.isnan(own) if isinstance(self._type(name), FRACTIONAL) else own.isNull()

    def ordered(self) -> DataFrame:
        df, order = self._places()
        return df.orderBy(*ordering.ascending(order)).select(*self.columns) if order else df

    def loc(self, label: object, index: str) -> Frame:
        self._known([index])
        return self._with(self.df.where(F.col(index) == F.lit(label)))

    def iloc(self, position: int) -> Frame:
        """The row at a position; none beyond the end."""
        if position < 0:
            raise PositionError(f"position {position} is negative")
        df, order = self._places()
        return self._with(ordering.numbered(df, order).where(F.col(ordering.ORD) == position).select(*self.columns))

    def head(self, n: int = 5) -> Frame:
        if n < 0:
            raise InvalidParameterError("n must not be negative", "n", n)
        return self._with(self.ordered().limit(n))

    def tail(self, n: int = 5) -> Frame:
        """The last n rows, all of a shorter frame."""
        if n < 0:
            raise InvalidParameterError("n must not be negative", "n", n)
        df, order = self._places()
        return self._with(df.orderBy(*(F.col(c).desc_nulls_last() for c in order)).limit(n).select(*self.columns))

    def set_index(self, name: str) -> Frame:
        """The frame ordered by a column, whose values must be unique: a row beside its double is an error when read."""
        self._known([name])
        twice = self.df.groupBy(name).agg(F.count("*").alias("__n")).where("__n > 1").limit(1)
        if not twice.isEmpty():
            raise DataValidationError(f"values of {name} repeat")
        return Frame(self.df, [name])

    def get(self, name: str, kind: type[T.DataType] | None = None) -> Series:
        """One column; with a kind, an error unless it has that type."""
        self._known([name])
        if kind is not None and not isinstance(self._type(name), kind):
            raise DataValidationError(f"{name} is {self._type(name).simpleString()}")
        return Series(self, name)

    def to_arrays(self, into: str = "v", names: Sequence[str] | None = None) -> Frame:
        """One array of doubles a row, beside the order columns; null is NaN."""
        chosen = names or [c for c in self._numeric() if c not in self.order]
        row = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in chosen))
        return self._with(self.df.select(*self.order, row.alias(into)))

    @staticmethod
    def from_arrays(df: DataFrame, name: str, width: int, columns: Sequence[str] | None = None, order: Sequence[str] = ()) -> Frame:
        """A column for each place of an array column: col0, col1, ... or the given names."""
        names = list(columns or (f"col{i}" for i in range(width)))
        return Frame(df.select(*order, *(F.get(name, i).alias(c) for i, c in enumerate(names))), order)

    def to_rows(self) -> list[tuple]:
        """All rows in order, on the driver: for results that fit there."""
        return [tuple(r) for r in self.ordered().collect()]

    def text(self, most: int = 20) -> str:
        """The first rows as a table of text."""
        return self.ordered()._show_string(most, False)

    # -- projection, filters, cleaning ------------------------------------------------------------------------------

    def select(self, names: Sequence[str]) -> Frame:
        self._known(names)
        return self._with(self.df.select(*names))

    def drop(self, names: Sequence[str]) -> Frame:
        self._known(names)
        if len(set(names)) != len(names):
            raise InvalidParameterError("a column is named twice", "columns", names)
        return self._with(self.df.drop(*names))

    def filter(self, predicate: Column | str) -> Frame:
        return self._with(self.df.where(predicate))

    def rename(self, mapper: dict[str, str] | Callable[[str], str]) -> Frame:
        new = {c: (mapper(c) if callable(mapper) else mapper.get(c, c)) for c in self.columns}
        if len(set(new.values())) != len(new):
            raise DataValidationError("renaming makes duplicate columns")
        return Frame(self.df.withColumnsRenamed(new), [new[c] for c in self.order], [(new[c], up) for c, up in self.sorted_by])

    def reset_index(self, name: str = "index") -> Frame:
        """A first column with the position of each row."""
        while name in self.columns:
            name += "_1"
        df, order = self._places()
        return self._same_rows(ordering.numbered(df, order, name, bounds=self._bounds(df, order)).select(name, *self.columns), name)

    def isnull(self) -> Frame:
        return self._with(self.df.select(*(F.col(c).isNull().alias(c) for c in self.columns)), [])

    def notnull(self) -> Frame:
        return self._with(self.df.select(*(F.col(c).isNotNull().alias(c) for c in self.columns)), [])

    def fillna(self, value: object) -> Frame:
        """value for null and NaN, in every column that can hold it: a column keeps its type, so text never fills numbers nor numbers text."""
        text = isinstance(value, str)
        fits = lambda c: isinstance(self._type(c), T.StringType) if text else isinstance(self._type(c), (T.BooleanType,) if isinstance(value, bool) else NUMERIC)
        return self._with(self.df.select(*(F.when(self._missing(c), F.lit(value).cast(self._type(c))).otherwise(F.col(c)).alias(c) if fits(c) else F.col(c) for c in self.columns)))

    def dropna(self, names: Sequence[str] | None = None) -> Frame:
        return self._with(self.df.where(~reduce(Column.__or__, (self._missing(c) for c in names or self.columns))))

    def replace(self, old: object | Sequence[object], new: object, names: Sequence[str] | None = None) -> Frame:
        """new in place of any of old, in the columns (those of old's type, by default) that can be compared with it."""
        olds = list(old) if isinstance(old, (list, tuple, set)) else [old]
        kind = T.StringType if isinstance(olds[0], str) else T.BooleanType if isinstance(olds[0], bool) else NUMERIC
        chosen = names or [c for c in self.columns if isinstance(self._type(c), kind)]
        return self._with(self.df.withColumns({c: F.when(F.col(c).isin(olds), F.lit(new).cast(self._type(c))).otherwise(F.col(c)) for c in chosen}))

    def clip(self, lower: float | None = None, upper: float | None = None, names: Sequence[str] | None = None) -> Frame:
        def one(c: str) -> Column:
            own, out = F.col(c), F.col(c)
            if upper is not None:
                out = F.when(own > upper, F.when(F.isnan(own.cast("double")), own).otherwise(F.lit(upper).cast(self._type(c)))).otherwise(out)
            return F.when(own < lower, F.lit(lower).cast(self._type(c))).otherwise(out) if lower is not None else out

        return self._with(self.df.withColumns({c: one(c) for c in self._numeric(names)}))

    def drop_duplicates(self, subset: Sequence[str] | None = None, keep: str | bool = "first") -> Frame:
        """One row of each group of equal rows, the first or last in order; with keep=False only rows without equals.

        An aggregation with partial results on the map side: a hot key is one row a task.
        """
        keys = list(subset or self.columns)
        self._known(keys)
        if keep not in ("first", "last", False):
            raise InvalidParameterError("keep is first, last or False", "keep", keep)
        row, at = F.struct(*self.columns), F.struct(*(self.order or self.columns))
        pick = F.max_by(row, at) if keep == "last" else F.min_by(row, at)
        found = self.df.groupBy(*(F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys))).agg(pick.alias("__row"), F.count("*").alias("__n"))
        return self._with((found if keep else found.where("__n = 1")).select("__row.*"))

    def duplicated(self, subset: Sequence[str] | None = None, keep: str | bool = "first", into: str = "duplicated") -> Frame:
        """The frame with a flag for rows that drop_duplicates would drop; a join, whose hot keys Spark can split."""
        keys = list(subset or self.columns)
        at = F.struct(*self.order)
        pick = F.max(at) if keep == "last" else F.min(at)
        found = self.df.groupBy(*(F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys))).agg(pick.alias("__at"), F.count("*").alias("__n"))
        on = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__k_{i}")) for i, k in enumerate(keys)))
        flag = F.col("__n") > 1 if keep is False else ~at.eqNullSafe(F.col("__at"))
        return self._with(self.df.join(found, on).withColumn(into, flag).select(*self.columns, into))

    def sample(self, n: int, seed: int = 0) -> Frame:
        """n rows, those with the smallest hashes of the order columns and the seed: the same at any partitioning."""
        return self._with(self.df.orderBy(F.xxhash64(*self.order, F.lit(seed)), *self.order).limit(n))

    def apply(self, function: Callable, schema: str | T.StructType | None = None, axis: int | None = None, into: str = "result") -> Frame:
        """axis 0: function, from a column to an aggregate, of each numeric column; axis 1: function, from an array column to a column, of each row's numbers; with a schema, function over pandas batches of rows, for what columns cannot express."""
        numbers = [c for c in self._numeric() if c not in self.order]
        if axis == 0:
            return Frame(self.df.agg(*(function(F.col(c)).alias(c) for c in numbers)))
        if axis == 1:
            return self._with(self.df.withColumn(into, function(F.array(*(F.col(c).cast("double") for c in numbers)))))
        if schema is None:
            raise InvalidParameterError("an axis or a schema is needed", "axis", axis)
        return Frame(self.df.mapInPandas(lambda batches: map(function, batches), schema), [])

    # -- joins and sets ---------------------------------------------------------------------------------------------

    def join(self, other: Frame, on: str, how: str = "inner") -> Frame:
        return self.merge(other, on=on, how=how, suffixes=("_left", "_right"))

    def merge(self, other: Frame, on: str | Sequence[str] | None = None, left_on: str | None = None, right_on: str | None = None, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> Frame:
        """Equi-join. A shared key is one column, from the right for rows without a left; keys of two names are both kept.

        Beyond the four usual kinds, semi, anti and cross are Spark's own.
        """
        if how in ("cross",):
            return Frame(self.df.crossJoin(other.df))
        lefts = [on] if isinstance(on, str) else list(on) if on else [left_on]
        rights = lefts if on else [right_on]
        self._known(lefts)
        other._known(rights)
        shared = [a for a, b in zip(lefts, rights, strict=True) if a == b]
        left = self.df.select(*(F.col(c).alias(f"__l_{c}") for c in self.columns))
        right = other.df.select(*(F.col(c).alias(f"__r_{c}") for c in other.columns))
        match = reduce(Column.__and__, (F.col(f"__l_{a}") == F.col(f"__r_{b}") for a, b in zip(lefts, rights, strict=True)))
        how = {"outer": "full_outer", "semi": "left_semi", "anti": "left_anti"}.get(how, how)
        joined = left.join(right, match, how)
        if how in ("left_semi", "left_anti"):
            return self._with(joined.select(*(F.col(f"__l_{c}").alias(c) for c in self.columns)))
        both = {c for c in self.columns if c in other.columns and c not in shared}
        out, used = [], set()

        def add(value: Column, name: str) -> None:
            base, k = name, 0
            while name in used:
                k += 1
                name = f"{base}_{k}"
            used.add(name)
            out.append(value.alias(name))

        for c in self.columns:
            own = F.col(f"__l_{c}")
            add(F.coalesce(own, F.col(f"__r_{c}")) if c in shared else own, c + suffixes[0] if c in both else c)
        for c in other.columns:
            if c not in shared:
                add(F.col(f"__r_{c}"), c + suffixes[1] if c in both else c)
        return self._with(joined.select(*out))

    def concat(self, other: Frame, axis: int = 0, index: str | None = None) -> Frame:
        """axis 0: all rows of both, by column name; axis 1: columns side by side, all rows of both matched by the labels of ``index``, or by position."""
        if axis == 0:
            if set(self.columns) != set(other.columns):
                raise DataValidationError("the frames have different columns")
            return self._with(self.df.unionByName(other.df))
        if index is not None:
            self._known([index])
            other._known([index])
            if (twice := self.df.groupBy(index).count().where("count > 1").limit(1).count()) or other.df.groupBy(index).count().where("count > 1").limit(1).count():
                raise DataValidationError(f"labels of the {'first' if twice else 'second'} frame repeat")
            return self.join(other, index, "outer")
        left, right = self.reset_index("__at"), other.reset_index("__at")
        return left.join(right, "__at", "outer").drop(["__at"])

    def union(self, other: Frame) -> Frame:
        return self.concat(other).drop_duplicates()

    def intersect(self, other: Frame) -> Frame:
        return self._with(self.df.intersect(other.df.select(*self.columns)))

    def subtract(self, other: Frame) -> Frame:
        return self._with(self.df.subtract(other.df.select(*self.columns)))

    # -- order and groups -------------------------------------------------------------------------------------------

    def sort(self, by: str | Sequence[str], ascending: bool = True) -> Frame:
        """All keys in one direction; NaN, then null, last in both; ties in the frame's order. Positions, heads and tails follow."""
        keys = [by] if isinstance(by, str) else list(by)
        self._known(keys)
        columns = []
        for k in keys:
            own = F.col(k)
            if isinstance(self._type(k), FRACTIONAL):
                columns.append(F.when(own.isNull(), 2).when(F.isnan(own), 1).otherwise(0))
            columns.append(own.asc_nulls_last() if ascending else own.desc_nulls_last())
        again = Frame(self.df, self.order, [*((k, ascending) for k in keys), *(x for x in self.sorted_by if x[0] not in keys)])
        before, order = Frame(self.df, self.order, again.sorted_by[len(keys) :])._places()
        again._loose = before.select(*self.columns)
        again.df = before.orderBy(*columns, *ordering.ascending([c for c in order if c not in keys])).select(*self.columns)
        return again

    def group_by(self, by: str | Sequence[str]) -> Grouped:
        keys = [by] if isinstance(by, str) else list(by)
        self._known(keys)
        return Grouped(self.df, keys, self.order, [c for c in self._numeric() if c not in keys])

    def unique(self, name: str) -> DataFrame:
        """The distinct values, in order of first appearance."""
        return self.df.groupBy(name).agg(F.min(F.struct(*self.order)).alias("__at")).orderBy("__at").select(name)

    def value_counts(self, name: str) -> DataFrame:
        found = self.df.groupBy(name).agg(F.count("*").alias("count"), F.min(F.struct(*self.order)).alias("__at"))
        return found.orderBy(F.col("count").desc(), "__at").select(name, "count")

    # -- statistics -------------------------------------------------------------------------------------------------

    def describe(self, names: Sequence[str] | None = None) -> DataFrame:
        """count, mean, std, min, quartiles and max of finite values, a row a metric: one aggregation beside the quartiles."""
        chosen = self._numeric(names)
        quartiles = quantiles(self.df, {c: finite(F.col(c)) for c in chosen}, (0.25, 0.5, 0.75))
        parts = []
        for c in chosen:
            v = finite(F.col(c))
            q = [F.lit(x).cast("double") for x in quartiles[c]]
            parts.append(F.array(F.count(v).cast("double"), F.avg(v), F.stddev_samp(v), F.min(v).cast("double"), *q, F.max(v).cast("double")).alias(c))
        metrics = F.array(*map(F.lit, ("count", "mean", "std", "min", "25%", "50%", "75%", "max")))
        one = self.df.agg(*parts)
        zipped = F.explode(F.arrays_zip(metrics.alias("metric"), *(F.col(c) for c in chosen))).alias("z")
        return one.select(zipped).select(F.col("z.metric").alias("metric"), *(F.col(f"z.{c}").alias(c) for c in chosen))

    def quantile(self, q: float, names: Sequence[str] | None = None) -> DataFrame:
        if not 0 <= q <= 1:
            raise InvalidParameterError("q lies between 0 and 1", "q", q)
        found = quantiles(self.df, {c: finite(F.col(c)) for c in self._numeric(names)}, (q,))
        return self.df.sparkSession.createDataFrame([tuple(v[0] for v in found.values())], ", ".join(f"`{c}` double" for c in found))

    def _pairs(self, names: Sequence[str], value: Callable[[Column, Column], Column]) -> DataFrame:
        """A long matrix (row, col, value) of pairwise complete statistics: one aggregation of the upper half."""
        cells = []
        for i, a in enumerate(names):
            for b in names[i:]:
                x, y = finite(F.col(a)), finite(F.col(b))
                both = x.isNotNull() & y.isNotNull()
                cells.append((a, b, value(F.when(both, x), F.when(both, y))))
        one = self.df.agg(*(v.alias(f"c{k}") for k, (_, _, v) in enumerate(cells)))
        rows = [F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"c{k}").alias("value")) for k, (a, b, _) in enumerate(cells)]
        rows += [F.struct(F.lit(b).alias("row"), F.lit(a).alias("col"), F.col(f"c{k}").alias("value")) for k, (a, b, _) in enumerate(cells) if a != b]
        return one.select(F.inline(F.array(*rows)))

    def corr(self, names: Sequence[str] | None = None) -> DataFrame:
        def one(x: Column, y: Column) -> Column:
            spread = F.when((F.count(x) > 1) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y)))
            return F.coalesce(spread, F.lit(float("nan")))

        return self._pairs(self._numeric(names), one)

    def cov(self, names: Sequence[str] | None = None) -> DataFrame:
        return self._pairs(self._numeric(names), F.covar_samp)

    # -- positional windows -----------------------------------------------------------------------------------------

    def rank(self, name: str, method: str = "average", ascending: bool = True, into: str = "rank") -> Frame:
        """The rank of each finite value; null for others. Distinct values are counted first, then numbered in order."""
        if method not in ("average", "min", "max", "first", "dense"):
            raise InvalidParameterError("unknown rank method", "method", method)
        v = finite(F.col(name))
        signed = v if ascending else -v
        rows = self.df.withColumn("__v", signed)
        if method == "first":
            at = ordering.numbered(rows.where("__v is not null"), ["__v", *self.order], into).withColumn(into, (F.col(into) + 1).cast("double"))
            return self._with(at.select(*self.columns, into).unionByName(rows.where("__v is null").select(*self.columns, F.lit(None).cast("double").alias(into))))
        seen = rows.where("__v is not null").groupBy("__v").agg(F.count("*").alias("__n"))
        seen = ordering.running(seen, ["__v"], {"__upto": (F.col("__n"), "sum"), "__dense": (F.lit(1), "count")})
        rank = {"min": F.col("__upto") - F.col("__n") + 1, "max": F.col("__upto"), "average": F.col("__upto") - (F.col("__n") - 1) / 2, "dense": F.col("__dense")}[method]
        ranked = rows.join(seen.select("__v", rank.cast("double").alias(into)), "__v", "left")
        return self._with(ranked.select(*self.columns, into))

    def _around(self, back: int, ahead: int, columns: Callable, partition_by: Sequence[str]) -> Frame:
        df, order = self._places()
        return self._with(ordering.around(df, order, back, ahead, columns, partition_by).drop(*(c for c in order if c not in self.columns)))

    def shift(self, name: str, periods: int = 1, fill: object = None, into: str = "shifted", partition_by: Sequence[str] = ()) -> Frame:
        move = F.lag if periods >= 0 else F.lead
        return self._around(max(periods, 0), max(-periods, 0), lambda w: {into: move(name, abs(periods), fill).over(w)}, partition_by)

    def diff(self, name: str, periods: int = 1, into: str = "diff", partition_by: Sequence[str] = ()) -> Frame:
        return self._around(periods, 0, lambda w: {into: F.col(name) - F.lag(name, periods).over(w)}, partition_by)

    def pct_change(self, name: str, periods: int = 1, into: str = "pct_change", partition_by: Sequence[str] = ()) -> Frame:
        def columns(w):
            before = F.lag(name, periods).over(w)
            return {into: F.when(before != 0, (F.col(name) - before) / before)}

        return self._around(periods, 0, columns, partition_by)

    def rolling_mean(self, name: str, window: int, into: str = "rolling_mean", partition_by: Sequence[str] = ()) -> Frame:
        """Mean of the finite values of the last ``window`` rows; null before there are as many rows."""

        def columns(w):
            frame = w.rowsBetween(-(window - 1), 0)
            return {into: F.when(F.count(F.lit(1)).over(frame) == window, F.avg(finite(F.col(name))).over(frame))}

        return self._around(window - 1, 0, columns, partition_by)

    def _running(self, name: str, how: str, into: str, partition_by: Sequence[str]) -> Frame:
        value = F.col(name)
        df, order = self._places()
        done = ordering.running(df, order, {into: (value, how), "__nan": (F.isnan(value.cast("double")).cast("int"), "max")}, partition_by, bounds=None if partition_by else self._bounds(df, order))
        out = F.when(F.col(name).isNull(), None).when((F.col("__nan") == 1), F.lit(float("nan"))).otherwise(F.col(into)) if isinstance(self._type(name), FRACTIONAL) else F.when(value.isNotNull(), F.col(into))
        return self._same_rows(done.withColumn(into, out).drop("__nan", *(c for c in order if c not in self.columns)), into)

    def cumsum(self, name: str, into: str = "cumsum", partition_by: Sequence[str] = ()) -> Frame:
        return self._running(name, "sum", into, partition_by)

    def cumprod(self, name: str, into: str = "cumprod", partition_by: Sequence[str] = ()) -> Frame:
        return self._running(name, "product", into, partition_by)

    def cummax(self, name: str, into: str = "cummax", partition_by: Sequence[str] = ()) -> Frame:
        return self._running(name, "max", into, partition_by)

    def cummin(self, name: str, into: str = "cummin", partition_by: Sequence[str] = ()) -> Frame:
        return self._running(name, "min", into, partition_by)

    # -- reshaping --------------------------------------------------------------------------------------------------

    def pivot(self, index: str, columns: str, values: str, wanted: Sequence[object] | None = None) -> DataFrame:
        """One row an index value, one column a column value; null keys are skipped, two values for a cell are an error."""
        kept = self.df.where(F.col(index).isNotNull() & F.col(columns).isNotNull())
        if wanted is None:
            wanted = [r[0] for r in kept.select(columns).distinct().orderBy(columns).collect()]
        cell = F.when(F.count("*") > 1, F.raise_error(F.lit("several values for one cell"))).otherwise(F.first(values))
        cells = kept.groupBy(index, columns).agg(cell.alias("__v"))
        return cells.groupBy(index).pivot(columns, list(wanted)).agg(F.first("__v"))

    def melt(self, id_vars: Sequence[str], value_vars: Sequence[str], var_name: str = "variable", value_name: str = "value") -> DataFrame:
        if {var_name, value_name} & set(id_vars):
            raise DataValidationError("the new names are taken")
        return self.df.unpivot(list(id_vars), list(value_vars), var_name, value_name)


class Series:
    """One column of a frame. Statistics skip null and NaN but, unlike grouped ones, keep infinite values."""

    def __init__(self, frame: Frame, name: str):
        self.frame, self.name = frame, name

    def _agg(self, value: Column) -> object:
        return self.frame.df.agg(value.alias("v")).first().v

    def _value(self) -> Column:
        own = F.col(self.name)
        return F.when(~self.frame._missing(self.name), own)

    def __len__(self) -> int:
        return self.frame.df.count()

    def __str__(self) -> str:
        return self.frame.select([self.name]).text()

    @property
    def index(self) -> list[str]:
        """The columns whose values label the rows."""
        return list(self.frame.order)

    def get(self, label: object) -> list:
        """The values of the rows with a label of the index."""
        return [r[self.name] for r in self.frame.loc(label, self.index[0]).df.collect()]

    def sum(self) -> float:
        found = self._agg(F.sum(self._value()))
        if found is None and not len(self):
            raise DataValidationError("the sum of nothing")
        return found or 0

    def mean(self) -> float | None:
        return self._agg(F.avg(self._value()))

    def median(self) -> float | None:
        return quantiles(self.frame.df, {self.name: self._value()}, (0.5,))[self.name][0]

    def std(self) -> float | None:
        return self._agg(F.stddev_samp(self._value()))

    def var(self) -> float | None:
        return self._agg(F.var_samp(self._value()))

    def min(self) -> object:
        return self._agg(F.min(self._value()))

    def max(self) -> object:
        return self._agg(F.max(self._value()))

    def unique(self) -> list:
        return [r[0] for r in self.frame.unique(self.name).collect()]

    def value_counts(self) -> DataFrame:
        return self.frame.value_counts(self.name)

    def map(self, function: Callable[[Column], Column]) -> Series:
        """function of the column, as a column."""
        return Series(self.frame._with(self.frame.df.withColumn(self.name, function(F.col(self.name)))), self.name)

    def filter(self, predicate: Callable[[Column], Column]) -> Series:
        return Series(self.frame.filter(predicate(F.col(self.name))), self.name)

    def sort(self, ascending: bool = True) -> Series:
        return Series(self.frame.sort(self.name, ascending), self.name)

    def head(self, n: int = 5) -> list:
        return [r[self.name] for r in self.frame.head(n).ordered().collect()]

    def tail(self, n: int = 5) -> list:
        return [r[self.name] for r in self.frame.tail(n).ordered().collect()]

    def iloc(self, position: int) -> object:
        found = self.frame.iloc(position).df.first()
        if found is None:
            raise PositionError(f"position {position} is beyond the end")
        return found[self.name]

    def to_list(self) -> list:
        return [r[self.name] for r in self.frame.ordered().select(self.name).collect()]
