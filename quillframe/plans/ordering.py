"""Positional order on an engine without one, without gathering a table in one task.

A total order is a list of columns. ``bucketed`` cuts a table at bounds of whole order tuples, so that a value which
repeats in the first column is cut as well; the bounds come from a sample by a hash of the tuple, and their number grows
with the rows. Running totals are then windows inside buckets plus the totals of the buckets before, a table of as
many rows as buckets. With the row number so found, windows of a few rows back or ahead run in chunks of
``CHUNK`` rows, to which the rows that reach over an edge are copied.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_ROWS, MOST_BUCKETS = 100_000, 1 << 14  # the rows of a bucket grow only beyond their product
SAMPLE = 32  # sampled rows for each bucket
CHUNK = 100_000
HOT_ROWS = 1_000_000  # rows of one key that a window may sort in one task
BUCKET, ORD, TAKEN, TIE = "__bucket", "__ord", "__chunk", "__tie"


def bounds_of(df: DataFrame, order: Sequence[str], buckets: int | None = None, sample_by: Sequence[str] | None = None) -> list[tuple]:
    """Order tuples that cut df into buckets of about even size, ascending; none for a table of one bucket."""
    rows = df.select(*dict.fromkeys([*order, *(sample_by or ())]))
    count = rows.count()
    n = buckets or min(MOST_BUCKETS, math.ceil(count / BUCKET_ROWS))
    if n < 2 or count < 2:
        return []
    share = SAMPLE * n / count
    if share < 1:  # by a tuple that is one row's own, so no value is sampled more often than it occurs
        rows = rows.where(F.xxhash64(*(sample_by or order), F.lit("bounds")) < F.lit(int((2 * share - 1) * 2**63)))
    found = rows.groupBy(*order).agg(F.count("*").alias("__n")).orderBy(*ascending(order)).collect()
    total, bounds, seen = sum(r["__n"] for r in found), [], 0
    for before, r in zip([None, *found], found, strict=False):
        if before is not None and seen * n // total > (seen - before["__n"]) * n // total:
            bounds.append(tuple(r)[:-1])
        seen += r["__n"]
    return bounds


def bucketed(df: DataFrame, order: Sequence[str], buckets: int | None = None, unique: bool = False, sample_by: Sequence[str] | None = None, bounds: list[tuple] | None = None) -> DataFrame:
    """df with a bucket number that ascends with the order tuple, nulls first.

    Unless order tuples are known to be unique, rows of one tuple are told apart by a hash of all their columns, so
    that a very frequent tuple fills more than one bucket; with ``sample_by``, columns that tell rows apart for the
    sample of bounds, rows of one tuple share a bucket. ``bounds`` of unique tuples are taken as they are.
    """
    if not unique and not sample_by:
        tie = F.xxhash64(*(f"`{f.name}`" for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))))
        return bucketed(df.withColumn(TIE, tie), [*order, TIE], buckets, unique=True).drop(TIE)
    bounds = bounds_of(df, order, buckets, sample_by) if bounds is None else bounds
    if not bounds:
        return df.withColumn(BUCKET, F.lit(0))
    kinds = [df.schema[c].dataType for c in order]
    places = F.array(*(F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(t, kinds, order, strict=True))) for t in bounds))
    key = F.struct(*order)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    # the number of bounds at or below the key, by bisection: beyond the last bound there is none to compare with; the
    # key goes along in the state, as Spark overlooks columns inside a lambda when it infers filters for the other side of a join
    start = F.struct(F.lit(0).alias("low"), key.alias("key"))
    step_up = lambda at, step: F.when(F.get(places, at["low"] + step - 1) <= at["key"], at["low"] + step).otherwise(at["low"])
    at = F.aggregate(steps, start, lambda at, step: F.struct(step_up(at, step).alias("low"), at["key"].alias("key")), lambda at: at["low"])
    return df.withColumn(BUCKET, F.coalesce(at, F.lit(0)))  # never null: else a join on it finds each row's number twice, for a filter as well


def ascending(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


#: how two consecutive stretches of a running value combine
COMBINE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda before, here: before + here,
    "count": lambda before, here: before + here,
    "product": lambda before, here: before * here,
    "max": F.greatest,
    "min": F.least,
}
AGGREGATE: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": F.count, "product": F.product, "max": F.max, "min": F.min}


def is_hot(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether some key has more rows than a task should sort."""
    return not df.groupBy(*keys).count().where(F.col("count") > HOT_ROWS).limit(1).isEmpty()


def _running_by_key(df: DataFrame, order: Sequence[str], outputs: dict[str, tuple[Column, str]], keys: Sequence[str], buckets: int | None) -> DataFrame:
    """As running for each key, with keys of any number of rows cut into buckets; only what a key has in earlier buckets is joined, at most a row a bucket."""
    cut = bucketed(df, [*keys, *(c for c in order if c not in keys)], buckets, unique=True)
    here = cut.withColumns({name: AGGREGATE[how](value).over(Window.partitionBy(BUCKET, *keys).orderBy(*ascending(order)).rowsBetween(Window.unboundedPreceding, 0)) for name, (value, how) in outputs.items()})
    totals = cut.groupBy(BUCKET, *keys).agg(*(AGGREGATE[how](value).alias(f"__t_{name}") for name, (value, how) in outputs.items()))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"__b_{name}": AGGREGATE["sum" if how == "count" else how](f"__t_{name}").over(before) for name, (_, how) in outputs.items()})
    totals = totals.withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy(BUCKET))).where("__first > 1")
    totals = totals.select(F.col(BUCKET).alias("__at"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(f"__b_{name}" for name in outputs))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    joined = here.join(F.broadcast(totals), [F.col(BUCKET) == F.col("__at"), *same], "left")  # fewer rows than buckets
    out = {name: F.coalesce(COMBINE[how](F.col(f"__b_{name}"), F.col(name)), F.col(name), F.col(f"__b_{name}")) for name, (_, how) in outputs.items()}
    return joined.withColumns(out).drop(BUCKET, "__at", *(f"__k{i}" for i in range(len(keys))), *(f"__b_{name}" for name in outputs))


def running(df: DataFrame, order: Sequence[str], outputs: dict[str, tuple[Column, str]], partition_by: Sequence[str] = (), buckets: int | None = None, unique: bool = True, bounds: list[tuple] | None = None) -> DataFrame:
    """df with running aggregates, from the first row in order to each: name -> (value, one of AGGREGATE)."""
    if partition_by and not is_hot(df, partition_by):
        w = Window.partitionBy(*partition_by).orderBy(*ascending(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: AGGREGATE[how](value).over(w) for name, (value, how) in outputs.items()})
    if partition_by:
        return _running_by_key(df, order, outputs, partition_by, buckets)
    cut = bucketed(df, order, buckets, unique, bounds=bounds)
    w = Window.partitionBy(BUCKET).orderBy(*ascending(order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(BUCKET).agg(*(AGGREGATE[how](value).alias(f"__t_{name}") for name, (value, how) in outputs.items()))
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # at most MOST_BUCKETS rows
    totals = totals.select(BUCKET, *(AGGREGATE["sum" if how == "count" else how](f"__t_{name}").over(before).alias(f"__b_{name}") for name, (_, how) in outputs.items()))
    here = cut.withColumns({name: AGGREGATE[how](value).over(w) for name, (value, how) in outputs.items()})
    joined = here.join(F.broadcast(totals), BUCKET)
    out = {name: F.coalesce(COMBINE[how](F.col(f"__b_{name}"), F.col(name)), F.col(name), F.col(f"__b_{name}")) for name, (_, how) in outputs.items()}
    return joined.withColumns(out).drop(BUCKET, *(f"__b_{name}" for name in outputs))


def numbered(df: DataFrame, order: Sequence[str], into: str = ORD, buckets: int | None = None, unique: bool = True, bounds: list[tuple] | None = None) -> DataFrame:
    """df with the position of each row, from 0."""
    return running(df, order, {into: (F.lit(1), "count")}, buckets=buckets, unique=unique, bounds=bounds).withColumn(into, F.col(into) - 1)


def around(df: DataFrame, order: Sequence[str], back: int, ahead: int, columns: Callable[[Window], dict[str, Column]], partition_by: Sequence[str] = ()) -> DataFrame:
    """df with window columns that look at most ``back`` rows back and ``ahead`` rows ahead; columns gets the window."""
    if partition_by and not is_hot(df, partition_by):
        return df.withColumns(columns(Window.partitionBy(*partition_by).orderBy(*ascending(order))))
    size = max(CHUNK, 4 * (back + ahead))
    at = numbered(df, [*partition_by, *(c for c in order if c not in partition_by)])
    chunk, place = F.floor(F.col(ORD) / size), F.col(ORD) % size
    needed = F.array_compact(F.array(chunk, F.when(place >= size - back, chunk + 1), F.when((place < ahead) & (chunk > 0), chunk - 1)))
    spread = at.select("*", F.explode(needed).alias(TAKEN))
    done = spread.withColumns(columns(Window.partitionBy(TAKEN, *partition_by).orderBy(ORD)))
    return done.where(F.col(TAKEN) == chunk).drop(TAKEN, ORD)
