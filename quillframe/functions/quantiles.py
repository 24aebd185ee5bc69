"""Exact quantiles of any number of rows: histograms that close in on the wanted ranks, a pass each."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.plans import ordering

#: values up to which one aggregation may hold all of a column (its buffer keeps every different value)
BUFFERED = 1_000_000
BINS = 4_096


def quantiles(df: DataFrame, columns: dict[str, Column], qs: Sequence[float], buffered: int | None = None) -> dict[str, list[float | None]]:
    """name -> its quantiles, between neighbours by their distance; null for a column without values.

    A rank's value lies between two bounds, at first the least and the greatest value. Each pass counts the values
    between in bins, whose numbers ascend with the values, and the bin that holds the rank gives new bounds: its own
    least and greatest value. What is counted are at most BINS rows an interval, whatever the table; nothing is sorted,
    and two or three passes meet most ranks.
    """
    rows = df.select(*(v.cast("double").alias(f"v{i}") for i, v in enumerate(columns.values())))
    ends = rows.agg(*(f(f"v{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))).first()
    buffered = BUFFERED if buffered is None else buffered
    endless = any(ends[f"n{i}"] and not math.isfinite(ends[f"{n}{i}"]) for i in range(len(columns)) for n in ("lo", "hi"))  # NaN, the greatest, or infinite: no bins
    if endless or max((ends[f"n{i}"] for i in range(len(columns))), default=0) <= buffered:
        one = rows.agg(*(F.percentile(f"v{i}", F.array(*map(F.lit, qs))).alias(f"q{i}") for i in range(len(columns)))).first()
        return {name: list(one[f"q{i}"] or [None] * len(qs)) for i, name in enumerate(columns)}
    wanted = {(i, r) for i in range(len(columns)) for q in qs if ends[f"n{i}"] for r in (math.floor((ends[f"n{i}"] - 1) * q), math.ceil((ends[f"n{i}"] - 1) * q))}
    #: (column, rank) -> least and greatest value that it may have, and the rows below these
    known = {(i, r): (ends[f"lo{i}"], ends[f"hi{i}"], 0) for i, r in wanted}
    while open_ := sorted({(i, *known[i, r]) for i, r in wanted if known[i, r][0] < known[i, r][1]}):
        cells = []
        for k, (i, low, high, _) in enumerate(open_):
            v = F.col(f"v{i}")
            bin_ = F.least(F.floor((v - low) / (high - low) * BINS).cast("int"), F.lit(BINS - 1))
            cells.append(F.when(v.between(low, high), F.struct(F.lit(k).alias("k"), bin_.alias("bin"), v.alias("v"))))
        counted = rows.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("k", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        found: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r.k, r.bin)):
            found.setdefault(r.k, []).append(r)
        for k, interval in enumerate(open_):
            for i, rank in wanted:
                if (i, *known[i, rank]) != interval:
                    continue
                below = interval[3]
                for r in found[k]:
                    if rank < below + r.n:
                        known[i, rank] = (r.lo, r.hi, below)
                        break
                    below += r.n
    out = {}
    for i, name in enumerate(columns):
        n = ends[f"n{i}"]
        values = []
        for q in qs if n else ():
            at = (n - 1) * q
            low, high = known[i, math.floor(at)][0], known[i, math.ceil(at)][0]
            values.append(low + (high - low) * (at - math.floor(at)))
        out[name] = values if n else [None] * len(qs)
    return out


def grouped(df: DataFrame, keys: Sequence[str], value: Column, qs: Sequence[float], into: Sequence[str]) -> DataFrame:
    """keys and a column for each quantile of the value's numbers in each group.

    Where a group has more rows than a task should hold, different values are counted and summed up in order, with
    large groups cut into buckets; else one aggregation holds a group's values.
    """
    rows = df.select(*keys, value.cast("double").alias("__v"))
    if not ordering.is_hot(rows, keys):
        found = rows.groupBy(*keys).agg(F.percentile("__v", F.array(*map(F.lit, qs))).alias("__q"))
        return found.select(*keys, *(F.get("__q", k).alias(n) for k, n in enumerate(into)))
    counted = rows.groupBy(*keys, "__v").agg(F.sum(F.col("__v").isNotNull().cast("long")).alias("__n"))
    counted = ordering.running(counted, ["__v"], {"__upto": (F.col("__n"), "sum")}, keys)
    sizes = counted.groupBy(*(F.col(k).alias(f"__s{i}") for i, k in enumerate(keys))).agg(F.sum("__n").alias("__all"))
    same = [F.col(k).eqNullSafe(F.col(f"__s{i}")) for i, k in enumerate(keys)]
    placed = counted.join(sizes, same)
    picked = []
    for q, name in zip(qs, into, strict=True):
        at = (F.col("__all") - 1) * q
        low, high = (F.min(F.when((F.col("__n") > 0) & (F.col("__upto") > rank), F.col("__v"))) for rank in (F.floor(at), F.ceil(at)))
        picked.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return placed.groupBy(*keys).agg(*picked)
