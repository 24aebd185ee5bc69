"""The data behind plots: what a picture needs is aggregated by Spark, drawing is left to any library."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions.quantiles import grouped


def histogram(df: DataFrame, name: str, bins: int = 10) -> DataFrame:
    """bin, low, high and n for bins of equal width; the last includes its end. Empty bins are there."""
    v = F.col(name).cast("double")
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if ends.lo is None:
        return df.sparkSession.range(0).select(F.lit(0).alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("n"))
    width = (ends.hi - ends.lo) / bins or 1.0
    own = df.where(v.isNotNull()).groupBy(F.least(F.floor((v - ends.lo) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(own, "bin", "left").select("bin", (F.lit(ends.lo) + F.col("bin") * width).alias("low"), (F.lit(ends.lo) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def boxplot(df: DataFrame, name: str, by: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 spreads and the number of values beyond, for each group."""
    box = grouped(df, [by], F.col(name), (0.25, 0.5, 0.75), ("q1", "q2", "q3"))
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(name).between(low, high)
    return df.join(box, by).groupBy(by, "q1", "q2", "q3").agg(F.min(F.when(inside, F.col(name))).alias("low"), F.max(F.when(inside, F.col(name))).alias("high"), F.count(F.when(~inside, F.lit(1))).alias("outside"))


def density(df: DataFrame, name: str, points: int = 50, bins: int = 512) -> DataFrame:
    """A Gaussian kernel density by Silverman's rule, over a histogram of ``bins``: as exact as the bins are narrow."""
    s = df.agg(F.count(name).alias("n"), F.stddev_samp(name).alias("s"), F.min(name).alias("lo"), F.max(name).alias("hi")).first()
    h = 1.06 * s.s * s.n**-0.2
    x = df.sparkSession.range(points).select((F.lit(s.lo - 3 * h) + F.col("id") * ((s.hi - s.lo + 6 * h) / (points - 1))).alias("x"))
    cells = histogram(df, name, bins).select(((F.col("low") + F.col("high")) / 2).alias("m"), "n").where("n > 0")
    z = (F.col("x") - F.col("m")) / h
    return x.crossJoin(F.broadcast(cells)).groupBy("x").agg((F.sum(F.exp(-z * z / 2) * F.col("n")) / (s.n * h * math.sqrt(2 * math.pi))).alias("density"))


def bars(df: DataFrame, by: str, value: str | None = None, how: str = "sum") -> DataFrame:
    """A height for each category: its rows, or an aggregate of value."""
    return df.groupBy(by).agg((F.count("*") if value is None else getattr(F, how)(value)).alias("height"))


def shares(df: DataFrame, by: str, value: str | None = None) -> DataFrame:
    """Categories with their parts of the whole, as a pie shows them."""
    parts = bars(df, by, value)
    return parts.crossJoin(F.broadcast(parts.agg(F.sum("height").alias("all")))).select(by, (F.col("height") / F.col("all")).alias("share"))


def points(df: DataFrame, x: str, y: str, most: int = 5_000, seed: int = 0) -> DataFrame:
    """At most ``most`` rows for a scatter plot, those with the smallest hashes."""
    return df.select(x, y).orderBy(F.xxhash64(x, y, F.lit(seed)), x, y).limit(most)


def heat(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """(i, j, n): counts over a grid of equal cells."""
    ends = df.agg(*(f(c).cast("double").alias(f"{n}{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    cell = lambda c: F.least(F.floor((F.col(c) - ends[f"lo{c}"]) / ((ends[f"hi{c}"] - ends[f"lo{c}"]) / bins or 1.0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cell(x).alias("i"), cell(y).alias("j")).agg(F.count("*").alias("n"))


def contour(df: DataFrame, x: str, y: str, value: str, levels: list[float], bins: int = 20) -> DataFrame:
    """(i, j, value, level): the mean of a value over a grid of equal cells, and how many of the ascending levels it reaches, as filled contours show."""
    ends = df.agg(*(f(c).cast("double").alias(f"{n}{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    cell = lambda c: F.least(F.floor((F.col(c) - ends[f"lo{c}"]) / ((ends[f"hi{c}"] - ends[f"lo{c}"]) / bins or 1.0)), F.lit(bins - 1)).cast("int")
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cell(x).alias("i"), cell(y).alias("j")).agg(F.avg(value).alias("value"))
    return cells.withColumn("level", sum(((F.col("value") >= float(v)).cast("int") for v in levels), F.lit(0)))


def lines(df: DataFrame, x: str, y: str, steps: int = 500) -> DataFrame:
    """(step, x, low, high, mean): a line of any number of points, as a picture of ``steps`` columns shows it."""
    ends = df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi")).first()
    if ends.lo is None:
        return df.sparkSession.createDataFrame([], "step int, x double, low double, high double, mean double")
    width = (ends.hi - ends.lo) / steps or 1.0
    step = F.least(F.floor((F.col(x) - ends.lo) / width), F.lit(steps - 1)).cast("int")
    v = F.col(y).cast("double")
    return df.where(F.col(x).isNotNull()).groupBy(step.alias("step")).agg(F.min(F.col(x).cast("double")).alias("x"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"))


def validation_curve(make, values: list[float], train: DataFrame, test: DataFrame, score) -> DataFrame:
    """(value, train, test): scores of models made with each value of a parameter. score is a column of a prediction."""
    rows = []
    for value in values:
        model = make(value).fit(train)
        rows.append((float(value), *(float(model.predict(d).agg(score).first()[0]) for d in (train, test))))
    return train.sparkSession.createDataFrame(rows, "value double, train double, test double")


def boundary(spark, model, features: list[str], low: list[float], high: list[float], steps: int = 50) -> DataFrame:
    """A model's predictions over a grid of two features."""
    grid = spark.range(steps * steps).select(*((F.lit(a) + f(F.col("id")) * ((b - a) / (steps - 1))).alias(c) for c, a, b, f in zip(features, low, high, (lambda i: F.pmod(i, F.lit(steps)), lambda i: F.floor(i / steps)), strict=True)))
    return model.predict(grid)


def learning_curve(make, train: DataFrame, test: DataFrame, keys: list[str], score, parts: tuple[float, ...] = (0.1, 0.3, 0.5, 1.0)) -> DataFrame:
    """(part, train, test): scores of models fitted on growing parts of a table, cut by hash. score is a column of a prediction."""
    rows = []
    for part in parts:
        own = train.where(F.pmod(F.xxhash64(*keys), F.lit(1000)) < part * 1000)
        model = make().fit(own)
        rows.append((part, *(float(model.predict(d).agg(score).first()[0]) for d in (own, test))))
    return train.sparkSession.createDataFrame(rows, "part double, train double, test double")
