"""Seeded random columns and synthetic data sets, made on the executors: the same rows at any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.quantiles import quantiles


def uniform(seed: int, low: float = 0.0, high: float = 1.0, key: str = "id") -> Column:
    """By a hash of a key and the seed, in (low, high): what rand() gives would depend on the partitions."""
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return u * (high - low) + low


def normal(seed: int, mean: float = 0.0, std: float = 1.0, key: str = "id") -> Column:
    """Box and Muller's transform of two uniform numbers."""
    return F.sqrt(-2 * F.ln(uniform(2 * seed, key=key))) * F.cos(uniform(2 * seed + 1, key=key) * (2 * math.pi)) * std + mean


def integers(seed: int, low: int, high: int, key: str = "id") -> Column:
    return F.floor(uniform(seed, low, high, key)).cast("long")


def exponential(seed: int, scale: float = 1.0, key: str = "id") -> Column:
    return -F.ln(uniform(seed, key=key)) * scale


def bernoulli(seed: int, p: float, key: str = "id") -> Column:
    return (uniform(seed, key=key) < p).cast("int")


def binomial(seed: int, n: int, p: float, key: str = "id") -> Column:
    draws = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.when((F.pmod(F.xxhash64(F.col(key), k, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)) < p, 1).otherwise(0))
    return F.aggregate(draws, F.lit(0), lambda a, x: a + x) if n else F.lit(0)


def choice(seed: int, values: list, key: str = "id") -> Column:
    return F.get(F.array(*map(F.lit, values)), integers(seed, 0, len(values), key).cast("int"))


def permuted(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)


def make_blobs(spark: SparkSession, n: int, centres: list[list[float]], std: float = 1.0, seed: int = 0) -> DataFrame:
    label = F.pmod("id", F.lit(len(centres))).cast("int")
    at = lambda j: F.get(F.array(*(F.lit(float(c[j])) for c in centres)), label)
    return spark.range(n).select("id", *((at(j) + normal(seed * 97 + j, 0.0, std)).alias(f"x{j}") for j in range(len(centres[0]))), label.alias("label"))


def make_regression(spark: SparkSession, n: int, coef: list[float], noise: float = 0.1, seed: int = 0) -> DataFrame:
    x = spark.range(n).select("id", *(normal(seed * 97 + j).alias(f"x{j}") for j in range(len(coef))))
    y = sum((F.col(f"x{j}") * float(w) for j, w in enumerate(coef)), F.lit(0.0)) + normal(seed * 97 + 90, 0.0, noise)
    return x.withColumn("y", y)


def make_classification(spark: SparkSession, n: int, features: int = 4, classes: int = 2, gap: float = 2.0, flip: float = 0.01, seed: int = 0) -> DataFrame:
    label = F.pmod("id", F.lit(classes)).cast("int")
    x = [(normal(seed * 97 + j) + F.when(label == j % classes, gap).otherwise(0.0)).alias(f"x{j}") for j in range(features)]
    given = F.when(uniform(seed * 97 + 91) < flip, integers(seed * 97 + 92, 0, classes).cast("int")).otherwise(label)
    return spark.range(n).select("id", *x, given.alias("label"))


def make_moons(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    upper, t = F.pmod("id", F.lit(2)) == 0, uniform(seed * 97) * math.pi
    x0, x1 = F.when(upper, F.cos(t)).otherwise(1 - F.cos(t)), F.when(upper, F.sin(t)).otherwise(0.5 - F.sin(t))
    return spark.range(n).select("id", (x0 + normal(seed * 97 + 1, 0.0, noise)).alias("x0"), (x1 + normal(seed * 97 + 2, 0.0, noise)).alias("x1"), F.when(upper, 0).otherwise(1).alias("label"))


def make_circles(spark: SparkSession, n: int, factor: float = 0.8, noise: float = 0.0, seed: int = 0) -> DataFrame:
    outer, t = F.pmod("id", F.lit(2)) == 0, uniform(seed * 97) * (2 * math.pi)
    r = F.when(outer, 1.0).otherwise(factor)
    return spark.range(n).select("id", (r * F.cos(t) + normal(seed * 97 + 1, 0.0, noise)).alias("x0"), (r * F.sin(t) + normal(seed * 97 + 2, 0.0, noise)).alias("x1"), F.when(outer, 0).otherwise(1).alias("label"))


def poisson(seed: int, mean: float, key: str = "id") -> Column:
    """By inversion: the number of terms of the distribution's sum below a uniform number."""
    most = int(mean + 12 * math.sqrt(mean) + 20)
    sums, term = [], math.exp(-mean)
    total = term
    for k in range(1, most):
        sums.append(total)
        term *= mean / k
        total += term
    return F.size(F.filter(F.array(*map(F.lit, sums)), lambda s: s < uniform(seed, key=key)))


def gamma(seed: int, shape: int, scale: float = 1.0, key: str = "id") -> Column:
    """For whole shapes: a sum of exponential numbers."""
    return sum((exponential(seed * 1009 + k, scale, key) for k in range(shape)), F.lit(0.0))


def beta(seed: int, a: int, b: int, key: str = "id") -> Column:
    x, y = gamma(2 * seed, a, key=key), gamma(2 * seed + 1, b, key=key)
    return x / (x + y)


def make_gaussian_quantiles(spark: SparkSession, n: int, features: int = 2, classes: int = 3, seed: int = 0) -> DataFrame:
    """One cloud, with labels by equal parts of its distance from the middle."""
    x = spark.range(n).select("id", *(normal(seed * 97 + j).alias(f"x{j}") for j in range(features)))
    r = sum((F.col(f"x{j}") * F.col(f"x{j}") for j in range(features)), F.lit(0.0))
    cuts = quantiles(x, {"r": r}, [k / classes for k in range(1, classes)])["r"] if classes > 1 else []
    return x.withColumn("label", sum(((r >= float(c)).cast("int") for c in cuts), F.lit(0)))
