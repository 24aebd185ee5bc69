"""Statistics and tests: sufficient statistics by Spark aggregates, distribution functions on the driver.

``*_stats`` functions return frames or columns; tests return a (statistic, p-value) pair of numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.errors import DataValidationError, InvalidParameterError
from quillframe.functions import special
from quillframe.functions.quantiles import grouped, quantiles
from quillframe.operators.frame import Frame
from quillframe.plans import ordering

NAN = float("nan")


def _c(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("double")


def _poisoned(v: Column, result: Column) -> Column:
    return F.when(F.bool_or(F.isnan(v)), NAN).otherwise(result)


def mean(v) -> Column:
    return F.avg(_c(v))


def median(v) -> Column:
    return _poisoned(_c(v), F.median(_c(v)))


def mode(v) -> Column:
    """The most frequent value, the smallest of several."""
    return F.mode(_c(v), True)


def std(v, ddof: int = 0) -> Column:
    return F.sqrt(variance(v, ddof))


def variance(v, ddof: int = 0) -> Column:
    n = F.count(_c(v))
    return F.when(n > ddof, F.var_pop(_c(v)) * n / (n - ddof))


def moment(df: DataFrame, name: str, n: int) -> DataFrame:
    """The central n-th moment: the mean first, then one more pass, which keeps the digits that power sums lose."""
    centre = df.select(F.avg(_c(name)).alias("__m"))
    return df.crossJoin(F.broadcast(centre)).agg(F.avg(F.pow(_c(name) - F.col("__m"), F.lit(float(n)))).alias("moment"))


def skewness(v, bias: bool = True) -> Column:
    n, g = F.count(_c(v)), F.skewness(_c(v))
    return F.coalesce(g if bias else F.when(n > 2, g * F.sqrt(n * (n - 1.0)) / (n - 2)), F.lit(NAN))


def kurtosis(v, fisher: bool = True, bias: bool = True) -> Column:
    n, k = F.count(_c(v)), F.kurtosis(_c(v))
    k = k if bias else F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * k + 6.0))
    return F.coalesce(k if fisher else k + 3, F.lit(NAN))


def quantile(v, q: float | Sequence[float]) -> Column:
    return F.percentile(_c(v), F.lit(q) if isinstance(q, (int, float)) else F.array(*map(F.lit, q)))


def percentile(v, p: float | Sequence[float]) -> Column:
    """As quantile, in percent."""
    return quantile(v, p / 100 if isinstance(p, (int, float)) else [x / 100 for x in p])


def quantiles_of(df: DataFrame, v, q: Sequence[float]) -> list[float | None]:
    """As quantile, of a whole table of any size, without a buffer of its values."""
    return quantiles(df, {"v": _c(v)}, q)["v"]


def percentiles_of(df: DataFrame, v, p: Sequence[float]) -> list[float | None]:
    """As quantiles_of, in percent."""
    return quantiles_of(df, v, [x / 100 for x in p])


def geometric_mean(v) -> Column:
    """Of positive values; null if any is not."""
    return F.when(F.min(_c(v)) > 0, F.exp(F.avg(F.when(_c(v) > 0, F.ln(_c(v))))))


def harmonic_mean(v) -> Column:
    return F.when(F.min(_c(v)) > 0, F.count(_c(v)) / F.sum(F.when(_c(v) > 0, F.lit(1.0) / _c(v))))


def trim_mean(df: DataFrame, name: str, proportion: float) -> DataFrame:
    """The mean without the smallest and largest floor(n * proportion) values; equal values are counted, not sorted out one by one."""
    if not 0 <= proportion < 0.5:
        raise InvalidParameterError("the proportion lies in [0, 0.5)", "proportion", proportion)
    seen = df.select(_c(name).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    seen = ordering.running(seen, ["v"], {"upto": (F.col("n"), "sum")})
    size = seen.agg(F.sum("n").alias("size"))
    cut = F.floor(F.col("size") * proportion)
    kept = F.greatest(F.least(F.col("upto"), F.col("size") - cut) - F.greatest(F.col("upto") - F.col("n"), cut), F.lit(0))
    return seen.crossJoin(F.broadcast(size)).agg((F.sum(F.col("v") * kept) / F.sum(kept)).alias("trim_mean"))


def pearson(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    r = df.select(_c(x).alias("x"), _c(y).alias("y")).where("x is not null and y is not null")
    s = r.agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.covar_pop("x", "y").alias("c")).first()
    if not s.n or s.n < 2 or not s.sx or not s.sy:
        raise DataValidationError("the correlation of a constant is undefined")
    return _with_p(s.c / (s.sx * s.sy), s.n)


def _with_p(r: float, n: int) -> tuple[float, float]:
    r = max(-1.0, min(1.0, r))
    if n < 3:
        return r, 1.0
    return r, 0.0 if abs(r) == 1 else special.t_sf2(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def ranks(df: DataFrame, name: str, into: str) -> DataFrame:
    return Frame(df).rank(name, "average", into=into).df


def spearman(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    both = df.select(_c(x).alias("x"), _c(y).alias("y")).where("x is not null and y is not null")
    return pearson(ranks(ranks(both, "x", "rx"), "y", "ry"), "rx", "ry")


def ttest_1samp(df: DataFrame, name: str, centre: float) -> tuple[float, float]:
    s = df.agg(F.count(name).alias("n"), F.avg(_c(name)).alias("m"), F.var_samp(_c(name)).alias("v")).first()
    if s.n < 2 or not s.v:
        raise DataValidationError("two different values are needed")
    t = (s.m - centre) / math.sqrt(s.v / s.n)
    return t, special.t_sf2(t, s.n - 1)


def _groups(df: DataFrame, value: str, group: str) -> list:
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(_c(value)).alias("m"), F.var_samp(_c(value)).alias("v")).orderBy(group).collect()


def ttest_ind(df: DataFrame, value: str, group: str, equal_var: bool = True) -> tuple[float, float]:
    a, b = _groups(df, value, group)
    if equal_var:
        dof = a.n + b.n - 2
        t = (a.m - b.m) / math.sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / dof * (1 / a.n + 1 / b.n))
    else:
        va, vb = a.v / a.n, b.v / b.n
        t, dof = (a.m - b.m) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1))
    return t, special.t_sf2(t, dof)


def ttest_rel(df: DataFrame, a: str, b: str) -> tuple[float, float]:
    return ttest_1samp(df.select((_c(a) - _c(b)).alias("d")), "d", 0.0)


def f_oneway(df: DataFrame, value: str, group: str) -> tuple[float, float]:
    g = _groups(df, value, group)
    n, k = sum(r.n for r in g), len(g)
    m = sum(r.n * r.m for r in g) / n
    between, within = sum(r.n * (r.m - m) ** 2 for r in g), sum((r.n - 1) * (r.v or 0) for r in g)
    if within == 0:
        return (math.inf, 0.0) if between > 0 else (NAN, NAN)
    f = between / (k - 1) / (within / (n - k))
    return f, special.f_sf(f, k - 1, n - k)


def bartlett(df: DataFrame, value: str, group: str) -> tuple[float, float]:
    g = _groups(df, value, group)
    if any(not r.v for r in g):
        raise DataValidationError("a group is constant")
    n, k = sum(r.n for r in g), len(g)
    pooled = sum((r.n - 1) * r.v for r in g) / (n - k)
    x = ((n - k) * math.log(pooled) - sum((r.n - 1) * math.log(r.v) for r in g)) / (1 + (sum(1 / (r.n - 1) for r in g) - 1 / (n - k)) / (3 * (k - 1)))
    return x, special.chi2_sf(x, k - 1)


def levene(df: DataFrame, value: str, group: str, center: str = "median") -> tuple[float, float]:
    if center not in ("median", "mean"):
        raise InvalidParameterError("the center is median or mean", "center", center)
    mid = grouped(df, [group], _c(value), (0.5,), ("__mid",)) if center == "median" else df.groupBy(group).agg(F.avg(_c(value)).alias("__mid"))
    away = df.join(mid, group).select(group, F.abs(_c(value) - F.col("__mid")).alias("__d"))
    return f_oneway(away, "__d", group)


def chisquare(df: DataFrame, observed: str, expected: str | None = None) -> tuple[float, float]:
    s = df.agg(F.count("*").alias("n"), F.sum(_c(observed)).alias("o"), F.sum(_c(expected) if expected else F.lit(0.0)).alias("e")).first()
    if expected and abs(s.o - s.e) > 1.5e-8 * max(abs(s.o), abs(s.e)):
        raise DataValidationError("observed and expected sums differ")
    e = _c(expected) if expected else F.lit(s.o / s.n)
    x = df.agg(F.sum((_c(observed) - e) * (_c(observed) - e) / e)).first()[0]
    return x, special.chi2_sf(x, s.n - 1)


def _ties(ranked: DataFrame, name: str) -> float:
    return ranked.groupBy(name).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t"))).first()[0] or 0.0


def kruskal(df: DataFrame, value: str, group: str) -> tuple[float, float]:
    ranked = ranks(df.where(F.col(value).isNotNull()), value, "__r")
    g = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum("__r").alias("r")).collect()
    n = sum(r.n for r in g)
    h = (12 / (n * (n + 1)) * sum(r.r**2 / r.n for r in g) - 3 * (n + 1)) / (1 - _ties(ranked, value) / (n**3 - n))
    return h, special.chi2_sf(h, len(g) - 1)


def mann_whitney(df: DataFrame, value: str, group: str) -> tuple[float, float]:
    """The smaller U, and its normal tail with ties; a continuity correction from 21 values on."""
    ranked = ranks(df.where(F.col(value).isNotNull()), value, "__r")
    a, b = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum("__r").alias("r")).orderBy(group).collect()
    n = a.n + b.n
    u = min(a.r - a.n * (a.n + 1) / 2, b.r - b.n * (b.n + 1) / 2)
    spread = math.sqrt(a.n * b.n / 12 * (n + 1 - _ties(ranked, value) / (n * (n - 1))))
    z = max(0.0, abs(u - a.n * b.n / 2) - (0.5 if n > 20 else 0)) / spread
    return u, 2 * (1 - special.normal_cdf(z))


def wilcoxon(df: DataFrame, a: str, b: str) -> tuple[float, float]:
    """The sum of the ranks of positive differences; zeros are dropped."""
    d = df.select((_c(a) - _c(b)).alias("d")).where("d != 0").withColumn("__a", F.abs("d"))
    ranked = ranks(d, "__a", "__r")
    s = ranked.agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("__r")).otherwise(0.0)).alias("w")).first()
    spread = math.sqrt(s.n * (s.n + 1) * (2 * s.n + 1) / 24 - _ties(ranked, "__a") / 48)
    z = max(0.0, abs(s.w - s.n * (s.n + 1) / 4) - (0.5 if s.n > 20 else 0)) / spread
    return s.w, 2 * (1 - special.normal_cdf(z))


def normaltest(df: DataFrame, name: str) -> tuple[float, float]:
    """D'Agostino and Pearson's omnibus test of skewness and kurtosis."""
    s = df.agg(F.count(name).alias("n"), F.skewness(_c(name)).alias("g"), F.kurtosis(_c(name)).alias("k")).first()
    n = s.n
    if n < 8:
        raise DataValidationError("eight values are needed")
    y = s.g * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    x = (s.k + 3 - 3 * (n - 1) / (n + 1)) / math.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)))
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + math.sqrt(1 + 4 / root**2))
    base = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(base) ** (1 / 3), base)) / math.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return k2, special.chi2_sf(k2, 2)


def normal_cdf(v: Column) -> Column:
    """The standard normal distribution function in its closed form, as a column."""
    z = v / math.sqrt(2)
    erf = F.sqrt(1 - F.exp(-z * z * (F.lit(4 / math.pi) + z * z * special.NORMAL_A) / (z * z * special.NORMAL_A + 1)))
    return (F.signum(z) * erf + 1) * 0.5


def kstest(df: DataFrame, name: str, cdf: Callable[[Column], Column]) -> tuple[float, float]:
    """One sample against any distribution function, given as a column of a column. Equal values are counted, not numbered one by one."""
    seen = df.select(_c(name).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    seen = ordering.running(seen, ["v"], {"upto": (F.col("n"), "sum")}).withColumn("p", cdf(F.col("v")))
    size = seen.agg(F.sum("n").alias("size"))
    gap = F.max(F.greatest(F.col("upto") / F.col("size") - F.col("p"), F.col("p") - (F.col("upto") - F.col("n")) / F.col("size")))
    s = seen.crossJoin(F.broadcast(size)).agg(gap.alias("d"), F.max("size").alias("size")).first()
    if not s.size:
        raise DataValidationError("the sample is empty")
    return s.d, special.kolmogorov_sf(s.d * math.sqrt(s.size))


def kstest_normal(df: DataFrame, name: str) -> tuple[float, float]:
    return kstest(df, name, normal_cdf)


def friedman(df: DataFrame, samples: Sequence[str]) -> tuple[float, float]:
    """Related samples in columns; ranks inside each row."""
    k = len(samples)
    if k < 3:
        raise DataValidationError("three samples are needed")
    row = F.array(*map(_c, samples))
    rank = lambda c: F.size(F.filter(row, lambda x: x < _c(c))) + (F.size(F.filter(row, lambda x: x == _c(c))) + 1) / 2
    ties = F.aggregate(F.transform(F.array_distinct(row), lambda d: F.size(F.filter(row, lambda x: x == d)).cast("double")), F.lit(0.0), lambda s, t: s + t * t * t - t)
    s = df.agg(F.count("*").alias("n"), *(F.sum(rank(c)).alias(f"r{i}") for i, c in enumerate(samples)), F.sum(ties).alias("ties")).first()
    x = (12 / (s.n * k * (k + 1)) * sum(s[f"r{i}"] ** 2 for i in range(k)) - 3 * s.n * (k + 1)) / (1 - s.ties / (s.n * k * (k * k - 1)))
    return x, special.chi2_sf(x, k - 1)


def inversions(y: Sequence[float], w: Sequence[int]) -> int:
    """The weight of pairs of which the first is larger: block against neighbouring block, all blocks of a size at once."""
    import numpy as np

    y, w = np.unique(y, return_inverse=True)[1], np.asarray(w, np.int64)
    at, total, half = np.arange(len(y)), 0, 1
    while half < len(y):
        block, right = at // (2 * half), at // half % 2
        order = np.lexsort((right, y, block))  # of equal values, those of the left block first
        left = np.cumsum(np.where(right[order] == 0, w[order], 0))
        ends = np.searchsorted(block[order], block[order], side="right") - 1
        larger = left[ends] - left  # the left block's weight behind each place, as the right block adds none
        total += int((larger * np.where(right[order] == 1, w[order], 0)).sum())
        half *= 2
    return total


def kendall(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """tau-b with a normal tail. Discordant pairs are inversions, counted by merging sorted stretches: inside each bucket of x by a merge sort, across buckets against counts of y.

    Distinct pairs are weighed, so ties cost nothing; the counts of y by bucket, at most 256 times its distinct values, are summed by Spark.
    """
    import numpy as np
    import pandas as pd

    rows = df.select(_c(x).alias("x"), _c(y).alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("w"))
    cut = ordering.bucketed(rows, ["x"], min(256, math.ceil(rows.count() / ordering.BUCKET_ROWS)), sample_by=["x", "y"])

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        """Pairs of one bucket with x and y in the same and in opposite order: inversions, with ties in x laid so that they are none."""
        x, y, w = (group[c].to_numpy() for c in ("x", "y", "w"))
        up, down = np.lexsort((y, x)), np.lexsort((-y, x))
        return pd.DataFrame({"same": [inversions(-y[down], w[down])], "opposite": [inversions(y[up], w[up])]})

    own = cut.groupBy(ordering.BUCKET).applyInPandas(inside, "same long, opposite long").agg(F.sum("same").alias("s"), F.sum("opposite").alias("o")).first()
    # across buckets: for each y, how many rows of earlier buckets lie below and above it
    by = cut.groupBy(ordering.BUCKET, "y").agg(F.sum("w").alias("w"))
    buckets = [r[0] for r in by.select(ordering.BUCKET).distinct().orderBy(ordering.BUCKET).collect()]
    wide = by.groupBy("y").pivot(ordering.BUCKET, buckets).agg(F.sum("w")).fillna(0)
    wide = ordering.running(wide, ["y"], {f"c{b}": (F.col(f"`{b}`"), "sum") for b in buckets})
    totals = {r[0]: r.w for r in by.groupBy(ordering.BUCKET).agg(F.sum("w").alias("w")).collect()}
    # one pass over the buckets of each y; an expression for each pair of buckets would nest too deeply to be compiled
    met = F.array(*(F.struct(F.col(f"`{b}`").cast("long").alias("w"), F.col(f"c{b}").cast("long").alias("c"), F.lit(totals[b]).cast("long").alias("t")) for b in buckets))
    start = F.struct(*(F.lit(0).cast("long").alias(n) for n in ("below", "above", "same", "opposite")))

    def pass_on(before: Column, b: Column) -> Column:
        own = b["w"]
        return F.struct(
            (before["below"] + b["c"] - own).alias("below"), (before["above"] + b["t"] - b["c"]).alias("above"),
            (before["same"] + own * before["below"]).alias("same"), (before["opposite"] + own * before["above"]).alias("opposite"),
        )

    crossed = F.aggregate(met, start, pass_on)
    same, opposite = crossed["same"], crossed["opposite"]
    far = wide.agg(F.sum(same).alias("s"), F.sum(opposite).alias("o")).first()
    ties = lambda *keys: [F.sum(F.col("t") * (F.col("t") - 1)).alias("a"), F.sum(F.col("t") * (F.col("t") - 1) * (F.col("t") - 2)).alias("b"), F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("c")]
    tx, ty = (rows.groupBy(k).agg(F.sum("w").cast("double").alias("t")).agg(*ties()).first() for k in ("x", "y"))
    n = float(sum(totals.values()))
    s = (own.s or 0) + (far.s or 0) - (own.o or 0) - (far.o or 0)
    pairs = n * (n - 1)
    if pairs - tx.a <= 0 or pairs - ty.a <= 0:
        return NAN, NAN
    tau = 2 * s / math.sqrt((pairs - tx.a) * (pairs - ty.a))
    var = (pairs * (2 * n + 5) - tx.c - ty.c) / 18 + (tx.b * ty.b / (9 * pairs * (n - 2)) if n > 2 else 0) + tx.a * ty.a / (2 * pairs)
    return tau, 2 * (1 - special.normal_cdf(abs(s) / math.sqrt(var)))


def anderson_normal(df: DataFrame, name: str) -> float:
    """A squared against the normal distribution with the sample's mean and deviation."""
    v = df.select(_c(name).alias("v")).where("v is not null")
    s = v.agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).first()
    if s.n < 3 or not s.s:
        raise DataValidationError("three different values are needed")
    z = (F.col("v") - s.m) / s.s / math.sqrt(2)
    erf = F.signum(z) * F.sqrt(1 - F.exp(-z * z * (F.lit(4 / math.pi) + z * z * special.NORMAL_A) / (z * z * special.NORMAL_A + 1)))
    low, high = F.greatest((erf + 1) / 2, F.lit(1e-300)), F.greatest((1 - erf) / 2, F.lit(1e-300))
    at = ordering.numbered(v, ["v"], "i", unique=False).select("i", F.ln(low).alias("a"), F.ln(high).alias("b"))
    total = at.agg(F.sum((2 * F.col("i") + 1) * F.col("a") + (2 * (s.n - F.col("i")) - 1) * F.col("b"))).first()[0]
    return -s.n - total / s.n


def shapiro(df: DataFrame, name: str) -> float:
    """W by Royston's weights, for 3 to 5000 values, which the driver sorts."""
    values = sorted(float(r[0]) for r in df.select(_c(name)).where(F.col(name).isNotNull()).limit(5001).collect())
    n = len(values)
    if not 3 <= n <= 5000 or values[0] == values[-1]:
        raise DataValidationError("between 3 and 5000 values, not all equal, are needed")
    from statistics import NormalDist

    m = [NormalDist().inv_cdf((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    ss = sum(x * x for x in m)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        u = 1 / math.sqrt(n)
        poly = lambda c: sum(k * u**i for i, k in enumerate(c))
        last = poly((m[-1] / math.sqrt(ss), 0.221157, -0.147981, -2.07119, 4.434685, -2.706056))
        if n > 5:
            second = poly((m[-2] / math.sqrt(ss), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633))
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = [-last, -second, *(x / math.sqrt(phi) for x in m[2:-2]), second, last]
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [-last, *(x / math.sqrt(phi) for x in m[1:-1]), last]
    mean_ = sum(values) / n
    return sum(w * v for w, v in zip(a, values, strict=True)) ** 2 / sum((v - mean_) ** 2 for v in values)
