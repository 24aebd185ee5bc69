"""Model metrics as aggregates over two columns. Scalar metrics are columns for ``agg``; curves and per-class tables are frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import pairwise
from quillframe.functions.quantiles import quantiles
from quillframe.plans import ordering

INF = float("inf")


def _c(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(empty)


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("double")), F.lit(0.0))


# -- classification -------------------------------------------------------------------------------------------------


def accuracy(t, p) -> Column:
    return F.coalesce(F.avg((_c(t) == _c(p)).cast("double")), F.lit(0.0))


def hamming_loss(t, p) -> Column:
    return F.coalesce(F.avg((_c(t) != _c(p)).cast("double")), F.lit(0.0))


def counts(t, p, positive=1) -> tuple[Column, Column, Column, Column]:
    """tp, fp, fn, tn."""
    yes, said = _c(t) == F.lit(positive), _c(p) == F.lit(positive)
    return _n(yes & said), _n(~yes & said), _n(yes & ~said), _n(~yes & ~said)


def precision(t, p, positive=1) -> Column:
    tp, fp, _, _ = counts(t, p, positive)
    return _ratio(tp, tp + fp)


def recall(t, p, positive=1) -> Column:
    tp, _, fn, _ = counts(t, p, positive)
    return _ratio(tp, tp + fn)


def fbeta(t, p, beta: float = 1.0, positive=1) -> Column:
    tp, fp, fn, _ = counts(t, p, positive)
    b = beta * beta
    return _ratio((1 + b) * tp, (1 + b) * tp + b * fn + fp)


def jaccard(t, p, positive=1) -> Column:
    tp, fp, fn, _ = counts(t, p, positive)
    return _ratio(tp, tp + fp + fn, 1.0)


def matthews(t, p, positive=1) -> Column:
    tp, fp, fn, tn = counts(t, p, positive)
    return _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def confusion(df: DataFrame, t: str, p: str) -> DataFrame:
    """(truth, prediction, n) of the pairs that occur."""
    return df.groupBy(F.col(t).alias("truth"), F.col(p).alias("prediction")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, t: str, p: str) -> DataFrame:
    """label, precision, recall, f1 and support, from the table of pairs."""
    pairs = confusion(df, t, p)
    both = pairs.select(F.col("truth").alias("label"), F.col("n").alias("true"), F.lit(0).alias("said"), F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"))
    both = both.unionAll(pairs.select(F.col("prediction").alias("label"), F.lit(0).alias("true"), F.col("n").alias("said"), F.lit(0).alias("hit")))
    s = both.groupBy("label").agg(F.sum("true").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    pr, rc = _ratio(F.col("hit"), F.col("said")), _ratio(F.col("hit"), F.col("support"))
    return s.select("label", pr.alias("precision"), rc.alias("recall"), _ratio(F.lit(2.0) * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")


def averaged(df: DataFrame, t: str, p: str, average: str = "macro") -> DataFrame:
    """One row of precision, recall and f1: macro, weighted by support, or micro."""
    if average == "micro":
        a = accuracy(t, p)
        return df.agg(a.alias("precision"), a.alias("recall"), a.alias("f1"))
    table = per_class(df, t, p)
    if average == "macro":
        return table.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))
    return table.agg(*((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")))


def balanced_accuracy(df: DataFrame, t: str, p: str) -> DataFrame:
    own = df.groupBy(t).agg(F.avg((F.col(t) == F.col(p)).cast("double")).alias("r"))
    return own.agg(F.avg("r").alias("balanced_accuracy"))


def cohen_kappa(df: DataFrame, t: str, p: str) -> DataFrame:
    pairs = confusion(df, t, p)
    rows, cols = pairs.groupBy("truth").agg(F.sum("n").alias("a")), pairs.groupBy("prediction").agg(F.sum("n").alias("b"))
    chance = rows.join(cols, F.col("truth") == F.col("prediction"), "left").agg(F.sum(F.col("a") * F.coalesce("b", F.lit(0))).alias("e"))
    seen = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    e, o = F.col("e") / (F.col("n") * F.col("n")), F.col("hit") / F.col("n")
    return seen.crossJoin(F.broadcast(chance)).select(F.when(e == 1, 1.0).otherwise((o - e) / (1 - e)).alias("kappa"))


def log_loss(t, score) -> Column:
    s = F.greatest(F.least(_c(score).cast("double"), F.lit(1 - 1e-15)), F.lit(1e-15))
    return F.avg(F.when(_c(t) == 1, -F.ln(s)).otherwise(-F.ln(F.lit(1.0) - s)))


def score_steps(df: DataFrame, t: str, score: str) -> DataFrame:
    """(threshold, tp, fp) after each distinct score, from the highest; ties are one step. Scores are summed up before their order matters."""
    steps = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum((F.col(t) == 1).cast("long")).alias("yes"), F.sum((F.col(t) != 1).cast("long")).alias("no"))
    steps = steps.withColumn("__down", -F.col("threshold"))
    return ordering.running(steps, ["__down"], {"tp": (F.col("yes"), "sum"), "fp": (F.col("no"), "sum")}).drop("__down")


def _totals(steps: DataFrame) -> DataFrame:
    return steps.crossJoin(F.broadcast(steps.agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))))


def roc_curve(df: DataFrame, t: str, score: str) -> DataFrame:
    """fpr, tpr, threshold; the start (0, 0, infinity) included."""
    c = _totals(score_steps(df, t, score)).where("all_yes > 0 and all_no > 0")
    c = c.select((F.col("fp") / F.col("all_no")).alias("fpr"), (F.col("tp") / F.col("all_yes")).alias("tpr"), "threshold")
    return c.unionAll(df.sparkSession.range(1).select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(INF).alias("threshold")))


def roc_auc(df: DataFrame, t: str, score: str) -> DataFrame:
    """By trapezoids over the steps: each step adds its negatives at the mean of the heights around it; 0.5 where undefined."""
    c = _totals(score_steps(df, t, score))
    area = F.sum(F.col("no") * (F.col("tp") - F.col("yes") / 2)) / (F.max("all_yes") * F.max("all_no"))
    return c.agg(F.when((F.max("all_yes") > 0) & (F.max("all_no") > 0), area).otherwise(0.5).alias("roc_auc"))


def precision_recall_curve(df: DataFrame, t: str, score: str) -> DataFrame:
    c = _totals(score_steps(df, t, score)).where("all_yes > 0")
    c = c.select((F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("all_yes")).alias("recall"), "threshold")
    return c.unionAll(df.sparkSession.range(1).select(F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(INF).alias("threshold")))


def average_precision(df: DataFrame, t: str, score: str) -> DataFrame:
    c = _totals(score_steps(df, t, score))
    return c.agg(F.coalesce(F.sum(F.col("yes") / F.col("all_yes") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.lit(0.0)).alias("average_precision"))


# -- regression -----------------------------------------------------------------------------------------------------


def _error(t, p) -> Column:
    return (_c(t) - _c(p)).cast("double")


def mse(t, p) -> Column:
    return F.coalesce(F.avg(_error(t, p) * _error(t, p)), F.lit(0.0))


def rmse(t, p) -> Column:
    return F.sqrt(mse(t, p))


def mae(t, p) -> Column:
    return F.coalesce(F.avg(F.abs(_error(t, p))), F.lit(0.0))


def r2(t, p) -> Column:
    rest, all_ = F.sum(_error(t, p) * _error(t, p)), F.var_pop(_c(t)) * F.count(_c(t))
    return F.when(all_ > 0, 1 - rest / all_).when(rest == 0, 1.0).otherwise(0.0)


def adjusted_r2(t, p, features: int) -> Column:
    n = F.count(_c(t))
    return F.when(n > features + 1, 1 - (1 - r2(t, p)) * (n - 1) / (n - features - 1))


def mape(t, p) -> Column:
    """In percent, over rows whose truth is not 0."""
    return F.avg(F.when(_c(t) != 0, F.abs(_error(t, p) / _c(t)))) * 100


def median_absolute_error(t, p) -> Column:
    """For groups; it keeps each different error of a group in one buffer. ``median_error`` is for whole tables."""
    return F.median(F.abs(_error(t, p)))


def median_error(df: DataFrame, t, p) -> float:
    """The median absolute error of a table of any size; null without errors."""
    return quantiles(df, {"error": F.abs(_error(t, p))}, (0.5,))["error"][0]


def max_error(t, p) -> Column:
    return F.max(F.abs(_error(t, p)))


def explained_variance(t, p) -> Column:
    all_ = F.var_pop(_c(t))
    return F.when(all_ > 0, 1 - F.var_pop(_error(t, p)) / all_).when(F.var_pop(_error(t, p)) == 0, 1.0).otherwise(0.0)


# -- clusterings ----------------------------------------------------------------------------------------------------


def _entropy(table: DataFrame, keys: list[str], n: DataFrame) -> DataFrame:
    g = table.groupBy(*keys).agg(F.sum("n").alias("m")).crossJoin(F.broadcast(n))
    return g.agg((-F.sum(F.col("m") / F.col("all") * F.ln(F.col("m") / F.col("all")))).alias("h"))


def clustering_scores(df: DataFrame, t: str, p: str) -> DataFrame:
    """One row: ari, nmi (arithmetic), homogeneity, completeness, v_measure, fowlkes_mallows; from the contingency table."""
    table = confusion(df, t, p)
    n = table.agg(F.sum("n").alias("all"))
    pairs = lambda keys: table.groupBy(*keys).agg(F.sum("n").cast("double").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("x"))
    one = n
    for name, keys in (("joint", ["truth", "prediction"]), ("rows", ["truth"]), ("cols", ["prediction"])):
        one = one.crossJoin(F.broadcast(pairs(keys).withColumnRenamed("x", f"p_{name}"))).crossJoin(F.broadcast(_entropy(table, keys, n).withColumnRenamed("h", f"h_{name}")))
    p_all = F.col("all") * (F.col("all") - 1) / 2
    expected, top = F.col("p_rows") * F.col("p_cols") / p_all, (F.col("p_rows") + F.col("p_cols")) / 2
    mutual = F.col("h_rows") + F.col("h_cols") - F.col("h_joint")
    homogeneity, completeness = _ratio(mutual, F.col("h_rows"), 1.0), _ratio(mutual, F.col("h_cols"), 1.0)
    return one.select(
        F.when(top == expected, 1.0).otherwise((F.col("p_joint") - expected) / (top - expected)).alias("ari"), _ratio(mutual, (F.col("h_rows") + F.col("h_cols")) / 2, 1.0).alias("nmi"),
        homogeneity.alias("homogeneity"), completeness.alias("completeness"), _ratio(2 * homogeneity * completeness, homogeneity + completeness).alias("v_measure"),
        _ratio(F.col("p_joint"), F.sqrt(F.col("p_rows") * F.col("p_cols"))).alias("fowlkes_mallows"),
    )


def adjusted_mutual_info(df: DataFrame, t: str, p: str) -> float:
    """With the exact expected mutual information, from the marginals on the driver."""
    rows = confusion(df, t, p).collect()
    a, b = {}, {}
    for r in rows:
        a[r.truth], b[r.prediction] = a.get(r.truth, 0) + r.n, b.get(r.prediction, 0) + r.n
    n = sum(a.values())
    mutual = sum(r.n / n * math.log(n * r.n / (a[r.truth] * b[r.prediction])) for r in rows)
    g, expected = lambda k: math.lgamma(k + 1), 0.0
    for x in a.values():
        for y in b.values():
            for k in range(max(1, x + y - n), min(x, y) + 1):
                ways = g(x) + g(y) + g(n - x) + g(n - y) - g(n) - g(k) - g(x - k) - g(y - k) - g(n - x - y + k)
                expected += k / n * math.log(n * k / (x * y)) * math.exp(ways)
    h = [-sum(v / n * math.log(v / n) for v in m.values()) for m in (a, b)]
    top = sum(h) / 2 - expected
    return 1.0 if abs(top) < 1e-15 else (mutual - expected) / top


def _centroids(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("__n"), *(F.avg(c).alias(f"__m_{c}") for c in features))


def calinski_harabasz(df: DataFrame, features: list[str], label: str) -> float:
    own = df.join(_centroids(df, features, label), label)
    within = own.agg(F.sum(sum((F.col(c) - F.col(f"__m_{c}")) ** 2 for c in features))).first()[0]
    s = df.agg(F.count("*").alias("n"), F.count_distinct(label).alias("k"), sum(F.var_pop(c) for c in features).alias("v")).first()
    if s.k < 2 or not within:
        return 0.0
    return (s.v * s.n - within) / (s.k - 1) / (within / (s.n - s.k))


def davies_bouldin(df: DataFrame, features: list[str], label: str) -> float:
    mid = _centroids(df, features, label)
    spread = df.join(mid, label).groupBy(label).agg(F.avg(F.sqrt(sum((F.col(c) - F.col(f"__m_{c}")) ** 2 for c in features))).alias("s")).join(mid, label).collect()
    worst = []
    for x in spread:
        others = [(x["s"] + y["s"]) / d if (d := math.dist([x[f"__m_{c}"] for c in features], [y[f"__m_{c}"] for c in features])) else INF for y in spread if y[label] != x[label]]
        worst.append(max(others, default=0.0))
    return sum(worst) / max(1, len(worst))


def silhouette(df: DataFrame, features: list[str], label: str, key: str, block_rows: int = 32_000) -> DataFrame:
    """(key, silhouette) by Euclidean distances: exact, every row against all rows in blocks of bounded size.

    The work is quadratic by definition. Each pair of blocks meets once, in a task that holds the two and returns a sum
    a row and cluster for both; distances are products of matrices. Blocks are smaller where clusters are many.
    """
    import numpy as np
    import pandas as pd

    rows = df.select(F.col(key).alias("k"), F.col(label).alias("c"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)))
    sizes = rows.groupBy(F.col("c").alias("o")).agg(F.count("*").alias("n"))
    size = sizes.agg(F.sum("n").alias("rows"), F.count("*").alias("clusters")).first()
    n = size["rows"] or 0
    most = min(block_rows, max(1_000, 4_000_000 // max(1, size["clusters"])))
    blocks = max(1, math.ceil(n / most), min(12, n // 2_000))  # some for each core of a cluster, even of few rows
    rows = rows.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    left = rows.withColumn("q", F.explode(F.sequence(F.col("b"), F.lit(blocks - 1)))).withColumnRenamed("b", "p")
    right = rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("b")))).withColumnRenamed("b", "q")
    names = [f"x{i}" for i in range(len(features))]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def distances(pair: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"k": [], "c": [], "o": [], "d": []})
        (own, at), (others, to) = (np.unique(side["c"].to_numpy(), return_inverse=True) for side in (a, b))
        of_a, of_b = np.eye(len(own))[at], np.eye(len(others))[to]
        squares = pairwise.Squares(a[names].to_numpy(float), b[names].to_numpy(float))
        ours, theirs = np.zeros((len(a), len(others))), np.zeros((len(b), len(own)))
        for s in range(0, len(a), 256):
            for t in range(0, len(b), 2_048):
                e, f = min(len(a), s + 256), min(len(b), t + 2_048)
                d = squares.block(s, e, t, f)
                np.sqrt(d, out=d)
                ours[s:e] += d @ of_b[t:f]
                if pair[0] != pair[1]:
                    theirs[t:f] += d.T @ of_a[s:e]
        sums = [(a, others, ours)] + ([(b, own, theirs)] if pair[0] != pair[1] else [])
        return pd.concat([pd.DataFrame({"k": np.repeat(x["k"].to_numpy(), len(o)), "c": np.repeat(x["c"].to_numpy(), len(o)), "o": np.tile(o, len(x)), "d": d.ravel()}) for x, o, d in sums])

    sums = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(distances, f"k {kinds['k']}, c {kinds['c']}, o {kinds['c']}, d double")
    means = sums.groupBy("k", "c", "o").agg(F.sum("d").alias("d")).join(sizes, "o")
    own = F.max(F.when((F.col("o") == F.col("c")) & (F.col("n") > 1), F.col("d") / (F.col("n") - 1)))
    other = F.min(F.when(F.col("o") != F.col("c"), F.col("d") / F.col("n")))
    out = means.groupBy("k").agg(own.alias("a"), other.alias("b"))
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(_ratio(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return out.select(F.col("k").alias(key), score.alias("silhouette"))


def report(df: DataFrame, t: str, p: str) -> str:
    """A text table of per_class, for people."""
    rows = per_class(df, t, p).orderBy("label").collect()
    lines = [f"{'':>12} {'precision':>10} {'recall':>10} {'f1':>10} {'support':>10}"]
    return "\n".join([*lines, *(f"{r.label!s:>12} {r.precision:>10.2f} {r.recall:>10.2f} {r.f1:>10.2f} {r.support:>10}" for r in rows)])
