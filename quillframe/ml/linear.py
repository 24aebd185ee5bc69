"""Linear models. Least squares needs one aggregation, of the Gram matrix; gradient models one a step; data never leave the executors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.errors import NotFittedError


#: terms from which an expression of columns costs more to compile than a product of matrices takes over Arrow
WIDE = 128


def matrix_of(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """The named columns as doubles; nulls are NaN."""
    return np.column_stack([batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names])


def appended(df: DataFrame, features: Sequence[str], make: Callable[[np.ndarray], dict[str, np.ndarray]], fields: Sequence[T.StructField]) -> DataFrame:
    """df with the columns that ``make`` computes from a batch's features; columns of their names are replaced."""
    new = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in new]
    used = [f for f in features if f in new]
    df = df.withColumns({f"__own_{f}": F.col(f) for f in used}) if used else df
    names = [f"__own_{f}" if f in used else f for f in features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(matrix_of(batch, names))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(made[n]) for n in new)], names=[*(f.name for f in kept), *new])

    return df.mapInArrow(run, T.StructType([*kept, *fields]))


def _wide_gram(rows: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """As gram, by products of matrices a batch: the means first, then the moments around them, a row a task and cell."""
    one = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(names))).first()
    mean = np.array([one[f"m{i}"] or 0.0 for i in range(len(names))])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), len(names)))
        for batch in batches:
            x = matrix_of(batch, names) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

    found = {r.k: r.v for r in rows.mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    c = np.array([found.get(k, 0.0) for k in range(len(names) ** 2)]).reshape(len(names), len(names))
    return one.n, mean, (c + c.T) / 2


def gram(df: DataFrame, features: Sequence[str], target: str | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means, and centred second moments of features and target (in that order), by one aggregation, or two passes where they are many."""
    names = [*features, *([target] if target else [])]
    if len(names) ** 2 > WIDE:
        return _wide_gram(df.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna(), names)
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    asked = [F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in cells)]
    row = df.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna().agg(*asked).first()
    c = np.zeros((len(names), len(names)))
    for i, j in cells:
        c[i, j] = c[j, i] = (row[f"c{i}_{j}"] or 0.0) * row.n
    return row.n, np.array([row[f"m{i}"] or 0.0 for i in range(len(names))]), c


class LinearModel:
    def __init__(self, features: Sequence[str], target: str, fit_intercept: bool = True):
        self.features, self.target, self.fit_intercept = list(features), target, fit_intercept
        self.coef: np.ndarray | None = None
        self.intercept = 0.0

    def _moments(self, df: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        n, mean, c = gram(df, self.features, self.target)
        if not self.fit_intercept:
            c = c + n * np.outer(mean, mean)
        return n, mean, c[:-1, :-1], c[:-1, -1]

    def _finish(self, coef: np.ndarray, mean: np.ndarray) -> LinearModel:
        self.coef = coef
        self.intercept = float(mean[-1] - mean[:-1] @ coef) if self.fit_intercept else 0.0
        return self

    def decision(self) -> Column:
        if self.coef is None:
            raise NotFittedError("fit comes first")
        return sum((F.col(c) * float(w) for c, w in zip(self.features, self.coef, strict=True)), F.lit(float(self.intercept)))

    def predict(self, df: DataFrame, into: str = "prediction") -> DataFrame:
        return df.withColumn(into, self.decision())


class LinearRegression(LinearModel):
    """Least squares; the shortest solution where there are many."""

    def fit(self, df: DataFrame) -> LinearRegression:
        _, mean, xx, xy = self._moments(df)
        return self._finish(np.linalg.pinv(xx, hermitian=True) @ xy, mean)


class Ridge(LinearModel):
    def __init__(self, features, target, alpha: float = 1.0, fit_intercept: bool = True):
        super().__init__(features, target, fit_intercept)
        self.alpha = alpha

    def fit(self, df: DataFrame) -> Ridge:
        _, mean, xx, xy = self._moments(df)
        return self._finish(np.linalg.solve(xx + self.alpha * np.eye(len(xx)), xy), mean)


class Lasso(LinearModel):
    """Coordinate descent on the Gram matrix: half the mean squared error plus alpha times the absolute weights."""

    def __init__(self, features, target, alpha: float = 1.0, fit_intercept: bool = True, max_iter: int = 1000, tol: float = 1e-6, positive: bool = False):
        super().__init__(features, target, fit_intercept)
        self.alpha, self.max_iter, self.tol, self.positive = alpha, max_iter, tol, positive

    def fit(self, df: DataFrame) -> Lasso:
        n, mean, xx, xy = self._moments(df)
        w = np.zeros(len(xx))
        for _ in range(self.max_iter):
            before = w.copy()
            for k in range(len(w)):
                if xx[k, k] == 0:
                    continue
                rest = (xy[k] - xx[k] @ w + xx[k, k] * w[k]) / n
                step = math.copysign(max(abs(rest) - self.alpha, 0.0), rest) / (xx[k, k] / n)
                w[k] = max(step, 0.0) if self.positive else step
            if np.abs(w - before).max() <= self.tol:
                break
        return self._finish(w, mean)


class GradientModel(LinearModel):
    """Full-batch gradient descent from zero; one aggregation a step over a cached table."""

    def __init__(self, features, target, learning_rate: float = 0.1, max_iter: int = 100, tol: float = 1e-4, c: float = 1.0, fit_intercept: bool = True):
        super().__init__(features, target, fit_intercept)
        self.learning_rate, self.max_iter, self.tol, self.c = learning_rate, max_iter, tol, c

    def _slope(self, score: Column, y: Column) -> Column:
        """The derivative of a row's loss by its score."""
        raise NotImplementedError

    def fit(self, df: DataFrame) -> GradientModel:
        rows = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)), F.col(self.target).cast("double").alias("y")).dropna().persist()
        try:
            w, b = np.zeros(len(self.features)), 0.0
            for _ in range(self.max_iter):
                score = sum((F.col(f"x{i}") * float(v) for i, v in enumerate(w)), F.lit(float(b)))
                slope = rows.select("*", self._slope(score, F.col("y")).alias("s"))
                g = slope.agg(F.avg("s").alias("b"), *(F.avg(F.col("s") * F.col(f"x{i}")).alias(f"g{i}") for i in range(len(w)))).first()
                if g.b is None:
                    break
                gw = np.array([g[f"g{i}"] for i in range(len(w))]) + w / self.c
                w = w - self.learning_rate * gw
                b = b - self.learning_rate * g.b if self.fit_intercept else 0.0
                if max(np.abs(gw).max(initial=0), abs(g.b)) < self.tol:
                    break
        finally:
            rows.unpersist()
        self.coef, self.intercept = w, b
        return self


class LogisticRegression(GradientModel):
    """Two classes, 0 and 1; an L2 penalty of 1 / c on the weights."""

    def _slope(self, score, y):
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-score)) - y

    def predict_proba(self, df: DataFrame, into: str = "probability") -> DataFrame:
        return df.withColumn(into, F.lit(1.0) / (F.lit(1.0) + F.exp(-self.decision())))

    def predict(self, df: DataFrame, into: str = "prediction") -> DataFrame:
        return df.withColumn(into, (self.decision() >= 0).cast("int"))


class LinearSVC(GradientModel):
    """Hinge loss; classes 0 and 1."""

    def _slope(self, score, y):
        sign = F.when(y > 0, 1.0).otherwise(-1.0)
        return F.when(sign * score < 1, -sign).otherwise(0.0)

    def predict(self, df: DataFrame, into: str = "prediction") -> DataFrame:
        return df.withColumn(into, (self.decision() >= 0).cast("int"))


class LinearSVR(GradientModel):
    """Loss beyond epsilon of the target."""

    epsilon = 0.1

    def _slope(self, score, y):
        return F.when(F.abs(score - y) > self.epsilon, F.signum(score - y)).otherwise(0.0)


class OneVsRest:
    """One two-class model a class; the highest score decides."""

    def __init__(self, make, features: Sequence[str], target: str):
        self.make, self.features, self.target, self.models = make, list(features), target, {}

    def fit(self, df: DataFrame) -> OneVsRest:
        for label in sorted(r[0] for r in df.select(self.target).distinct().collect()):
            own = df.withColumn("__y", (F.col(self.target) == F.lit(label)).cast("double"))
            self.models[label] = self.make(self.features, "__y").fit(own)
        return self

    def predict(self, df: DataFrame, into: str = "prediction") -> DataFrame:
        best = F.array_max(F.array(*(F.struct(m.decision().alias("s"), F.lit(k).alias("k")) for k, m in self.models.items())))
        return df.withColumn(into, best["k"])
