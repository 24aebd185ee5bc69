"""Scalers, encoders and splits: fitting is one aggregate, transforming is column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.errors import DataValidationError, InvalidParameterError, NotFittedError
from quillframe.functions.quantiles import quantiles
from quillframe.functions.special import NORMAL_A
from quillframe.plans import ordering


class Scaler:
    """(value - shift) / scale for each column; subclasses say how both come about."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)
        self.shift: dict[str, float] = {}
        self.scale: dict[str, float] = {}

    def _aggregates(self, c: str) -> list[Column]:
        raise NotImplementedError

    def _derive(self, values: Sequence[float]) -> tuple[float, float]:
        raise NotImplementedError

    def fit(self, df: DataFrame) -> Scaler:
        asked = [self._aggregates(c) for c in self.columns]
        row = df.agg(*(a.alias(f"a{i}_{j}") for i, group in enumerate(asked) for j, a in enumerate(group))).first()
        for i, c in enumerate(self.columns):
            self.shift[c], self.scale[c] = self._derive([row[f"a{i}_{j}"] for j in range(len(asked[i]))])
        return self

    def _fitted(self) -> None:
        if not self.scale:
            raise NotFittedError("fit comes first")

    def transform(self, df: DataFrame) -> DataFrame:
        self._fitted()
        return df.withColumns({c: (F.col(c) - F.lit(self.shift[c])) / F.lit(self.scale[c]) for c in self.columns})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self._fitted()
        return df.withColumns({c: F.col(c) * F.lit(self.scale[c]) + F.lit(self.shift[c]) for c in self.columns})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class StandardScaler(Scaler):
    def __init__(self, columns: Sequence[str], with_mean: bool = True, with_std: bool = True):
        super().__init__(columns)
        self.with_mean, self.with_std = with_mean, with_std

    def _aggregates(self, c):
        return [F.avg(c), F.stddev_pop(c)]

    def _derive(self, values):
        return (values[0] if self.with_mean else 0.0), (values[1] or 1.0) if self.with_std else 1.0


class MinMaxScaler(Scaler):
    def __init__(self, columns: Sequence[str], feature_range: tuple[float, float] = (0.0, 1.0), clip: bool = False):
        super().__init__(columns)
        if feature_range[0] >= feature_range[1]:
            raise InvalidParameterError("the range ascends", "feature_range", feature_range)
        self.low, self.high, self.clip = *feature_range, clip

    def _aggregates(self, c):
        return [F.min(c).cast("double"), F.max(c).cast("double")]

    def _derive(self, values):
        scale = ((values[1] - values[0]) or 1.0) / (self.high - self.low)
        return values[0] - self.low * scale, scale

    def transform(self, df):
        out = super().transform(df)
        return out.withColumns({c: F.least(F.greatest(c, F.lit(self.low)), F.lit(self.high)) for c in self.columns}) if self.clip else out


class MaxAbsScaler(Scaler):
    def _aggregates(self, c):
        return [F.max(F.abs(c)).cast("double")]

    def _derive(self, values):
        return 0.0, values[0] or 1.0


class RobustScaler(Scaler):
    def __init__(self, columns: Sequence[str], quantile_range: tuple[float, float] = (25.0, 75.0)):
        super().__init__(columns)
        self.quantile_range = quantile_range

    def fit(self, df):
        found = quantiles(df, {c: F.col(c) for c in self.columns}, [x / 100 for x in (self.quantile_range[0], 50.0, self.quantile_range[1])])
        for c, (low, middle, high) in found.items():
            self.shift[c], self.scale[c] = middle, (high - low) or 1.0
        return self


def normalize(df: DataFrame, columns: Sequence[str], norm: str = "l2") -> DataFrame:
    """Rows to unit length; rows of zeros stay."""
    parts = [F.abs(F.col(c)) for c in columns]
    size = {"l1": sum(parts, F.lit(0.0)), "l2": F.sqrt(sum((p * p for p in parts), F.lit(0.0))), "max": F.greatest(*parts) if len(parts) > 1 else parts[0]}[norm]
    return df.withColumn("__size", size).withColumns({c: F.when(F.col("__size") > 0, F.col(c) / F.col("__size")).otherwise(F.col(c)) for c in columns}).drop("__size")


class QuantileTransformer:
    """Values to their place among fitted quantiles, uniform or normal; beyond the ends 0 or 1."""

    def __init__(self, columns: Sequence[str], n_quantiles: int = 1000, output: str = "uniform"):
        self.columns, self.n, self.output = list(columns), n_quantiles, output
        self.quantiles: dict[str, list[float]] = {}

    def fit(self, df: DataFrame) -> QuantileTransformer:
        found = quantiles(df, {c: F.col(c) for c in self.columns}, [k / (self.n - 1) for k in range(self.n)])
        self.quantiles = {c: [float(x) for x in found[c]] for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.quantiles:
            raise NotFittedError("fit comes first")
        return df.withColumns({c: self._place(F.col(c).cast("double"), self.quantiles[c]) for c in self.columns})

    def _place(self, value: Column, q: list[float]) -> Column:
        def tree(low: int, high: int) -> Column:  # q[low] <= value < q[high]
            if high - low == 1:
                width = q[high] - q[low]
                return ((value - q[low]) / width + low if width else F.lit(float(low))) / (self.n - 1)
            mid = (low + high) // 2
            return F.when(value < q[mid], tree(low, mid)).otherwise(tree(mid, high))

        uniform = F.when(value <= q[0], 0.0).when(value >= q[-1], 1.0).otherwise(tree(0, len(q) - 1))
        if self.output == "uniform":
            return uniform
        p = F.least(F.greatest(uniform, F.lit(1e-7)), F.lit(1 - 1e-7))
        z = 2 * p - 1
        log = F.ln(1 - z * z)
        part = F.lit(2 / (math.pi * NORMAL_A)) + log / 2
        return F.signum(z) * F.sqrt(F.sqrt(part * part - log / NORMAL_A) - part) * math.sqrt(2)


class PowerTransformer:
    """Yeo-Johnson or Box-Cox with the most likely exponent, by golden section; each probe of all columns is one aggregate."""

    def __init__(self, columns: Sequence[str], method: str = "yeo-johnson", standardize: bool = True, rounds: int = 40):
        self.columns, self.method, self.standardize, self.rounds = list(columns), method, standardize, rounds
        self.lambdas: dict[str, float] = {}

    def _power(self, x: Column, lam: float) -> Column:
        if self.method == "box-cox":
            return F.ln(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam
        up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
        down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
        return F.when(x >= 0, up).otherwise(down)

    def _likelihoods(self, df: DataFrame, at: dict[str, float]) -> dict[str, float]:
        out = []
        for c, lam in at.items():
            x = F.col(c).cast("double")
            jacobian = F.sum(F.ln(x)) if self.method == "box-cox" else F.sum(F.signum(x) * F.log1p(F.abs(x)))
            out.append((-F.count(x) / 2 * F.ln(F.var_pop(self._power(x, lam))) + (lam - 1) * jacobian).alias(c))
        return {c: v if v is not None else -math.inf for c, v in df.agg(*out).first().asDict().items()}

    def fit(self, df: DataFrame) -> PowerTransformer:
        ratio = (math.sqrt(5) - 1) / 2
        low, high = dict.fromkeys(self.columns, -5.0), dict.fromkeys(self.columns, 5.0)
        left = {c: high[c] - ratio * (high[c] - low[c]) for c in self.columns}
        right = {c: low[c] + ratio * (high[c] - low[c]) for c in self.columns}
        f_left, f_right = self._likelihoods(df, left), self._likelihoods(df, right)
        for _ in range(self.rounds):
            probe = {}
            for c in self.columns:
                if f_left[c] >= f_right[c]:
                    high[c], right[c], f_right[c] = right[c], left[c], f_left[c]
                    left[c] = probe[c] = high[c] - ratio * (high[c] - low[c])
                else:
                    low[c], left[c], f_left[c] = left[c], right[c], f_right[c]
                    right[c] = probe[c] = low[c] + ratio * (high[c] - low[c])
            found = self._likelihoods(df, probe)
            for c in self.columns:
                if probe[c] == left[c]:
                    f_left[c] = found[c]
                else:
                    f_right[c] = found[c]
        self.lambdas = {c: (low[c] + high[c]) / 2 for c in self.columns}
        if self.standardize:
            self._scaler = StandardScaler(self.columns).fit(self._raw(df))
        return self

    def _raw(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self._power(F.col(c).cast("double"), self.lambdas[c]) for c in self.columns})

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.lambdas:
            raise NotFittedError("fit comes first")
        return self._scaler.transform(self._raw(df)) if self.standardize else self._raw(df)


# -- encoders -------------------------------------------------------------------------------------------------------


class OrdinalEncoder:
    """Sorted classes to 0, 1, ...; a class that was not fitted is an error or ``unknown``. Classes are joined, not collected."""

    def __init__(self, columns: Sequence[str], unknown: int | None = None):
        self.columns, self.unknown = list(columns), unknown
        self.codes: dict[str, DataFrame] = {}

    def fit(self, df: DataFrame) -> OrdinalEncoder:
        for c in self.columns:
            classes = df.select(F.col(c).alias("__class")).where("__class is not null").distinct()
            self.codes[c] = ordering.numbered(classes, ["__class"], "__code")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.codes:
            raise NotFittedError("fit comes first")
        names = df.columns
        for c in self.columns:
            other = F.lit(self.unknown) if self.unknown is not None else F.when(F.col(c).isNull(), None).otherwise(F.raise_error(F.lit(f"unknown class in {c}")))
            df = df.join(self.codes[c], F.col(c) == F.col("__class"), "left").withColumn(c, F.coalesce(F.col("__code").cast("double"), other.cast("double"))).drop("__class", "__code")
        return df.select(*names)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        names = df.columns
        for c in self.columns:
            df = df.join(self.codes[c], F.col(c) == F.col("__code"), "left").withColumn(c, F.col("__class")).drop("__class", "__code")
        return df.select(*names)


class LabelEncoder(OrdinalEncoder):
    def __init__(self, column: str):
        super().__init__([column])


class OneHotEncoder:
    """A 0/1 column for each sorted class (column_class); the classes become columns, so they are few by nature."""

    def __init__(self, columns: Sequence[str], drop_first: bool = False, most: int = 1000):
        self.columns, self.drop_first, self.most = list(columns), drop_first, most
        self.classes: dict[str, list] = {}

    def fit(self, df: DataFrame) -> OneHotEncoder:
        for c in self.columns:
            found = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(self.most + 1).collect())
            if len(found) > self.most:
                raise DataValidationError(f"{c} has more than {self.most} classes")
            self.classes[c] = found[1:] if self.drop_first else found
        return self

    def transform(self, df: DataFrame, yes: float = 1.0, no: float = 0.0) -> DataFrame:
        if not self.classes:
            raise NotFittedError("fit comes first")
        new = {f"{c}_{k}": F.when(F.col(c) == F.lit(k), yes).otherwise(no) for c, classes in self.classes.items() for k in classes}
        return df.withColumns(new).drop(*self.columns)


class LabelBinarizer(OneHotEncoder):
    def __init__(self, column: str, neg: float = 0.0, pos: float = 1.0):
        super().__init__([column])
        self.neg, self.pos = neg, pos

    def transform(self, df: DataFrame) -> DataFrame:
        return super().transform(df, self.pos, self.neg)


def multi_label_binarize(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{column}_{k}": F.array_contains(column, F.lit(k)).cast("int") for k in classes}).drop(column)


# -- splits ---------------------------------------------------------------------------------------------------------


def train_test_split(df: DataFrame, keys: Sequence[str], test_size: float = 0.25, seed: int = 0, stratify: str | None = None) -> DataFrame:
    """df with ``is_test``: exactly ceil(n * test_size) rows, or per class, in the order of a hash of the keys."""
    at = df.withColumn("__h", F.xxhash64(*keys, F.lit(seed)))
    if stratify:
        sizes = at.groupBy(F.col(stratify).alias("__s")).agg(F.count("*").alias("__n"))
        at = ordering.running(at, ["__h", *keys], {"__i": (F.lit(1), "count")}, [stratify]).join(sizes, F.col(stratify).eqNullSafe(F.col("__s"))).drop("__s")
    else:
        at = ordering.running(at, ["__h", *keys], {"__i": (F.lit(1), "count")}).crossJoin(F.broadcast(df.agg(F.count("*").alias("__n"))))
    train = F.floor(F.col("__n") * (1 - test_size) + 1e-9)
    return at.withColumn("is_test", F.col("__i") > train).select(*df.columns, "is_test")


def k_fold(df: DataFrame, order: Sequence[str], k: int = 5, stratify: str | None = None) -> DataFrame:
    """df with ``fold``: contiguous folds whose sizes differ by at most one, the larger first; or so in each class."""
    if k < 2:
        raise InvalidParameterError("two folds at least", "k", k)
    if stratify:
        sizes = df.groupBy(F.col(stratify).alias("__s")).agg(F.count("*").alias("__n"))
        at = ordering.running(df, order, {"__i": (F.lit(1), "count")}, [stratify]).join(sizes, F.col(stratify).eqNullSafe(F.col("__s"))).drop("__s")
    else:
        at = ordering.running(df, order, {"__i": (F.lit(1), "count")}).crossJoin(F.broadcast(df.agg(F.count("*").alias("__n"))))
    i, size, more = F.col("__i") - 1, F.floor(F.col("__n") / k), F.col("__n") % k
    fold = F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return at.withColumn("fold", fold.cast("int")).select(*df.columns, "fold")


def group_k_fold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """df with ``fold``: whole groups, the largest first onto the emptiest fold. The driver sees one size a group."""
    sizes = sorted(((r["n"], r[0]) for r in df.groupBy(group).agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[0], str(x[1])))
    load, at = [0] * k, []
    for n, g in sizes:
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] += n
        at.append((g, f))
    folds = df.sparkSession.createDataFrame(at, f"{group} {df.schema[group].dataType.simpleString()}, fold int")
    return df.join(folds, group)


def leave_one_out(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with ``fold``, the position of each row: every row is once the test."""
    return ordering.numbered(df, order, "fold")


def leave_p_out(n: int, p: int, most: int = 100_000) -> list[tuple[int, ...]]:
    """The test positions of every split, for small n."""
    from itertools import combinations

    if math.comb(n, p) > most:
        raise InvalidParameterError(f"more than {most} splits", "p", p)
    return list(combinations(range(n), p))
