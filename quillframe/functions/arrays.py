"""Functions on one array of numbers a row, and on matrices as rows (i, j, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A = "array<double>"


def _a(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast(A)


def total(a) -> Column:
    return F.aggregate(_a(a), F.lit(0.0), lambda s, x: s + x)


def product(a) -> Column:
    return F.aggregate(_a(a), F.lit(1.0), lambda s, x: s * x)


def mean(a) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(float("nan"))


def variance(a, ddof: int = 0) -> Column:
    """Two passes, as one pass loses digits."""
    squares = F.transform(F.array(mean(a)), lambda m: F.aggregate(_a(a), F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))
    return F.when(F.size(a) > ddof, F.get(squares, 0) / (F.size(a) - ddof))


def std(a, ddof: int = 0) -> Column:
    return F.sqrt(variance(a, ddof))


def smallest(a) -> Column:
    return F.when(F.exists(_a(a), F.isnan), float("nan")).otherwise(F.array_min(_a(a)))


def largest(a) -> Column:
    return F.array_max(_a(a))  # NaN is the largest


def median(a) -> Column:
    n, s = F.size(a), F.array_sort(_a(a))
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def cumsum(a) -> Column:
    start = F.array().cast(A)
    return F.aggregate(_a(a), start, lambda s, x: F.array_append(s, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + x))


def cumprod(a) -> Column:
    start = F.array().cast(A)
    return F.aggregate(_a(a), start, lambda s, x: F.array_append(s, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(1.0)) * x))


def diff(a, n: int = 1) -> Column:
    """The n-th difference of neighbours, n shorter."""
    out = _a(a)
    for _ in range(n):
        size = F.greatest(F.size(out) - 1, F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(2), size), F.slice(out, F.lit(1), size), lambda x, y: x - y)
    return out


def any_true(a) -> Column:
    return F.exists(_a(a), lambda x: x != 0)


def all_true(a) -> Column:
    return F.forall(_a(a), lambda x: x != 0)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_a(a), _a(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a, p: float = 2) -> Column:
    if p == float("inf"):
        return F.array_max(F.transform(_a(a), F.abs))
    if p == 1:
        return F.aggregate(_a(a), F.lit(0.0), lambda s, x: s + F.abs(x))
    if p == 2:
        return F.sqrt(F.aggregate(_a(a), F.lit(0.0), lambda s, x: s + x * x))
    return F.pow(F.aggregate(_a(a), F.lit(0.0), lambda s, x: s + F.pow(F.abs(x), F.lit(p))), F.lit(1 / p))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def softmax(a) -> Column:
    e = F.transform(F.array(F.array_max(_a(a))), lambda m: F.transform(_a(a), lambda x: F.exp(x - m)))
    return F.get(F.transform(e, lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda s, y: s + y))), 0)


def log_softmax(a) -> Column:
    top = F.array(F.array_max(_a(a)))
    return F.get(F.transform(top, lambda m: F.transform(_a(a), lambda x: x - m - F.ln(F.aggregate(_a(a), F.lit(0.0), lambda s, y: s + F.exp(y - m))))), 0)


def arg_extreme(a, largest: bool) -> Column:
    """The first position of the largest or smallest value, from 0."""
    pick = F.array_max(_a(a)) if largest else F.array_min(_a(a))
    return F.array_position(_a(a), pick).cast("long") - 1


def argsort(a, descending: bool = False) -> Column:
    """Positions in ascending order of values, ties by position; descending is the exact reverse."""
    order = F.transform(F.array_sort(F.transform(_a(a), lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])
    return F.reverse(order) if descending else order


def sort(a, descending: bool = False) -> Column:
    return F.sort_array(_a(a), not descending)


def tile(a, n: int) -> Column:
    return F.flatten(F.array_repeat(a, n))


def repeat(a, n: int) -> Column:
    return F.flatten(F.transform(a, lambda x: F.array_repeat(x, n)))


def split(a, sections: int) -> Column:
    """Equal sections; an error where they would not be equal."""
    size = F.size(a)
    width = F.when(size % sections == 0, (size / sections).cast("int")).otherwise(F.raise_error(F.lit("sections are not equal")).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(sections - 1)), lambda k: F.slice(a, k * width + 1, width))


def section(a, start: int | None = None, end: int | None = None, step: int = 1) -> Column:
    """a[start:end:step] with Python's rules, step positive."""
    size = F.size(a)
    bound = lambda v, default: default if v is None else F.least(F.greatest(size + v, F.lit(0)), size) if v < 0 else F.least(F.lit(v), size)
    low, high = bound(start, F.lit(0)), bound(end, size)
    part = F.slice(a, low + 1, F.greatest(high - low, F.lit(0)))
    return part if step == 1 else F.filter(part, lambda x, i: i % step == 0)


def gather(a, positions) -> Column:
    return F.transform(positions, lambda i: F.get(a, i))


# -- shapes ---------------------------------------------------------------------------------------------------------


def concatenate(*parts) -> Column:
    return F.concat(*map(_a, parts))


def stack(*parts) -> Column:
    """An array of arrays, of one length each."""
    first = F.size(_a(parts[0]))
    even = [F.when(F.size(_a(p)) == first, _a(p)).otherwise(F.raise_error(F.lit("the arrays differ in length")).cast(A)) for p in parts]
    return F.array(*even)


def reshape(a, rows: int, columns: int) -> Column:
    """A flat array as ``rows`` arrays of ``columns``; an error where the numbers do not fit."""
    fits = F.when(F.size(_a(a)) == rows * columns, _a(a)).otherwise(F.raise_error(F.lit("the shape does not fit")).cast(A))
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda k: F.slice(fits, k * columns + 1, F.lit(columns)))


def flatten(m) -> Column:
    return F.flatten(F.col(m) if isinstance(m, str) else m)


def transpose(m, columns: int) -> Column:
    """An array of arrays with rows and columns exchanged."""
    own = F.col(m) if isinstance(m, str) else m
    return F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda k: F.transform(own, lambda row: F.get(row, k)))


def unsqueeze(a) -> Column:
    """A leading axis of length 1."""
    return F.array(F.col(a) if isinstance(a, str) else a)


def squeeze(m) -> Column:
    """Without a leading axis of length 1; an error where it is longer."""
    own = F.col(m) if isinstance(m, str) else m
    return F.when(F.size(own) == 1, F.get(own, 0)).otherwise(F.raise_error(F.lit("the axis is longer than 1")).cast(A))


def at(a, position: int) -> Column:
    """The value at a position, from the end if negative; an error outside."""
    return F.element_at(_a(a), position + 1 if position >= 0 else position)


def to_text(a, digits: int = 4) -> Column:
    """[1.0, 2.5]: numbers rounded, for people."""
    return F.concat(F.lit("["), F.array_join(F.transform(_a(a), lambda x: F.round(x, digits).cast("string")), ", "), F.lit("]"))


def from_text(value) -> Column:
    """An array of the numbers of a text such as [1.0, 2.5]; what is none is null."""
    own = F.col(value) if isinstance(value, str) else value
    parts = F.split(F.regexp_replace(own, r"^\s*\[|\]\s*$", ""), ",")
    return F.when(F.trim(F.regexp_replace(own, r"[\[\]]", "")) == "", F.array().cast(A)).otherwise(F.transform(parts, lambda x: F.trim(x).try_cast("double")))


# -- makers ---------------------------------------------------------------------------------------------------------


def linspace(start: float, stop: float, num: int = 50, endpoint: bool = True) -> Column:
    gaps = max(1, num - 1 if endpoint else num)
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)), lambda k: F.lit(float(start)) + k * ((stop - start) / gaps))


def logspace(start: float, stop: float, num: int = 50, base: float = 10.0) -> Column:
    return F.transform(linspace(start, stop, num), lambda x: F.pow(F.lit(base), x))


def geomspace(start: float, stop: float, num: int = 50) -> Column:
    import math

    if start * stop <= 0:
        raise ValueError("both ends must have one sign and not be zero")
    sign = 1.0 if start > 0 else -1.0
    return F.transform(linspace(math.log(abs(start)), math.log(abs(stop)), num), lambda x: F.exp(x) * sign)


def full(value: float, n: int) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def zeros(n: int) -> Column:
    return full(0.0, n)


def ones(n: int) -> Column:
    return full(1.0, n)


def empty(n: int) -> Column:
    """As zeros: there is no memory to leave unwritten."""
    return zeros(n)


def arange(start: float, stop: float | None = None, step: float = 1.0) -> Column:
    """start, start + step, ... before stop; from 0 where one bound is given."""
    import math

    low, high = (0.0, start) if stop is None else (start, stop)
    if step == 0:
        raise ValueError("the step must not be zero")
    n = max(0, math.ceil((high - low) / step))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(float(low)) + k * float(step)) if n else F.array().cast(A)


# -- matrices as (i, j, v) ------------------------------------------------------------------------------------------


def canonical(m: DataFrame) -> DataFrame:
    """Entries of one place summed, zeros dropped."""
    return m.groupBy("i", "j").agg(F.sum("v").alias("v")).where("v != 0")


def matrix_add(a: DataFrame, b: DataFrame, scale: float = 1.0) -> DataFrame:
    return canonical(a.select("i", "j", "v").unionAll(b.select("i", "j", F.col("v") * scale)))


def matrix_scale(a: DataFrame, by: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * by)


def matrix_hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "w"), ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """A join on the inner index and a sum for each cell, partly summed before its shuffle."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    return a.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


class Sparse:
    """A matrix of rows (i, j, v) and its shape: as large as a table may be, and one row an entry."""

    def __init__(self, df: DataFrame, shape: tuple[int, int]):
        self.df, self.shape = df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")), tuple(shape)

    @classmethod
    def from_coo(cls, df: DataFrame, shape: tuple[int, int]) -> Sparse:
        """Entries of one place are summed, zeros dropped; a place outside the shape is an error when read."""
        inside = (F.col("i") >= 0) & (F.col("i") < shape[0]) & (F.col("j") >= 0) & (F.col("j") < shape[1])
        v = F.when(inside, F.col("v")).otherwise(F.raise_error(F.lit("an entry lies outside the matrix")).cast("double"))
        return cls(canonical(df.select("i", "j", v.alias("v"))), shape)

    @property
    def rows(self) -> int:
        return self.shape[0]

    @property
    def cols(self) -> int:
        return self.shape[1]

    def nnz(self) -> int:
        return self.df.count()

    def get(self, i: int, j: int) -> float:
        """The entry at a place, 0 where there is none."""
        if not (0 <= i < self.rows and 0 <= j < self.cols):
            raise IndexError(f"({i}, {j}) lies outside {self.shape}")
        found = self.df.where((F.col("i") == i) & (F.col("j") == j)).first()
        return found.v if found else 0.0

    def copy(self) -> Sparse:
        return Sparse(self.df, self.shape)

    def to_dense(self) -> DataFrame:
        """(i, row): an array of doubles for each row, rows without entries too."""
        own = self.df.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
        every = self.df.sparkSession.range(self.rows).select(F.col("id").alias("i"))
        entries = F.coalesce("m", F.create_map().cast("map<bigint,double>"))
        row = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(self.cols - 1).cast("long")), lambda j: F.coalesce(F.try_element_at(entries, j), F.lit(0.0)))
        return every.join(own, "i", "left").select("i", row.alias("row"))

    def _same(self, other: Sparse) -> None:
        if self.shape != other.shape:
            raise ValueError(f"the shapes {self.shape} and {other.shape} differ")

    def add(self, other: Sparse) -> Sparse:
        self._same(other)
        return Sparse(matrix_add(self.df, other.df), self.shape)

    def sub(self, other: Sparse) -> Sparse:
        self._same(other)
        return Sparse(matrix_add(self.df, other.df, -1.0), self.shape)

    def scale(self, by: float) -> Sparse:
        return Sparse(matrix_scale(self.df, by), self.shape)

    def multiply(self, other: Sparse) -> Sparse:
        self._same(other)
        return Sparse(matrix_hadamard(self.df, other.df), self.shape)

    def matmul(self, other: Sparse) -> Sparse:
        if self.cols != other.rows:
            raise ValueError(f"the shapes {self.shape} and {other.shape} do not match")
        return Sparse(matmul(self.df, other.df), (self.rows, other.cols))

    def matvec(self, x: DataFrame) -> DataFrame:
        return matvec(self.df, x)

    def transpose(self) -> Sparse:
        return Sparse(matrix_transpose(self.df), (self.cols, self.rows))


def matrix_transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matrix_trace(a: DataFrame) -> DataFrame:
    return a.where("i = j").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("trace"))


def eye(spark, n: int, m: int | None = None, k: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") + k).alias("j"), F.lit(1.0).alias("v")).where((F.col("j") >= 0) & (F.col("j") < (m or n)))
