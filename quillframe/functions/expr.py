"""Element-wise functions on columns with IEEE results (1/0 is infinite, the logarithm of 0 minus infinity), which ANSI mode denies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def col(value: Column | str | float) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(float(value))


def _d(value: Column | str | float) -> Column:
    return col(value).cast("double")


def is_nan(value) -> Column:
    return F.isnan(_d(value))


def is_inf(value) -> Column:
    return F.abs(_d(value)) == INF


def is_finite(value) -> Column:
    return ~is_nan(value) & (F.abs(_d(value)) < INF)


def add(a, b) -> Column:
    return col(a) + col(b)


def sub(a, b) -> Column:
    return col(a) - col(b)


def mul(a, b) -> Column:
    return col(a) * col(b)


def add_scalar(value, scalar: float) -> Column:
    return col(value) + F.lit(scalar)


def mul_scalar(value, scalar: float) -> Column:
    return col(value) * F.lit(scalar)


def absolute(value) -> Column:
    return F.abs(col(value))


def div(a, b) -> Column:
    a, b = _d(a), _d(b)
    by_zero = F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def floor_div(a, b) -> Column:
    return floor(div(a, b))


def floor(value) -> Column:
    v = _d(value)
    return F.when(is_finite(v) & (F.abs(v) < 2.0**53), F.floor(v).cast("double")).otherwise(v)


def ceil(value) -> Column:
    return -floor(-_d(value))


def round_half_up(value) -> Column:
    """To the nearest integer, halves towards plus infinity."""
    return floor(_d(value) + 0.5)


def trunc(value) -> Column:
    v = _d(value)
    return F.when(v < 0, ceil(v)).otherwise(floor(v))


def mod(a, b) -> Column:
    """a - floor(a / b) * b: the sign follows b."""
    a, b = _d(a), _d(b)
    return F.when(b == 0, NAN).otherwise(a - floor_div(a, b) * b)


def neg(value) -> Column:
    return -col(value)


def sign(value) -> Column:
    return F.signum(_d(value))


def reciprocal(value) -> Column:
    return div(1.0, value)


def _either(a: Column, b: Column, pick) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), NAN).when(a.isNull() | b.isNull(), None).otherwise(pick(a, b))


def maximum(a, b) -> Column:
    return _either(_d(a), _d(b), F.greatest)


def minimum(a, b) -> Column:
    return _either(_d(a), _d(b), F.least)


def clip(value, lower: float | None = None, upper: float | None = None) -> Column:
    v = _d(value)
    out = v if upper is None else F.when((v > upper) & ~F.isnan(v), float(upper)).otherwise(v)
    return out if lower is None else F.when(v < lower, float(lower)).otherwise(out)


def log(value) -> Column:
    v = _d(value)
    return F.when(v < 0, NAN).when(v == 0, -INF).otherwise(F.ln(v))


def log2(value) -> Column:
    v = _d(value)
    return F.when(v < 0, NAN).when(v == 0, -INF).otherwise(F.log2(v))


def log10(value) -> Column:
    v = _d(value)
    return F.when(v < 0, NAN).when(v == 0, -INF).otherwise(F.log10(v))


def log1p(value) -> Column:
    v = _d(value)
    return F.when(v < -1, NAN).when(v == -1, -INF).otherwise(F.log1p(v))


def sqrt(value) -> Column:
    return F.sqrt(_d(value))


def square(value) -> Column:
    return col(value) * col(value)


def rsqrt(value) -> Column:
    return div(1.0, sqrt(value))


def cbrt(value) -> Column:
    return F.cbrt(_d(value))


def exp(value) -> Column:
    return F.exp(_d(value))


def expm1(value) -> Column:
    return F.expm1(_d(value))


def exp2(value) -> Column:
    return F.pow(F.lit(2.0), _d(value))


def power(a, b) -> Column:
    return F.pow(_d(a), _d(b))


# -- trigonometry ----------------------------------------------------------------------------------------------------


def sin(value) -> Column:
    return F.sin(_d(value))


def cos(value) -> Column:
    return F.cos(_d(value))


def tan(value) -> Column:
    return F.tan(_d(value))


def asin(value) -> Column:
    """NaN outside -1 to 1, as the other functions with a limited domain."""
    return F.asin(_d(value))


def acos(value) -> Column:
    return F.acos(_d(value))


def atan(value) -> Column:
    return F.atan(_d(value))


def atan2(y, x) -> Column:
    return F.atan2(_d(y), _d(x))


def sinh(value) -> Column:
    return F.sinh(_d(value))


def cosh(value) -> Column:
    return F.cosh(_d(value))


def tanh(value) -> Column:
    return F.tanh(_d(value))


def asinh(value) -> Column:
    """Odd by its sign, as the logarithm loses the digits of large negative values."""
    v = _d(value)
    return F.signum(v) * F.asinh(F.abs(v))


def acosh(value) -> Column:
    return F.acosh(_d(value))


def atanh(value) -> Column:
    return F.atanh(_d(value))


# -- activations ----------------------------------------------------------------------------------------------------


def sigmoid(value) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_d(value)))


def relu(value) -> Column:
    v = _d(value)
    return F.when(v > 0, v).otherwise(0.0)


def leaky_relu(value, alpha: float = 0.01) -> Column:
    v = _d(value)
    return F.when(v > 0, v).otherwise(v * alpha)


def elu(value, alpha: float = 1.0) -> Column:
    v = _d(value)
    return F.when(v > 0, v).otherwise(F.expm1(v) * alpha)


def gelu(value) -> Column:
    """The tanh approximation."""
    v = _d(value)
    return v * 0.5 * (F.tanh((v + v * v * v * 0.044715) * 0.7978845608028654) + 1.0)


def softplus(value) -> Column:
    v = _d(value)
    return F.when(v > 0, v + F.log1p(F.exp(-v))).otherwise(F.log1p(F.exp(v)))


def swish(value) -> Column:
    v = _d(value)
    return v / (F.lit(1.0) + F.exp(-v))


def mish(value) -> Column:
    return _d(value) * F.tanh(softplus(value))


# -- comparison and logic -------------------------------------------------------------------------------------------


def _compared(a, b, how) -> Column:
    a, b = _d(a), _d(b)
    return how(a, b) & ~F.isnan(a) & ~F.isnan(b)


def equal(a, b) -> Column:
    return _compared(a, b, lambda x, y: x == y)


def not_equal(a, b) -> Column:
    return ~equal(a, b)


def greater(a, b) -> Column:
    return _compared(a, b, lambda x, y: x > y)


def greater_equal(a, b) -> Column:
    return _compared(a, b, lambda x, y: x >= y)


def less(a, b) -> Column:
    return _compared(a, b, lambda x, y: x < y)


def less_equal(a, b) -> Column:
    return _compared(a, b, lambda x, y: x <= y)


def is_close(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    a, b = _d(a), _d(b)
    near = less_equal(F.abs(a - b), F.abs(b) * rtol + atol)
    return F.when(is_inf(a) | is_inf(b), F.lit(False)).otherwise(near)  # infinite minus infinite is no number


def all_close(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """An aggregate: every row close; true for no rows."""
    return F.coalesce(F.bool_and(is_close(a, b, rtol, atol)), F.lit(True))


def array_equal(a, b) -> Column:
    return F.coalesce(F.bool_and(equal(a, b)), F.lit(True))


def truthy(value) -> Column:
    v = _d(value)
    return (v != 0) | F.isnan(v)


def logical_and(a, b) -> Column:
    return truthy(a) & truthy(b)


def logical_or(a, b) -> Column:
    return truthy(a) | truthy(b)


def logical_xor(a, b) -> Column:
    return truthy(a) != truthy(b)


def logical_not(a) -> Column:
    return ~truthy(a)
