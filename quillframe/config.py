"""Settings of the library, types of numbers, and checks of parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from quillframe.errors import BroadcastError, DataValidationError, DeviceError, DTypeError, InvalidParameterError, ShapeError

DTYPES = {"float32": "float", "float64": "double", "int32": "int", "int64": "bigint", "uint8": "smallint", "bool": "boolean", "string": "string"}
DEVICES = ("spark", "driver")
DEFAULTS = {"default_dtype": "float64", "device": "spark", "seed": None}
_settings = dict(DEFAULTS)


def get_config() -> dict:
    return dict(_settings)


def set_config(**values) -> None:
    for name, value in values.items():
        if name not in DEFAULTS:
            raise InvalidParameterError(f"unknown setting {name!r}", name, value)
        if name == "default_dtype" and value not in DTYPES:
            raise InvalidParameterError("unknown type", name, value)
        _settings[name] = value


def reset_config() -> None:
    _settings.update(DEFAULTS)


def set_seed(seed: int | None) -> None:
    set_config(seed=None if seed is None else integer(seed, "seed"))


def get_seed() -> int | None:
    return _settings["seed"]


def clear_seed() -> None:
    set_seed(None)


def set_device(device: str) -> None:
    set_config(device=valid_device(device))


def get_device() -> str:
    return _settings["device"]


def set_dtype(dtype: str) -> None:
    set_config(default_dtype=valid_dtype(dtype))


def get_dtype() -> str:
    return _settings["default_dtype"]


def is_device(value: object) -> bool:
    return isinstance(value, str) and value in DEVICES


def valid_device(value: object) -> str:
    if not is_device(value):
        raise DeviceError(f"no device {value!r}")
    return value


def valid_dtype(value: object) -> str:
    if not is_dtype(value):
        raise DTypeError(f"no type {value!r}")
    return value


def numeric_dtype(value: object) -> str:
    if valid_dtype(value) == "string":
        raise DTypeError("a type of numbers is needed")
    return value


def is_dtype(value: object) -> bool:
    return isinstance(value, str) and value in DTYPES


def spark_type(dtype: str) -> str:
    return DTYPES[one_of(dtype, list(DTYPES), "dtype")]


def normalize_axis(axis: int | str, ndim: int) -> int:
    names = {"index": 0, "rows": 0, "columns": 1}
    k = names.get(axis, axis) if isinstance(axis, str) else axis
    if not isinstance(k, int) or not -ndim <= k < ndim:
        raise InvalidParameterError(f"no axis {axis!r} of {ndim}", "axis", axis)
    return k % ndim


def positive(value: float, name: str) -> float:
    if not value > 0:
        raise InvalidParameterError(f"{name} must be positive", name, value)
    return value


def non_negative(value: float, name: str) -> float:
    if not value >= 0:
        raise InvalidParameterError(f"{name} must not be negative", name, value)
    return value


def in_range(value: float, low: float, high: float, name: str) -> float:
    if not low <= value <= high:
        raise InvalidParameterError(f"{name} lies between {low} and {high}", name, value)
    return value


def integer(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value) or abs(value) > 2**53:
        raise InvalidParameterError(f"{name} must be an integer", name, value)
    return int(value)


def one_of(value, allowed: Sequence, name: str):
    if value not in allowed:
        raise InvalidParameterError(f"{name} is one of {list(allowed)}", name, value)
    return value


def shape(value: Sequence[int]) -> tuple[int, ...]:
    return tuple(int(non_negative(integer(n, "shape"), "shape")) for n in value)


def size(of: Sequence[int]) -> int:
    return math.prod(shape(of))


def array(value: object, name: str, least: int = 0) -> list:
    """A list or tuple of at least so many entries."""
    if not isinstance(value, (list, tuple)):
        raise DataValidationError(f"{name} must be a list")
    if len(value) < least:
        raise DataValidationError(f"{name} has fewer than {least} entries")
    return list(value)


def dimension(of: Sequence[int], axis: int) -> int:
    """The length of an axis of a shape."""
    if not -len(of) <= axis < len(of):
        raise ShapeError(f"no axis {axis} of {len(of)}")
    return of[axis]


def broadcast_shape(a: Sequence[int], b: Sequence[int]) -> tuple[int, ...]:
    """The shape to which two shapes stretch: axes agree from the last on, or one of them is 1."""
    n = max(len(a), len(b))
    wide = [(1,) * (n - len(s)) + tuple(s) for s in (a, b)]
    if any(x != y and 1 not in (x, y) for x, y in zip(*wide, strict=True)):
        raise BroadcastError(f"{tuple(a)} and {tuple(b)} do not broadcast")
    return tuple(y if x == 1 else x for x, y in zip(*wide, strict=True))
