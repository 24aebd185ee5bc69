"""Errors that the library raises."""

from __future__ import annotations


class EngineError(Exception):
    """Root of the hierarchy."""


class InvalidParameterError(EngineError):
    def __init__(self, message: str, name: str | None = None, value: object = None):
        super().__init__(message)
        self.name, self.value = name, value


class ShapeError(EngineError):
    pass


class DataValidationError(EngineError):
    pass


class NotFittedError(EngineError):
    pass


class PositionError(EngineError, IndexError):
    pass


class ConvergenceError(EngineError):
    pass


class DTypeError(EngineError, TypeError):
    """A type that an operation does not take."""


class BroadcastError(ShapeError):
    """Shapes that do not broadcast to one."""


class CapacityError(EngineError):
    """More than fits where it has to."""


class DeviceError(EngineError):
    """A device that does not exist."""


class UnsupportedError(EngineError, NotImplementedError):
    """A feature that this engine does not have."""
