"""What several corpus operators share: Arrow batches of texts, and columns evaluated once."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.plans.scratch import durable, scratch_dir, settled

__all__ = ["bound", "durable", "give_back", "row_key", "rows_of", "scratch_dir", "settled", "text_bytes"]


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"").cast("binary"))


def row_key(id_col: str, text_col: str) -> Column:
    """A 128-bit key of a row's id and text: few enough collisions for as many rows as there are."""
    halves = (F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)) for seed in (1, 2))
    return F.concat(*(F.unhex(F.lpad(F.hex(h), 16, "0")) for h in halves))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use, or a lambda in it, refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of Python values, a slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)
        del batch
    give_back()


def give_back() -> None:
    """Return freed memory to the system, as a Python worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
