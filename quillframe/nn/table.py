"""A model's forward pass over a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillframe.nn.autograd import Tensor, no_grad, tensor


def forward(df: DataFrame, model: Callable[[Tensor], Tensor], column: str, shape: Sequence[int], into: str = "output", rows: int = 1024) -> DataFrame:
    """df with ``into``: the model's output, flat, for each row's array, taken as an input of ``shape``.

    The model goes to the tasks; rows go through it in Arrow batches, without a shuffle. ``into`` replaces a column of
    that name.
    """
    kept = [f for f in df.schema.fields if f.name != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = np.stack(part.column(column).to_numpy(zero_copy_only=False)).astype(float).reshape(-1, *shape)
                with no_grad():
                    out = tensor(model(tensor(x))).data.reshape(len(x), -1)
                flat = pa.array(list(out), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), flat], names=[*(f.name for f in kept), into])

    schema = T.StructType([*kept, T.StructField(into, T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(run, schema)
