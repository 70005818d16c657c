"""Scores for every row of a DataFrame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .network import ModelSpec, forward


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix, without going through Python objects."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width or column.null_count:
        raise ValueError(f"expected {width} values in each of {len(column)} rows, got {len(flat)}")
    return flat.reshape(len(column), width).astype(np.float64, copy=False)


def rows_of(values: np.ndarray) -> pa.Array:
    """A matrix as an Arrow column of lists."""
    n, width = values.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).reshape(-1)))


def row_blocks(batches, rows: int):
    """Arrow batches cut to at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def share(df: DataFrame, params: list[np.ndarray] | Broadcast) -> Broadcast:
    """Parameters for the tasks; a caller that reuses or frees the broadcast makes it itself."""
    return params if isinstance(params, Broadcast) else df.sparkSession.sparkContext.broadcast(params)


def score(df: DataFrame, model: ModelSpec, params: list[np.ndarray] | Broadcast, keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``scores``; dropout is off.  Everything else is pruned before Python."""
    source = df.select(*keep, "features")
    shared = share(df, params)
    schema = T.StructType([*source.select(*keep).schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in row_blocks(batches, model.block_rows):
            scores, _ = forward(model, shared.value, matrix(batch.column("features"), model.n_in))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], rows_of(scores)], [*keep, "scores"])

    return source.mapInArrow(run, schema)
