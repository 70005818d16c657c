"""Gradients as distributed sums over rows.

A batch gradient is a weighted sum of row gradients: weight 1 for cross-entropy (its batch
gradient is a sum), 1 / (rows x outputs) for the mean squared error.  The mean over the batches of
a group, or over all groups of a round, only changes the weights.  Rows therefore never move: each
task adds up what it holds and only parameter-sized partial sums are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .network import MSE, ModelSpec, dropout_mask, row_factors, weighted_gradient
from .params import KEYS, chunk_column, chunk_keys, tensors_of
from .scoring import matrix, row_blocks, share

_HELD_BYTES = 256 * 1024 * 1024  # partial sums a task keeps before it hands them on
_FAN = 64  # tasks whose sums are added up together before the last sum


def batch_weight(model: ModelSpec, batch_rows: Column | None = None) -> Column:
    """Weight of a row in the gradient of its own batch."""
    if model.loss == MSE:
        return 1.0 / (batch_rows * model.n_out)
    return F.lit(1.0)


def gradient_partials(
    df: DataFrame,
    model: ModelSpec,
    params: list[np.ndarray] | Broadcast,
    by: list[str],
    weight: Column,
    dropout_salt: int | None = None,
    version: str | None = None,
) -> DataFrame:
    """Partial sums ``(*by, layer, name, chunk, values, n_rows)``, several per group and task.

    ``by`` holds int columns.  With ``dropout_salt`` the last hidden layer drops units; the mask
    depends on ``row_hash`` and the salt, so a repeated task draws the same one.  With ``version``,
    an int column, ``params`` is a broadcast of parameter sets by version, and each row's gradient is taken at its own.
    """
    answer = model.answer
    drop = dropout_salt is not None and model.keep_prob < 1.0
    extra = ["row_hash"] if drop else []
    held_at = [] if version is None else [F.col(version).cast("int").alias("_version")]
    source = df.select(*[F.col(b).cast("int").alias(b) for b in by], *extra, *held_at, answer, "features", weight.cast("double").alias("_w"))
    shared = share(df, params)
    keys = chunk_keys(model)
    most_groups = max(1, _HELD_BYTES // model.size_bytes)
    schema = T.StructType(
        [T.StructField(b, T.IntegerType()) for b in by]
        + [T.StructField("layer", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("chunk", T.IntegerType())]
        + [T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("n_rows", T.LongType())]
    )

    def emit(group, total, rows):
        n = len(keys)
        columns = [pa.array(np.full(n, g, dtype=np.int32)) for g in group]
        columns += [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys], pa.int32())]
        columns += [chunk_column(total), pa.array(np.full(n, rows, dtype=np.int64))]
        return pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    def by_version(batches):
        """Blocks of rows and the parameters they are worked on with."""
        for batch in row_blocks(batches, model.block_rows):
            if version is None:
                yield batch, shared.value
                continue
            versions = batch.column("_version").to_numpy()
            for v in np.unique(versions):
                yield batch.filter(pa.array(versions == v)), shared.value[int(v)]

    def run(batches):
        held: dict[tuple, list] = {}
        for batch, values in by_version(batches):
            n = batch.num_rows
            y = batch.column(answer).to_numpy() if answer == "label" else matrix(batch.column(answer), model.n_out)
            mask = None
            if drop:
                mask = dropout_mask(batch.column("row_hash").to_numpy(), model.stages[-1].n_in, model.keep_prob, dropout_salt)
            _, factors = row_factors(model, values, matrix(batch.column("features"), model.n_in), y, mask)
            w = batch.column("_w").to_numpy()
            if by:
                ids = np.stack([batch.column(b).to_numpy() for b in by], axis=1)
                groups, member = np.unique(ids, axis=0, return_inverse=True)
                order = np.argsort(member.reshape(-1), kind="stable")
                cuts = np.searchsorted(member.reshape(-1)[order], np.arange(len(groups) + 1))
                pieces = [(tuple(map(int, g)), order[cuts[i] : cuts[i + 1]]) for i, g in enumerate(groups)]
            else:
                pieces = [((), slice(0, n))]
            for group, rows in pieces:
                part, n_rows = weighted_gradient(factors, rows, w), len(w[rows])
                if group in held:
                    total = held[group]
                    total[1] += n_rows
                    for t, p in zip(total[0], part):
                        t += p
                else:
                    if len(held) >= most_groups:
                        for g, (t, r) in held.items():
                            yield emit(g, t, r)
                        held.clear()
                    held[group] = [part, n_rows]
        for g, (t, r) in held.items():
            yield emit(g, t, r)

    return source.mapInArrow(run, schema)


def sum_values(df: DataFrame, by: list[str]) -> DataFrame:
    """Element-wise sum of ``values`` per ``(*by, layer, name, chunk)``, as a tree of two levels.

    Every task hands on its own sums; those of ``_FAN`` neighbouring tasks are added up first, then the sums of all
    neighbourhoods, so that no task adds up what all the others found.
    """
    total = vector_to_array(Summarizer.sum(array_to_vector(F.col("values"))))
    place = F.floor(F.spark_partition_id() / _FAN).alias("_place")
    near = df.select(*by, *KEYS, "values", "n_rows", place).groupBy(*by, *KEYS, "_place").agg(total.alias("values"), F.sum("n_rows").alias("n_rows"))
    return near.groupBy(*by, *KEYS).agg(total.alias("values"), F.sum("n_rows").alias("n_rows"))


def gradient_sum(df, model, params, by=(), weight: Column | None = None, dropout_salt=None, version: str | None = None) -> DataFrame:
    """Weighted gradient sum per group: ``(*by, layer, name, chunk, values, n_rows)``."""
    weight = F.lit(1.0) if weight is None else weight
    return sum_values(gradient_partials(df, model, params, list(by), weight, dropout_salt, version), list(by))


def batch_gradients(batched: DataFrame, model, params, dropout_salt=None) -> DataFrame:
    """The gradient of every mini-batch, keyed by ``(part_id, batch_id)``."""
    return gradient_sum(batched, model, params, ["part_id", "batch_id"], batch_weight(model, F.col("batch_rows")), dropout_salt)


def group_gradients(batched: DataFrame, model, params, dropout_salt=None) -> DataFrame:
    """What each push carries: the mean over the *batches* of a group, short ones counting in full."""
    weight = batch_weight(model, F.col("batch_rows")) / F.col("group_batches")
    return gradient_sum(batched, model, params, ["part_id", "group_id"], weight, dropout_salt)


def mean_over_batches(gradients: DataFrame, by: list[str]) -> DataFrame:
    """Mean of gradient tables that already hold one row per batch and chunk."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("values"))))
    return gradients.groupBy(*by, *KEYS).agg(mean.alias("values"), F.count(F.lit(1)).alias("n_batches"))


def collect_gradient(gradient: DataFrame, model: ModelSpec) -> list[np.ndarray] | None:
    """One gradient as tensors on the driver (as large as the model), or None without rows."""
    got = gradient.select(*KEYS, "values").toArrow()
    return tensors_of(got, model, "values") if got.num_rows else None
