"""Error of a model over a whole DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import losses
from .network import XENT, ModelSpec, forward
from .params import KEYS, tensors_of
from .scoring import matrix, row_blocks, score

VERSIONS_BYTES = 256 << 20  # parameter sets that one pass over the rows measures together


def with_prediction(scored: DataFrame) -> DataFrame:
    return scored.withColumn("predicted", losses.argmax(F.col("scores")))


def error_of(model: ModelSpec) -> Column:
    """Aggregate over scored rows: share of wrong classes, or the mean squared error."""
    if model.loss == XENT:
        return losses.error_rate(losses.argmax(F.col("scores")), F.col("label"))
    return losses.mse(F.col("scores"), F.col("target"))


def evaluate(df: DataFrame, model: ModelSpec, params: list[np.ndarray] | Broadcast) -> DataFrame:
    """One row ``(n, error)`` over all rows of ``df``."""
    scored = score(df, model, params, keep=[model.answer])
    return scored.agg(F.count(F.lit(1)).alias("n"), error_of(model).alias("error"))


def versions_of(states: DataFrame, model: ModelSpec, wanted: list[int]) -> dict[int, list[np.ndarray]]:
    """Some of the parameter sets in ``states`` ``(mark, layer, name, chunk, values)``, on the driver; the caller bounds how many."""
    got = states.where(F.col("mark").isin(wanted)).select("mark", *KEYS, "values").toArrow()
    marks = got.column("mark").to_numpy()
    return {m: tensors_of(got.filter(pa.array(marks == m)), model, "values") for m in wanted}


def version_groups(marks: list[int], model: ModelSpec) -> list[list[int]]:
    """``marks`` in groups whose parameter sets stay under ``VERSIONS_BYTES`` together; one set at least."""
    size = max(1, VERSIONS_BYTES // model.size_bytes)
    return [marks[i : i + size] for i in range(0, len(marks), size)]


def version_errors(df: DataFrame, model: ModelSpec, states: DataFrame) -> DataFrame:
    """``(mark, n, error)`` of every parameter set in ``states`` over all rows of ``df``.

    Many sets are measured in one pass: a task reads its rows once and hands on two numbers for each set.
    """
    marks = [r[0] for r in states.select("mark").distinct().orderBy("mark").collect()]
    spark = df.sparkSession
    if not marks:
        return spark.createDataFrame([], "mark long, n long, error double")
    return errors_of(df, model, [lambda g=g: versions_of(states, model, g) for g in version_groups(marks, model)])


def errors_of(df: DataFrame, model: ModelSpec, groups: list[Callable[[], dict[int, list[np.ndarray]]]]) -> DataFrame:
    """``(mark, n, error)`` of parameter sets by mark over all rows of ``df``, one pass for each group of sets."""
    spark = df.sparkSession
    source = df.select(model.answer, "features")

    def measured(group) -> DataFrame:
        shared = spark.sparkContext.broadcast(group())

        def run(batches):
            sets = shared.value
            wrong, n = dict.fromkeys(sets, 0.0), 0
            for batch in row_blocks(batches, model.block_rows):
                x = matrix(batch.column("features"), model.n_in)
                answer = batch.column("label").to_numpy() if model.loss == XENT else matrix(batch.column("target"), model.n_out)
                n += batch.num_rows
                for mark, values in sets.items():
                    scores, _ = forward(model, values, x)
                    wrong[mark] += float((scores.argmax(axis=1) != answer).sum() if model.loss == XENT else ((scores - answer) ** 2).mean(axis=1).sum())
            yield pa.RecordBatch.from_arrays([pa.array(list(wrong), pa.int64()), pa.array([n] * len(wrong), pa.int64()), pa.array(list(wrong.values()))], ["mark", "n", "wrong"])

        return source.mapInArrow(run, "mark long, n long, wrong double")

    sums = reduce(DataFrame.unionByName, [measured(g) for g in groups])
    return sums.groupBy("mark").agg(F.sum("n").alias("n"), (F.sum("wrong") / F.sum("n")).alias("error"))


def partition_errors(batched: DataFrame, model: ModelSpec, params: list[np.ndarray] | Broadcast, first_batch_only: bool = False) -> DataFrame:
    """``(part_id, n, error)`` per logical partition, over all its rows or its first batch."""
    rows = batched.filter(F.col("batch_id") == 0) if first_batch_only else batched
    scored = score(rows, model, params, keep=["part_id", model.answer])
    return scored.groupBy("part_id").agg(F.count(F.lit(1)).alias("n"), error_of(model).alias("error"))


def mean_partition_error(errors: DataFrame, weighted: bool = True) -> DataFrame:
    """One row ``(error)``: mean by rows, or the plain mean over partitions."""
    mean = F.sum(F.col("error") * F.col("n")) / F.sum("n") if weighted else F.avg("error")
    return errors.agg(mean.alias("error"))
