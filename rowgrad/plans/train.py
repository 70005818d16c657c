"""Fitting jobs: warm-up on a small ordered sample, then seeded synchronous rounds.

One round is one Spark job.  The driver keeps a single copy of the parameters, each round gets a
fresh broadcast of it, and a gradient as large as the model comes back.  Rows never reach the
driver.  A lost executor repeats its tasks with the same result, and nothing is applied twice.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.batching import BatchPlan, assign_batches, cells_for, part_sizes, warmup_slices
from ..operators.evaluate import evaluate
from ..operators.gradients import batch_weight, collect_gradient, gradient_sum, group_gradients
from ..operators.message_log import apply_many
from ..operators.network import ModelSpec
from ..operators.params import Parameters, collect_params, to_table
from ..operators.ranking import without_first_rows
from ..session import discard, materialize, scratch_owner, scratch_path
from ..sources.sinks import CURVE_SCHEMA
from . import snapshots

log = logging.getLogger("rowgrad")

MEAN = "mean"
SEQUENTIAL = "sequential"


@dataclass
class Fit:
    """Parameters after fitting and the points of the training curve."""

    params: Parameters
    curve: list[tuple[str, datetime, int, float]] = field(default_factory=list)
    sink: Callable[[str, datetime, int, float], None] | None = None

    def record(self, phase: str, step: int, error: float) -> None:
        """Keep a point, and hand it to the sink at once."""
        self.curve.append((phase, datetime.fromtimestamp(time.time(), timezone.utc), step, float(error)))
        log.info("%s step %d error %f", phase, step, error)
        if self.sink is not None:
            self.sink(*self.curve[-1])

    def curve_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.curve, CURVE_SCHEMA)


def training_columns(df: DataFrame, model: ModelSpec, key: tuple[str, ...]) -> DataFrame:
    return df.select(*key, model.answer, "features")


def measure(df: DataFrame, model: ModelSpec, params: Parameters | Broadcast) -> float:
    values = params if isinstance(params, Broadcast) else params.values
    return evaluate(df, model, values).first()["error"]


class _Shared:
    """The broadcast of the current parameters; the one before it is freed when they change."""

    def __init__(self, spark: SparkSession, params: Parameters):
        self.context = spark.sparkContext
        self.values = self.context.broadcast(params.values)

    def change(self, params: Parameters) -> None:
        # every job that used the old one has delivered its result
        self.values.destroy()
        self.values = self.context.broadcast(params.values)


def fit_warmup(df: DataFrame, model: ModelSpec, key: list[str], rows: int, batch_size: int, params: Parameters, dropout_seed: int | None = None, sink=None) -> Fit:
    """Step through the first ``rows`` rows batch by batch; error on each batch right after its update.

    The sample is written once, one folder per slice, and every slice is a distributed gradient.
    """
    sliced = warmup_slices(training_columns(df, model, tuple(key)), key, rows, batch_size)
    sliced = sliced.withColumn("batch_rows", F.count(F.lit(1)).over(Window.partitionBy("slice_id")))
    if dropout_seed is not None:
        sliced = sliced.withColumn("row_hash", F.xxhash64(*key))
    spark = df.sparkSession
    path = scratch_path(spark, "warmup")
    sample = materialize(sliced.repartition("slice_id"), "warmup", ("slice_id",), path)
    fit = Fit(params, sink=sink)
    shared = _Shared(spark, params)
    for step in range(-(-sample.count() // batch_size)):
        batch = sample.filter(F.col("slice_id") == step)
        salt = None if dropout_seed is None else dropout_seed + step
        weight = batch_weight(model, F.col("batch_rows"))
        total = gradient_sum(batch, model, shared.values, weight=weight, dropout_salt=salt)
        fit.params = fit.params.updated(collect_gradient(total, model), model.optimizer)
        shared.change(fit.params)
        fit.record("warmup", step + 1, measure(batch, model, shared.values))
    shared.values.destroy()
    discard(spark, path)
    return fit


@dataclass
class EpochTable:
    """The rows of one epoch, batched; every round is a folder of its own, and ``part_rows`` tells what is in it."""

    path: str
    schema: StructType
    part_rows: np.ndarray
    plan: BatchPlan

    def part_batches(self) -> np.ndarray:
        if self.plan.batch_size == 0:
            return np.ones(len(self.part_rows), dtype=np.int64)
        return -(-self.part_rows // self.plan.batch_size)

    def parts_in_round(self, r: int, drop_partial: bool) -> int:
        """How many logical partitions push a group in round ``r``."""
        needed = (r + 1) * self.plan.push_every if drop_partial else r * self.plan.push_every + 1
        return int((self.part_batches() >= needed).sum())

    def rows_in_round(self, r: int) -> int:
        if self.plan.batch_size == 0:
            return int(self.part_rows.sum())
        size = self.plan.batch_size * self.plan.push_every
        return int(np.clip(self.part_rows - r * size, 0, size).sum())

    def rounds(self, drop_partial: bool) -> int:
        most = int(self.part_batches().max(initial=0))
        return most // self.plan.push_every if drop_partial else -(-most // self.plan.push_every)

    def round_rows(self, spark: SparkSession, r: int, drop_partial: bool) -> DataFrame:
        """Rows of round ``r``: its folder alone is listed and read."""
        rows = spark.read.schema(self.schema).parquet(f"{self.path}/group_id={r}").withColumn("group_id", F.lit(r))
        return rows.filter(F.col("group_batches") == self.plan.push_every) if drop_partial else rows


def write_epoch(df: DataFrame, plan: BatchPlan, epoch: int, path: str, total_rows: int, row_bytes: int) -> EpochTable:
    """Shuffle the rows of an epoch once and write them, a folder for each round.

    The tasks of the shuffle hold neighbouring hash ranges, which ascend with a row's place in its logical partition, so a round's
    rows come from one or two tasks and its folder has as few files, or more where a round is larger than a task.
    """
    # one number for each logical partition, of which the plan sets the number
    parts = part_sizes(df, plan, epoch).select("part_rows").toPandas()["part_rows"].to_numpy()
    batched = assign_batches(df, plan, epoch, cells_for(total_rows, row_bytes))
    batched.write.mode("overwrite").partitionBy("group_id").parquet(path)
    return EpochTable(path, batched.drop("group_id").schema, parts, plan)


def fit_rounds(
    df: DataFrame,
    model: ModelSpec,
    plan: BatchPlan,
    params: Parameters,
    epochs: int = 1,
    mode: str = MEAN,
    eval_df: DataFrame | None = None,
    eval_every: int = 10,
    drop_partial_groups: bool = False,
    exclude_first: int = 0,
    dropout_seed: int | None = None,
    snapshot_path: str | None = None,
    snapshot_every: int | None = None,
    sink: Callable[[str, datetime, int, float], None] | None = None,
) -> Fit:
    """Train for some epochs; every round takes the next push group of all logical partitions.

    ``mean``: one update with the mean of the partitions' gradients.  ``sequential``: the
    partitions' gradients are applied one by one in ``part_id`` order, each computed from the
    parameters at the start of the round, so a gradient is at most one round old.

    ``exclude_first`` holds the first rows by key (the warm-up sample) out.  With
    ``snapshot_path`` the parameters and the curve are saved after every epoch, and after every ``snapshot_every`` rounds of one; a
    restarted fit goes on after the last saved round, and refuses snapshots of another model, plan or way of training.
    ``sink`` gets every point of the curve as it is measured.
    """
    if mode not in (MEAN, SEQUENTIAL):
        raise ValueError(f"unknown mode {mode!r}")
    spark = df.sparkSession
    settings = repr((model, plan, mode, eval_every, drop_partial_groups, exclude_first, dropout_seed))
    rows = training_columns(df, model, plan.key)
    with scratch_owner(spark):
        if exclude_first:
            rows = without_first_rows(rows, list(plan.key), exclude_first)
        total_rows = rows.count()
        fit = Fit(params, sink=sink)
        epoch_path = scratch_path(spark, "epochs")
        saved = snapshots.Rounds(spark, snapshot_path, settings) if snapshot_path is not None else None
        at = saved.restore() if saved is not None else None
        first_epoch, first_round, step = (0, 0, 0) if at is None else (at.epoch, at.next_round, at.step)
        if at is not None:
            fit.params, fit.curve = collect_params(at.table, model), at.curve
        shared = _Shared(spark, fit.params)
        update = _mean_update if mode == MEAN else _sequential_update
        for epoch in range(first_epoch, epochs):
            table = write_epoch(rows, plan, epoch, epoch_path, total_rows, 8 * (model.n_in + model.n_out) + 64)
            salt = None if dropout_seed is None else dropout_seed + epoch
            rounds = table.rounds(drop_partial_groups)
            for r in range(first_round if epoch == first_epoch else 0, rounds):
                fit.params = update(spark, table, r, drop_partial_groups, model, fit.params, shared.values, salt)
                shared.change(fit.params)
                step += 1
                if eval_df is not None and step % eval_every == 0:
                    fit.record("train", step, measure(eval_df, model, shared.values))
                if saved is not None and r < rounds - 1 and snapshot_every and step % snapshot_every == 0:
                    saved.commit(to_table(spark, model, fit.params), fit.curve, epoch, r + 1, step)
            if saved is not None:
                saved.commit(to_table(spark, model, fit.params), fit.curve, epoch + 1, 0, step)
        shared.values.destroy()
    return fit


def _mean_update(spark: SparkSession, table: EpochTable, r: int, drop_partial: bool, model: ModelSpec, params: Parameters, shared: Broadcast, salt: int | None) -> Parameters:
    """One update by the mean of what the partitions push."""
    weight = batch_weight(model, F.col("batch_rows")) / (F.col("group_batches") * table.parts_in_round(r, drop_partial))
    rows = table.round_rows(spark, r, drop_partial)
    total = gradient_sum(rows, model, shared, weight=weight, dropout_salt=salt)
    return params.updated(collect_gradient(total, model), model.optimizer)


def _sequential_update(spark: SparkSession, table: EpochTable, r: int, drop_partial: bool, model: ModelSpec, params: Parameters, shared: Broadcast, salt: int | None) -> Parameters:
    """One update per partition, in ``part_id`` order."""
    rows = table.round_rows(spark, r, drop_partial)
    pushed = group_gradients(rows, model, shared, salt)
    start = to_table(spark, model, params)
    return collect_params(apply_many(start, pushed.withColumn("seq", F.col("part_id") + 1), model.optimizer, table.plan.n_parts), model)
