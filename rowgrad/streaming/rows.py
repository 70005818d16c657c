"""Training on labelled lines as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.parsing import FAILFAST, Layout, parse_lines
from ..operators.gradients import gradient_sum
from ..operators.network import ModelSpec
from ..operators.params import Parameters, collect_params, tensors_of, to_table
from ..sources.text import stream_lines
from . import snapshots
from .messages import run_available


def train_on_files(
    spark: SparkSession,
    source: str,
    layout: Layout,
    model: ModelSpec,
    start: Parameters,
    path: str,
    checkpoint: str,
    batch_size: int = 0,
    max_files: int | None = None,
    mode: str = FAILFAST,
    keep: int | None = None,
) -> None:
    """One update per micro-batch, with the mean gradient of its mini-batches.

    ``batch_size=0`` takes the micro-batch as one mini-batch.  Otherwise it counts as
    ceil(rows / batch_size) equally large ones; all rows then weigh alike and none needs to be
    placed in a particular batch.  ``keep`` (2 or more) limits how many snapshots stay.
    """
    lines = stream_lines(spark, source, max_files)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        if snapshots.is_finished(spark, path, batch_id):
            return
        before = snapshots.latest(spark, path, before=batch_id)
        params = start if before is None else collect_params(before, model)
        # parsed once: the gradient is summed with weight one, and its rows are counted with it
        shared = spark.sparkContext.broadcast(params.values)
        got = gradient_sum(parse_lines(batch, layout, mode), model, shared).toArrow()
        shared.destroy()
        if got.num_rows:
            n = got.column("n_rows")[0].as_py()
            batches = 1 if batch_size == 0 else -(-n // batch_size)
            share = 1.0 / (n * model.n_out) if model.answer == "target" else 1.0 / batches
            params = params.updated([g * share for g in tensors_of(got, model, "values")], model.optimizer)
        snapshots.write_batch(to_table(spark, model, params), path, batch_id, keep)

    run_available(lines, checkpoint, each_batch)
