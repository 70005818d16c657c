"""Streams of gradient messages: rejection by age, worker state, and updates on arrival."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.optim import Optimizer
from ..operators.message_log import apply_marked
from ..operators.messages import with_acceptance
from ..operators.ranking import row_positions
from ..session import join_small, scratch_owner
from . import snapshots

log = logging.getLogger("rowgrad")


def stream_table(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files as they arrive below ``path`` (a folder or a pattern)."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_available(stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that has arrived, then stop; a later call goes on from the checkpoint."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each_batch).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def count_by_acceptance(messages: DataFrame, max_age_s: float) -> DataFrame:
    """Streaming counts ``(accepted, n)``.

    The age is taken between sending and arrival; it is no watermark, so nothing is dropped unseen
    and the counts of rejected messages stay exact.
    """
    return with_acceptance(messages, max_age_s).groupBy("accepted").agg(F.count(F.lit(1)).alias("n"))


def run_counts(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the newest totals of a streaming aggregate as the latest snapshots."""
    run_available(counts, checkpoint, lambda df, batch_id: snapshots.write_batch(df, path, batch_id, keep=2), mode="complete")


def run_cadence(messages: DataFrame, path: str, checkpoint: str, every: int = 5, expire_after_s: float | None = None) -> None:
    """Per worker: iterations so far, the pulls and pushes they caused, and when it was last heard of.

    A worker pulls before iterations 0, ``every``, … and pushes after ``every``, 2 ``every``, ….  Each micro-batch counts its messages by
    worker, adds the totals of the snapshot before and writes a new one, all in the JVM; two snapshots stay.  A worker that has been
    silent for ``expire_after_s`` before the newest message leaves the table, which so holds the active ones; one that comes back starts anew.
    """
    spark = messages.sparkSession

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        if snapshots.is_finished(spark, path, batch_id):
            return
        # partial counts come first, so a busy worker's messages do not meet in one task
        came = batch.where("worker is not null").groupBy("worker").agg(F.count(F.lit(1)).alias("iterations"), F.max("arrived").alias("last_arrived"))
        before = snapshots.latest(spark, path, before=batch_id)
        if before is not None:
            came = came.unionByName(before.select("worker", "iterations", "last_arrived")).groupBy("worker")
            came = came.agg(F.sum("iterations").alias("iterations"), F.max("last_arrived").alias("last_arrived"))
        if expire_after_s is not None:
            newest = batch.agg(F.max("arrived").alias("newest"))
            if before is not None:
                newest = newest.unionByName(before.agg(F.max("last_arrived").alias("newest")))
            newest = newest.agg(F.max("newest")).first()[0]
            if newest is not None:
                oldest = F.lit(newest) - F.make_dt_interval(secs=F.lit(float(expire_after_s)))
                came = came.where(F.col("last_arrived") >= oldest)
        totals = came.select("worker", "iterations", F.ceil(F.col("iterations") / every).alias("pulls"), F.floor(F.col("iterations") / every).alias("pushes"), "last_arrived")
        snapshots.write_batch(totals, path, batch_id, keep=2)

    run_available(messages.select("worker", "arrived"), checkpoint, each_batch)


def latest_cadence(spark: SparkSession, path: str) -> DataFrame:
    """The newest totals of every worker that hasn't expired."""
    return snapshots.latest(spark, path).select("worker", "iterations", "pulls", "pushes")


def run_updates(
    messages: DataFrame,
    table: DataFrame,
    optimizer: Optimizer,
    order: list[str],
    max_age_s: float,
    path: str,
    checkpoint: str,
    eval_every: int = 10,
    measure: Callable[[DataFrame], DataFrame] | None = None,
    keep: int | None = None,
) -> None:
    """Update the parameters by each micro-batch's accepted messages in ``order``.

    ``messages`` holds ``(*order, time_sent, arrived, layer, name, chunk, values)``.  Every
    micro-batch writes a full snapshot under its own id with the numbers of messages received and
    rejected so far; a batch that is already there is skipped, so a replay does not apply anything twice.

    ``measure`` gets the parameters as they were right after every ``eval_every``-th received message, if that was
    accepted, wherever in the micro-batch it stands: ``(mark, layer, name, chunk, values)`` with the message's number as
    ``mark``.  Its rows, by ``mark``, are kept for ``evaluations``.  ``keep`` (2 or more) limits how many snapshots stay.
    """
    spark = messages.sparkSession
    first = _with_counters(table, 0, 0)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        if not snapshots.is_finished(spark, path, batch_id):
            with scratch_owner(spark):
                update(batch, batch_id)

    def update(batch: DataFrame, batch_id: int) -> None:
        before = snapshots.latest(spark, path, before=batch_id)
        before = first if before is None else before
        seen, refused = before.select("received", "rejected").first()
        judged = with_acceptance(batch, max_age_s)
        # the ids alone are counted and numbered; payloads are read once, by the update
        ids = judged.groupBy(*order).agg(F.bool_and("accepted").alias("accepted"))
        numbered = row_positions(ids, order, name="received")
        came, taken = numbered.agg(F.count(F.lit(1)), F.count_if("accepted")).first()
        received, rejected = seen + came, refused + came - taken
        log.info("batch %d: received %d, rejected %d", batch_id, received, rejected)
        number = F.col("received") + seen
        marks = numbered.where("accepted").select(*order, F.when(number % eval_every == 0, number).alias("mark"))
        accepted = join_small(judged.where("accepted").drop("accepted", "age_us"), marks, order, rows=taken)
        after, states = apply_marked(before.drop("received", "rejected"), accepted, optimizer, order, taken, marked=measure is not None)
        if measure is not None and states is not None:
            # before the snapshot, so that a finished batch always has its evaluations
            snapshots.write_batch(measure(states), f"{path}/{EVALUATIONS}", batch_id)
        snapshots.write_batch(_with_counters(after, received, rejected), path, batch_id, keep)

    run_available(messages, checkpoint, each_batch)


EVALUATIONS = "evaluations"


def evaluations(spark: SparkSession, path: str) -> DataFrame:
    """What ``measure`` found, over all finished micro-batches."""
    last = max(snapshots.finished_batches(spark, path), default=-1)
    done = [b for b in snapshots.finished_batches(spark, f"{path}/{EVALUATIONS}") if b <= last]
    parts = [snapshots.read_batch(spark, f"{path}/{EVALUATIONS}", b) for b in done]
    return reduce(DataFrame.unionByName, parts)


def _with_counters(table: DataFrame, received: int, rejected: int) -> DataFrame:
    return table.withColumns({"received": F.lit(received).cast("long"), "rejected": F.lit(rejected).cast("long")})
