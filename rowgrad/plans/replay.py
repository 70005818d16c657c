"""Training as asynchronous workers do it: gradients taken at the parameters a worker held, applied in order of arrival.

A worker pulls the parameters, works for a while and pushes a gradient, which arrives later; meanwhile others' gradients have been applied.
A log says when each message was pulled for, sent and received, and which rows its gradient is taken over.  Replaying it needs the version
of the parameters that each worker held, an as-of join of pulls with arrivals, and a table of versions.  All messages whose versions exist
already form a wave: their gradients are one job, and one more applies them in order and keeps the versions that later messages need.
Where all versions that are alive at a time are few megabytes, as bounded by the log, the driver keeps them: it collects a wave's gradients, as large as
these, and applies them itself, so that a wave is one job; curve points are then measured many in a pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import evaluate
from ..operators.evaluate import errors_of, version_errors, version_groups, versions_of
from ..operators.gradients import gradient_partials, gradient_sum
from ..operators.message_log import apply_numbered
from ..operators.messages import with_acceptance
from ..operators.network import ModelSpec
from ..operators.params import KEYS, Parameters, chunk_keys, collect_params, tensors_of, to_table
from ..operators.ranking import row_positions
from ..session import join_small, materialize, scratch_owner, scratch_path
from .train import Fit

LOG_ROWS = 4096  # messages whose numbers the driver reads at a time


def held_versions(log: DataFrame, max_age_s: float) -> DataFrame:
    """``(message, received, accepted, seq, version)`` of every message ``(message, pulled, time_sent, arrived)``.

    ``received`` counts all messages in order of arrival, ``seq`` the accepted ones.  ``version`` is how many
    accepted messages had arrived when the worker pulled: the parameters it held.  A message never holds its own update.
    """
    judged = with_acceptance(log.select("message", "pulled", "time_sent", "arrived"), max_age_s).drop("age_us")
    judged = row_positions(judged, ["arrived", "message"], name="received")
    accepted = row_positions(judged.where("accepted").select("message", "arrived", "pulled"), ["arrived", "message"], name="seq")
    # as of a pull: its place among arrivals and pulls, less its place among pulls
    moments = accepted.select(F.explode(F.array(F.struct(F.col("arrived").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("pulled").alias("at"), F.lit(1).alias("kind")))).alias("m"), "message")
    placed = row_positions(moments.select("m.at", "m.kind", "message"), ["at", "kind", "message"], name="place").where("kind = 1")
    pulls = row_positions(placed.select("at", "message", "place"), ["at", "message"], name="rank").select("message", (F.col("place") - F.col("rank")).alias("before"))
    known = accepted.select("message", "seq").join(pulls, "message").select("message", "seq", F.least("before", F.col("seq") - 1).alias("version"))
    return judged.select("message", "received", "accepted").join(known, "message", "left")


@dataclass
class Replayed:
    """What a replay leaves: the fit, and how many messages came, were rejected, and how many waves they took."""

    fit: Fit
    received: int
    rejected: int
    waves: int


def replay(
    rows: DataFrame,
    log: DataFrame,
    model: ModelSpec,
    start: Parameters,
    max_age_s: float,
    eval_df: DataFrame | None = None,
    eval_every: int = 10,
) -> Replayed:
    """Fit ``model`` by a log of messages ``(message, pulled, time_sent, arrived)``.

    ``rows`` holds ``(message, weight, label or target, features)``; a message's gradient is the weighted sum over its rows, so the weights
    carry what a mean over batches divides by.  Messages of ``max_age_s`` or older are counted and rejected.  The error is
    measured after every ``eval_every``-th message received, if that was accepted; points are recorded under the message's number.
    Accepted messages without rows count as received and change nothing.
    """
    with scratch_owner(rows.sparkSession):
        return _replay(rows, log, model, start, max_age_s, eval_df, eval_every)


def _replay(rows, log, model, start, max_age_s, eval_df, eval_every) -> Replayed:
    spark = rows.sparkSession
    folder = scratch_path(spark, "replay")
    plan = materialize(held_versions(log, max_age_s), "log", path=f"{folder}/log")
    received, taken = plan.agg(F.count(F.lit(1)), F.count("seq")).first()
    # states that are wanted again: held by a message, or measured
    point = F.col("accepted") & (F.col("received") % eval_every == 0) & F.lit(eval_df is not None)
    held = plan.where("version > 0").select(F.col("version").alias("seq")).distinct().withColumn("is_held", F.lit(True))
    plan = plan.where("accepted").join(held, "seq", "left").select("message", "received", "seq", "version", "is_held", point.alias("point"))
    plan = materialize(plan, "plan", path=f"{folder}/plan")
    late, widest = plan.agg(F.avg(F.col("seq") - F.col("version")), F.max(F.col("seq") - F.col("version"))).first()
    span = max(1, round(late or 1))
    table_rows = _laid_out(rows, plan, model, span, taken, f"{folder}/rows")
    # no message holds a version older than that, and no wave is longer: twice as many sets are versions and gradients
    if 2 * (widest or 1) * model.size_bytes <= evaluate.VERSIONS_BYTES:
        fit, waves = _held_here(plan, table_rows, span, taken, widest, model, start, eval_df)
        return Replayed(fit, received, received - taken, waves)

    fit, done, waves = Fit(start), 0, 0
    table = to_table(spark, model, start)
    states = {0: table.select(F.lit(0).cast("long").alias("mark"), *KEYS, "values")}
    plan = plan.persist()
    while done < taken:
        ahead = plan.where(F.col("seq") > done).agg(F.min(F.when(F.col("version") > done, F.col("seq"))), F.min("version")).first()
        last = taken if ahead[0] is None else ahead[0] - 1
        # older versions than any later message holds are let go
        states = {upto: s for upto, s in states.items() if upto >= ahead[1]}
        # messages under way at the same time, a few numbers each
        wave = plan.where(F.col("seq").between(done + 1, last)).collect()
        wanted = [r["seq"] for r in wave if r["is_held"] or r["point"]]
        inside = _rows_of(spark, table_rows, span, done + 1, last)
        pushed = _gradients(inside, model, states, sorted({r["version"] for r in wave}))
        marked = pushed.withColumns({"mark": F.when(F.col("seq").isin(wanted), F.col("seq")), "seq": F.col("seq") - done})
        table, kept = apply_numbered(table, marked, model.optimizer, last - done, path=f"{folder}/states/upto={last}")
        points = {r["seq"]: r["received"] for r in wave if r["point"]}
        if points:
            for r in version_errors(eval_df, model, kept.where(F.col("mark").isin(list(points)))).orderBy("mark").collect():
                fit.record("train", points[r["mark"]], r["error"])
        states[last] = kept
        done, waves = last, waves + 1
    plan.unpersist()
    fit.params = collect_params(table, model)
    return Replayed(fit, received, received - taken, waves)


def _held_here(plan: DataFrame, table_rows, span: int, taken: int, widest: int, model: ModelSpec, start: Parameters, eval_df: DataFrame | None) -> tuple[Fit, int]:
    """The fit and its waves where the driver keeps the versions that later messages may hold, ``widest`` at most."""
    spark = plan.sparkSession
    fit, params, done, waves = Fit(start), start, 0, 0
    states, points = {0: start.values}, {}
    plan = plan.select("seq", "received", "version", "point").persist()

    def measure() -> None:
        """Points of many waves in one pass over the rows."""
        if points:
            for r in errors_of(eval_df, model, [points.copy]).orderBy("mark").collect():
                fit.record("train", r["mark"], r["error"])
            points.clear()

    while done < taken:
        some = sorted(plan.where(F.col("seq").between(done + 1, done + LOG_ROWS)).collect(), key=lambda r: r["seq"])
        while some:
            # what doesn't hold an update still to come
            n = next((i for i, r in enumerate(some) if r["version"] > done), len(some))
            wave, some = some[:n], some[n:]
            found = _collected(_rows_of(spark, table_rows, span, done + 1, done + n), model, {v: states[v] for v in {r["version"] for r in wave}})
            for r in wave:
                if r["seq"] in found:
                    params = params.updated(found[r["seq"]], model.optimizer)
                states[r["seq"]] = params.values
                if r["point"]:
                    points[r["received"]] = params.values
                    if (len(points) + 1) * model.size_bytes > evaluate.VERSIONS_BYTES:
                        measure()
            done, waves = done + n, waves + 1
            states = {upto: v for upto, v in states.items() if upto > done - widest}
    measure()
    plan.unpersist()
    fit.params = params
    return fit, waves


def _collected(rows: DataFrame, model: ModelSpec, held: dict[int, list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """Each message's gradient at the version it held, on the driver; messages without rows have none."""
    shared = rows.sparkSession.sparkContext.broadcast(held)
    # a message's rows are in one folder, so that there are hardly more partial sums than messages
    got = gradient_partials(rows, model, shared, ["seq"], F.col("weight"), version="version").toArrow()
    shared.destroy()
    out, width = {}, len(chunk_keys(model))
    for at in range(0, got.num_rows, width):
        part = got.slice(at, width)
        seq, gradient = part.column("seq")[0].as_py(), tensors_of(part, model, "values")
        out[seq] = [a + b for a, b in zip(out[seq], gradient)] if seq in out else gradient
    return out


def _laid_out(rows: DataFrame, plan: DataFrame, model: ModelSpec, span: int, taken: int, path: str) -> tuple[str, StructType, set[int]]:
    """The rows of accepted messages with their ``seq`` and ``version``, a folder for every ``span`` messages, so that a wave reads its own rows."""
    data = rows.select("message", "weight", model.answer, "features")
    numbered = join_small(data, plan.select("message", "seq", "version"), "message", rows=taken)
    block = F.floor((F.col("seq") - 1) / span).cast("int")
    out = numbered.drop("message").withColumn("block", block)
    out.repartition("block").write.partitionBy("block").parquet(path)
    # messages without rows leave gaps
    there = {r[0] for r in rows.sparkSession.read.schema(out.schema).parquet(path).select("block").distinct().collect()}
    return path, out.drop("block").schema, there


def _rows_of(spark: SparkSession, table: tuple[str, StructType, set[int]], span: int, first: int, last: int) -> DataFrame:
    path, schema, there = table
    folders = [f"{path}/block={b}" for b in range((first - 1) // span, (last - 1) // span + 1) if b in there]
    read = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    return read.where(F.col("seq").between(first, last))


def _gradients(rows: DataFrame, model: ModelSpec, states: dict[int, DataFrame], versions: list[int]) -> DataFrame:
    """``(seq, layer, name, chunk, values)``: each message's gradient at the version it held, versions in groups of bounded size."""
    spark = rows.sparkSession
    held = reduce(DataFrame.unionByName, states.values())
    parts = []
    for group in version_groups(versions, model):
        shared = spark.sparkContext.broadcast(versions_of(held, model, group))
        mine = rows.where(F.col("version").isin(group))
        parts.append(gradient_sum(mine, model, shared, ["seq"], F.col("weight"), version="version"))
    return reduce(DataFrame.unionByName, parts).select(F.col("seq").cast("long").alias("seq"), *KEYS, "values")
