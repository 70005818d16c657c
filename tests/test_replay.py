"""Replays of message logs against plain Python."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgrad.functions.optim import Adam, Momentum
from rowgrad.operators import evaluate, network
from rowgrad.operators.network import MSE, dense_model
from rowgrad.operators.params import Parameters
from rowgrad.plans import replay

T0 = datetime(2024, 1, 1)
LOG = "message long, pulled timestamp, time_sent timestamp, arrived timestamp"


def log_of(n, seed):
    """Several workers; pulls, sends and arrivals in whole seconds, so that some fall together."""
    rng = np.random.default_rng(seed)
    out = []
    for m in range(n):
        pulled = m // 5 * 30 + int(rng.integers(0, 40))
        sent = pulled + 1 + int(rng.integers(0, 60))
        out.append((m, pulled, sent, sent + int(rng.integers(0, 70))))
    return out


def frame(spark, log):
    return spark.createDataFrame([(m, *[T0 + timedelta(seconds=s) for s in t]) for m, *t in log], LOG).repartition(4)


def held(log, lag):
    """(message, received, accepted, seq, version), in order of arrival."""
    order = sorted(log, key=lambda r: (r[3], r[0]))
    taken = [r for r in order if r[3] - r[2] < lag]
    seq = {r[0]: i for i, r in enumerate(taken, 1)}
    out = []
    for i, (m, pulled, sent, arrived) in enumerate(order, 1):
        ok = m in seq
        out.append((m, i, ok, seq.get(m), min(sum(r[3] <= pulled for r in taken), seq[m] - 1) if ok else None))
    return out


def test_held_versions(spark):
    log = log_of(120, 1)
    got = replay.held_versions(frame(spark, log), 50).orderBy("received").collect()
    assert [(r.message, r.received, r.accepted, r.seq, r.version) for r in got] == held(log, 50)
    assert 0 < sum(not r.accepted for r in got) < 60 and max(r.seq - r.version for r in got if r.accepted) > 5


@pytest.mark.parametrize("model", [dense_model([3, 4, 2], optimizer=Adam(lr=0.05)), dense_model([3, 4, 2], loss=MSE, optimizer=Momentum(lr=0.01, momentum=0.9))], ids=["xent", "mse"])
def test_replay_is_what_plain_python_computes(spark, model, monkeypatch):
    rng = np.random.default_rng(2)
    log, lag, n = log_of(40, 3), 50, 200
    x, message = rng.normal(size=(n, 3)), rng.integers(0, 39, n)  # the last message has no rows
    weight = rng.uniform(0.1, 1, n)
    label, target = rng.integers(0, 2, n), rng.normal(size=(n, 2))
    start = Parameters.fresh([rng.normal(size=s) for _, _, s in model.tensors()], model.optimizer)
    given = [(int(m), float(w), int(y), [float(v) for v in t], [float(v) for v in f]) for m, w, y, t, f in zip(message, weight, label, target, x)]
    rows = spark.createDataFrame(given, "message long, weight double, label int, target array<double>, features array<double>").repartition(5)
    rows = rows.drop("target" if model.answer == "label" else "label")
    log = [r for r in log if r[0] in set(message.tolist())] + [(1000, 0, 1, 500)]  # and one that comes far too late

    versions, want = [start], []
    answer = label if model.answer == "label" else target
    for m, received, ok, _, version in held(log, lag):
        if ok:
            mine = np.flatnonzero(message == m)
            _, factors = network.row_factors(model, versions[version].values, x[mine], answer[mine])
            versions.append(versions[-1].updated(network.weighted_gradient(factors, slice(None), weight[mine]), model.optimizer))
            if received % 10 == 0:
                want.append((received, evaluate.evaluate(rows, model, versions[-1].values).first()["error"]))

    for limit in (evaluate.VERSIONS_BYTES, 1):
        monkeypatch.setattr(evaluate, "VERSIONS_BYTES", limit)
        done = replay.replay(rows, frame(spark, log), model, start, lag, eval_df=rows)
        assert done.received == len(log) and done.rejected == len(log) - len(versions) + 1 and 1 < done.waves < len(versions) / 2
        assert done.fit.params.step == len(versions) - 1
        for a, b in zip([*done.fit.params.values, *sum(done.fit.params.slots, [])], [*versions[-1].values, *sum(versions[-1].slots, [])]):
            np.testing.assert_allclose(a, b, rtol=1e-8, atol=1e-10)
        assert [p[2] for p in done.fit.curve] == [r for r, _ in want]
        np.testing.assert_allclose([p[3] for p in done.fit.curve], [e for _, e in want], rtol=1e-9)


def test_a_wave_is_one_job_and_points_are_measured_together(spark, monkeypatch):
    """Several jobs a wave and a pass over all rows for each wave with a point took too long. Some messages have no rows."""
    monkeypatch.setattr(replay, "LOG_ROWS", 50)
    rng = np.random.default_rng(5)
    model, log, lag = dense_model([3, 2], optimizer=Adam(lr=0.05)), log_of(120, 4), 50
    x, message = rng.normal(size=(360, 3)), np.arange(360) // 3
    gone = {r[0] for r in held(log, lag) if r[3] in (3, 20)}
    kept = [i for i in range(360) if message[i] not in gone]
    label, start = rng.integers(0, 2, 360), Parameters.fresh([rng.normal(size=s) for _, _, s in model.tensors()], model.optimizer)
    rows = spark.createDataFrame([(int(message[i]), 0.5, int(label[i]), x[i].tolist()) for i in kept], "message long, weight double, label int, features array<double>")
    rows = rows.repartition(4).cache()

    versions, points = [start], []
    for m, received, ok, _, version in held(log, lag):
        if ok:
            mine = np.flatnonzero(message == m)
            _, factors = network.row_factors(model, versions[version].values, x[mine], label[mine])
            after = versions[-1].updated(network.weighted_gradient(factors, slice(None), np.full(3, 0.5)), model.optimizer)
            versions.append(versions[-1] if m in gone else after)
            if received % 10 == 0:
                points.append((received, float(((x[kept] @ versions[-1].values[0] + versions[-1].values[1]).argmax(1) != label[kept]).mean())))
    spark.sparkContext.setJobGroup("replay-jobs", "one replay")
    try:
        done = replay.replay(rows, frame(spark, log), model, start, lag, eval_df=rows)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("replay-jobs"))
    for a, b in zip(done.fit.params.values, versions[-1].values):
        np.testing.assert_allclose(a, b, rtol=1e-8, atol=1e-10)
    assert [p[2] for p in done.fit.curve] == [r for r, _ in points] and len(points) > 4
    np.testing.assert_allclose([p[3] for p in done.fit.curve], [e for _, e in points], rtol=1e-9)
    assert done.waves > 12 and jobs < 60 + done.waves, (jobs, done.waves)


def test_nothing_accepted_leaves_the_start(spark):
    model = dense_model([1, 2])
    start = Parameters.fresh([np.ones((1, 2)), np.zeros(2)], model.optimizer)
    rows = spark.createDataFrame([(1, 1.0, 0, [1.0])], "message long, weight double, label int, features array<double>")
    done = replay.replay(rows, frame(spark, [(1, 0, 1, 500)]), model, start, 50)
    assert (done.received, done.rejected, done.waves, done.fit.params.step) == (1, 1, 0, 0)
    assert (done.fit.params.values[0] == 1).all()
    empty = replay.replay(rows, frame(spark, [(1, 0, 1, 2)]).where(F.lit(False)), model, start, 50)
    assert (empty.received, empty.waves) == (0, 0)
