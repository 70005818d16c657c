import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgrad.functions.optim import Adam, Momentum
from rowgrad.operators import batching, network
from rowgrad.operators.batching import BatchPlan
from rowgrad.operators.network import MSE, dense_model
from rowgrad.operators.params import Parameters
from rowgrad.plans import train
from rowgrad.sources import sinks

N, WIDTH = 230, 6
PLAN = BatchPlan(("id",), n_parts=3, batch_size=10, push_every=2, seed=5)


def make(model, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(N, WIDTH))
    y = x @ rng.normal(size=(WIDTH, model.n_out))
    return x, (y if model.loss == MSE else y.argmax(axis=1))


def frame(spark, model, tasks=4):
    x, y = make(model)
    if model.loss == MSE:
        rows = [(i, [float(v) for v in y[i]], [float(v) for v in x[i]]) for i in range(N)]
        return spark.createDataFrame(rows, "id long, target array<double>, features array<double>").repartition(tasks)
    rows = [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(N)]
    return spark.createDataFrame(rows, "id long, label int, features array<double>").repartition(tasks)


def start(model, seed=3):
    rng = np.random.default_rng(seed)
    return Parameters.fresh([rng.normal(0, 0.3, s) for _, _, s in model.tensors()], model.optimizer)


def batch_gradient(model, params, x, y, rows, mask=None):
    _, factors = network.row_factors(model, params.values, x[rows], y[rows], mask)
    weight = 1.0 / (len(rows) * model.n_out) if model.loss == MSE else 1.0
    return network.weighted_gradient(factors, np.arange(len(rows)), np.full(len(rows), weight))


def mean(tensors):
    return [sum(g) / len(tensors) for g in zip(*tensors)]


def by_hand(spark, model, plan, epochs, mode, drop_partial=False, dropout_seed=None):
    """Rounds in plain Python: batches in turn, means of batches, updates as they are pushed."""
    x, y = make(model)
    params = start(model)
    for epoch in range(epochs):
        rows = batching.with_parts(spark.range(N), plan, epoch).collect()
        parts = {}
        for r in sorted(rows, key=lambda r: (r.row_hash, r.id)):
            parts.setdefault(r.part_id, []).append((r.id, r.row_hash))
        rounds = {}
        for part, members in parts.items():
            batches = [members[i : i + plan.batch_size] for i in range(0, len(members), plan.batch_size)]
            for g in range(0, len(batches), plan.push_every):
                group = batches[g : g + plan.push_every]
                if len(group) == plan.push_every or not drop_partial:
                    rounds.setdefault(g // plan.push_every, []).append((part, group))
        for r in sorted(rounds):
            pushed = []
            for _, group in sorted(rounds[r]):
                grads = []
                for members in group:
                    mask = None
                    if dropout_seed is not None:
                        hashes = np.array([h for _, h in members])
                        mask = network.dropout_mask(hashes, model.stages[-1].n_in, model.keep_prob, dropout_seed + epoch)
                    grads.append(batch_gradient(model, params, x, y, [i for i, _ in members], mask))
                pushed.append(mean(grads))
            for g in [mean(pushed)] if mode == train.MEAN else pushed:
                params = params.updated(g, model.optimizer)
    return params


def same(a, b, tolerance=1e-9):
    assert a.step == b.step
    for p, q in zip([*a.values, *sum(a.slots, [])], [*b.values, *sum(b.slots, [])]):
        np.testing.assert_allclose(p, q, rtol=tolerance, atol=tolerance)


CLASSES = dense_model([WIDTH, 5, 3], optimizer=Adam(lr=0.02))
VALUES = dense_model([WIDTH, 5, 2], loss=MSE, optimizer=Momentum(lr=0.05, momentum=0.9))


@pytest.mark.parametrize("model", [CLASSES, VALUES], ids=["xent", "mse"])
@pytest.mark.parametrize("mode", [train.MEAN, train.SEQUENTIAL])
def test_rounds_are_what_plain_python_computes(spark, model, mode):
    fit = train.fit_rounds(frame(spark, model), model, PLAN, start(model), epochs=2, mode=mode)
    same(fit.params, by_hand(spark, model, PLAN, 2, mode))


def test_partial_groups_can_be_dropped(spark):
    fit = train.fit_rounds(frame(spark, CLASSES), CLASSES, PLAN, start(CLASSES), drop_partial_groups=True)
    same(fit.params, by_hand(spark, CLASSES, PLAN, 1, train.MEAN, drop_partial=True))


def test_dropout_rounds(spark):
    fit = train.fit_rounds(frame(spark, CLASSES), CLASSES, PLAN, start(CLASSES), dropout_seed=9)
    same(fit.params, by_hand(spark, CLASSES, PLAN, 1, train.MEAN, dropout_seed=9))


def test_layout_does_not_matter(spark, monkeypatch):
    one = train.fit_rounds(frame(spark, CLASSES, 1), CLASSES, PLAN, start(CLASSES))
    # several hash ranges per logical partition, as for a large table
    monkeypatch.setattr(batching, "TASK_BYTES", 4000)
    assert batching.cells_for(N, 100) > 1
    many = train.fit_rounds(frame(spark, CLASSES, 9), CLASSES, PLAN, start(CLASSES))
    same(one.params, many.params)


def test_training_lowers_the_error_and_records_on_cadence(spark):
    df = frame(spark, CLASSES)
    fit = train.fit_rounds(df, CLASSES, PLAN, start(CLASSES), epochs=2, eval_df=df, eval_every=3)
    rounds = 0
    for epoch in range(2):
        parts = batching.with_parts(spark.range(N), PLAN, epoch).groupBy("part_id").count()
        rounds += -(-parts.agg(F.max("count")).first()[0] // 20)  # two batches of ten rows per push
    assert [(p, s) for p, _, s, _ in fit.curve] == [("train", s) for s in range(3, rounds + 1, 3)]
    assert fit.curve[-1][3] < train.measure(df, CLASSES, start(CLASSES))


def test_a_restarted_fit_goes_on_after_the_last_epoch(spark, tmp_path):
    df, path = frame(spark, CLASSES), str(tmp_path / "snapshots")
    whole = train.fit_rounds(df, CLASSES, PLAN, start(CLASSES), epochs=2)
    train.fit_rounds(df, CLASSES, PLAN, start(CLASSES), epochs=1, snapshot_path=path)
    resumed = train.fit_rounds(df, CLASSES, PLAN, start(CLASSES, seed=99), epochs=2, snapshot_path=path)
    same(whole.params, resumed.params)
    again = train.fit_rounds(df, CLASSES, PLAN, start(CLASSES, seed=99), epochs=2, snapshot_path=path)
    same(whole.params, again.params)


class Killed(Exception):
    pass


@pytest.mark.parametrize("after", [1, 4, 7])
def test_a_fit_killed_between_rounds_ends_with_the_same_model_and_curve(spark, tmp_path, monkeypatch, after):
    df, path, curves = frame(spark, CLASSES), str(tmp_path / "snapshots"), str(tmp_path / "curves")

    def run(**more):
        return train.fit_rounds(df, CLASSES, PLAN, start(CLASSES), epochs=2, eval_df=df, eval_every=2, dropout_seed=3, **more)

    whole = run()
    made, update = [], train._mean_update

    def dies(*args):
        if len(made) == after:
            raise Killed
        made.append(1)
        return update(*args)

    with monkeypatch.context() as m:
        m.setattr(train, "_mean_update", dies)
        with pytest.raises(Killed):
            run(snapshot_path=path, snapshot_every=2, sink=sinks.curve_sink(spark, curves, "one"))
    resumed = run(snapshot_path=path, snapshot_every=2, sink=sinks.curve_sink(spark, curves, "one"))
    same(whole.params, resumed.params)
    assert [(p, s) for p, _, s, _ in resumed.curve] == [(p, s) for p, _, s, _ in whole.curve]
    np.testing.assert_allclose([e for *_, e in resumed.curve], [e for *_, e in whole.curve])
    kept = sinks.newest_points(sinks.read_curve(spark, curves, "one")).orderBy("step").collect()
    assert [r.step for r in kept] == [s for _, _, s, _ in whole.curve]
    with pytest.raises(ValueError, match="another fit"):
        train.fit_rounds(df, CLASSES, PLAN, start(CLASSES), epochs=2, eval_df=df, eval_every=2, dropout_seed=4, snapshot_path=path)


def test_held_out_rows_do_not_count(spark):
    df = frame(spark, CLASSES)
    held = train.fit_rounds(df, CLASSES, PLAN, start(CLASSES), exclude_first=100)
    same(held.params, train.fit_rounds(df.filter(F.col("id") >= 100), CLASSES, PLAN, start(CLASSES)).params)


def test_warmup_steps_through_slices(spark):
    x, y = make(VALUES)
    params, errors = start(VALUES), []
    for i in range(0, 70, 20):
        rows = np.arange(i, min(i + 20, 70))
        params = params.updated(batch_gradient(VALUES, params, x, y, rows), VALUES.optimizer)
        errors.append(((network.forward(VALUES, params.values, x[rows])[0] - y[rows]) ** 2).mean())
    fit = train.fit_warmup(frame(spark, VALUES), VALUES, ["id"], 70, 20, start(VALUES))
    same(fit.params, params)
    assert [(p, s) for p, _, s, _ in fit.curve] == [("warmup", i) for i in (1, 2, 3, 4)]
    np.testing.assert_allclose([e for *_, e in fit.curve], errors)


def scanned(df):
    """Rows that the scan of ``df`` hands on, and rows of ``df``."""
    execution = df._jdf.queryExecution()
    n = execution.toRdd().count()
    return execution.executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value(), n


def test_a_round_reads_the_rows_it_uses(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batching, "TASK_BYTES", 1 << 20)
    n = 200_000
    rows = spark.range(0, n, 1, 8).select("id", (F.col("id") % 3).cast("int").alias("label"), F.array(*[F.lit(float(i)) for i in range(4)]).alias("features"))
    plan = batching.BatchPlan(("id",), 12, 25, 4, seed=5)
    path = str(tmp_path / "epoch")
    table = train.write_epoch(rows, plan, 0, path, n, 100)
    total = 0
    for r in range(table.rounds(False)):
        got = table.round_rows(spark, r, False)
        if r % 20 == 0:
            read, used = scanned(got)
            assert read <= 2 * used and used == table.rows_in_round(r)
            assert len(got.inputFiles()) <= 3
        total += table.rows_in_round(r)
    assert total == n and spark.read.parquet(path).count() == n


def test_curves_are_appended(spark, tmp_path):
    fit = train.Fit(start(CLASSES))
    fit.record("warmup", 1, 0.5)
    path = str(tmp_path / "curves")
    sinks.append_curve(fit.curve_frame(spark), path, "a")
    sinks.append_curve(fit.curve_frame(spark), path, "b")
    fit.record("train", 10, 0.25)
    sinks.append_curve(fit.curve_frame(spark), path, "b")
    assert sinks.read_curve(spark, path).count() == 4
    got = sinks.read_curve(spark, path, "b").orderBy("step").collect()
    assert [(r.phase, r.step, r.error) for r in got] == [("warmup", 1, 0.5), ("warmup", 1, 0.5), ("train", 10, 0.25)]
