from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from rowgrad.functions.optim import Adam
from rowgrad.functions.parsing import Layout
from rowgrad.operators import evaluate, messages, params
from rowgrad.operators.network import dense_model
from rowgrad.operators.params import Parameters
from rowgrad.streaming import messages as stream
from rowgrad.streaming import rows as row_stream
from rowgrad.streaming import snapshots

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, worker long, time_sent timestamp, arrived timestamp, value double"
MODEL = dense_model([2, 1], optimizer=Adam(lr=0.1))


def log(spark, ids):
    rows = [(i, 7 if i % 3 else i % 5, T0 + timedelta(seconds=i), T0 + timedelta(seconds=i + i % 4 * 10), float(i % 11 - 5)) for i in ids]
    return spark.createDataFrame(rows, SCHEMA)


def with_chunks(df):
    def chunk(name, *factors):
        values = F.array(*[F.col("value") * f for f in factors])
        return F.struct(F.lit(0).alias("layer"), F.lit(name).alias("name"), F.lit(0).alias("chunk"), values.alias("values"))

    return df.select("id", "time_sent", "arrived", F.explode(F.array(chunk("W", 1.0, 2.0), chunk("b", 3.0))).alias("c")).select("id", "time_sent", "arrived", "c.*")


def test_age_must_be_below_the_limit(spark):
    rows = [(i, 0, T0, T0 + timedelta(microseconds=us), 0.0) for i, us in enumerate((0, 99_999_999, 100_000_000, 100_000_001))]
    judged = messages.with_acceptance(spark.createDataFrame(rows, SCHEMA), 100).orderBy("id").collect()
    assert [r.accepted for r in judged] == [True, True, False, False]


def test_evaluation_points_count_rejected_messages(spark):
    df = messages.with_acceptance(log(spark, range(200)), 30)
    order = sorted(df.collect(), key=lambda r: (r.arrived, r.id))
    want = [(i, r.id) for i, r in enumerate(order, start=1) if i % 10 == 0 and r.accepted]
    got = messages.evaluation_points(df.select("id", "arrived", "accepted")).orderBy("received").collect()
    assert [(r.received, r.id) for r in got] == want and 0 < len(want) < 20


def test_counts_grow_over_restarts(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for ids in (range(50), range(50, 90)):
        log(spark, ids).write.mode("append").parquet(source)
        stream.run_counts(stream.count_by_acceptance(stream.stream_table(spark, source, SCHEMA), 30), out, mark)
    got = {r.accepted: r.n for r in snapshots.latest(spark, out).collect()}
    assert got == {True: sum(i % 4 < 3 for i in range(90)), False: sum(i % 4 == 3 for i in range(90))}


def test_worker_state_survives_batches_and_restarts(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for ids in (range(40), range(40, 100), range(100, 103)):
        log(spark, ids).repartition(3).write.mode("append").parquet(source)
        messages_in = stream.stream_table(spark, source, SCHEMA, max_files=1)
        stream.run_cadence(messages_in, out, mark)
    seen = {}
    for i in range(103):
        w = 7 if i % 3 else i % 5
        seen[w] = seen.get(w, 0) + 1
    got = {r.worker: (r.iterations, r.pulls, r.pushes) for r in stream.latest_cadence(spark, out).collect()}
    assert got == {w: (n, -(-n // 5), n // 5) for w, n in seen.items()}


def test_silent_workers_leave_the_state(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    want = {}
    for lot in range(6):
        # in each lot two workers of its own, and one that always works
        rows = [(i, lot * 2 + i % 2 if i % 3 else 99, T0, T0 + timedelta(seconds=lot * 100 + i), 0.0) for i in range(30)]
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(source)
        stream.run_cadence(stream.stream_table(spark, source, SCHEMA), out, mark, expire_after_s=150)
        for _, w, *_ in rows:
            want[w] = want.get(w, 0) + 1
        got = {r.worker: r.iterations for r in stream.latest_cadence(spark, out).collect()}
        assert got == {w: n for w, n in want.items() if w == 99 or w // 2 >= lot - 1}
    assert snapshots.finished_batches(spark, out) == [4, 5]


def test_updates_follow_arrival_and_are_not_repeated(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    start = Parameters.fresh([np.array([[0.5], [-0.5]]), np.array([0.1])], MODEL.optimizer)
    table = params.to_table(spark, MODEL, start)

    def run():
        arriving = with_chunks(stream.stream_table(spark, source, SCHEMA))
        stream.run_updates(arriving, table, MODEL.optimizer, ["arrived", "id"], 30, out, mark, measure=lambda states: states)

    local, received, want = start, 0, {}
    for ids in (range(33), range(33, 70), range(70, 74)):
        df = log(spark, ids)
        df.write.mode("append").parquet(source)
        run()
        run()  # nothing new has arrived
        for r in sorted(messages.with_acceptance(df, 30).collect(), key=lambda r: (r.arrived, r.id)):
            received += 1
            if r.accepted:
                local = local.updated([np.array([[r.value], [2 * r.value]]), np.array([3 * r.value])], MODEL.optimizer)
                if received % 10 == 0:
                    want[received] = local.values[0].reshape(-1)
    done = snapshots.latest(spark, out)
    assert done.select("received", "rejected").distinct().collect() == [(74, sum(i % 4 == 3 for i in range(74)))]
    # the parameters right after every tenth message, where that was accepted, also inside a micro-batch
    states = {r.mark: r["values"] for r in stream.evaluations(spark, out).where("name = 'W'").collect()}
    assert sorted(states) == sorted(want) and 3 < len(want) < 7
    for at, values in states.items():
        np.testing.assert_allclose(values, want[at], rtol=1e-9)
    got = params.collect_params(done, MODEL)
    assert got.step == local.step
    for a, b in zip(got.values, local.values):
        np.testing.assert_allclose(a, b, rtol=1e-9)
    # a replay of a finished batch leaves its snapshot alone
    last = snapshots.finished_batches(spark, out)[-1]
    before = sorted(map(str, (tmp_path / "out" / f"batch={last}").iterdir()))
    replay_mark = str(tmp_path / "fresh-mark")
    stream.run_updates(with_chunks(stream.stream_table(spark, source, SCHEMA)), table, MODEL.optimizer, ["arrived", "id"], 30, out, replay_mark)
    assert sorted(map(str, (tmp_path / "out" / f"batch={last}").iterdir())) == before


def test_errors_of_many_parameter_sets_in_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for model, answer in ((dense_model([3, 5, 2]), "label"), (dense_model([3, 4, 2], loss="mse"), "target")):
        sets = {m: [rng.normal(size=s) for _, _, s in model.tensors()] for m in (10, 20, 50)}
        states = None
        for m, values in sets.items():
            one = params.to_table(spark, model, Parameters.fresh(values, model.optimizer)).select(F.lit(m).cast("long").alias("mark"), *params.KEYS, "values")
            states = one if states is None else states.unionByName(one)
        x, y = rng.normal(size=(40, 3)), rng.integers(0, 2, (40, 2))
        given = [(int(t[0]), [float(v) for v in t], [float(v) for v in f]) for t, f in zip(y, x)]
        rows = spark.createDataFrame(given, "label int, target array<double>, features array<double>").repartition(3)
        for limit in (evaluate.VERSIONS_BYTES, 1):
            monkeypatch.setattr(evaluate, "VERSIONS_BYTES", limit)
            got = {r.mark: (r.n, r.error) for r in evaluate.version_errors(rows, model, states).collect()}
            want = {m: evaluate.evaluate(rows, model, v).first() for m, v in sets.items()}
            assert sorted(got) == sorted(sets)
            for m in sets:
                assert got[m][0] == 40
                np.testing.assert_allclose(got[m][1], want[m]["error"], rtol=1e-12)


def test_training_on_files_as_they_arrive(spark, tmp_path):
    model = dense_model([3, 2], optimizer=Adam(lr=0.1))
    start = Parameters.fresh([np.zeros((3, 2)), np.zeros(2)], model.optimizer)
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    local = start
    rng = np.random.default_rng(1)
    for lot in range(3):
        x, y = rng.integers(-5, 5, (25, 3)), rng.integers(0, 2, 25)
        lines = [(",".join(map(str, [y[i], *x[i]])),) for i in range(25)] + [("",), ("7,1,2,3",)]
        spark.createDataFrame(lines, "value string").write.mode("append").text(source)
        row_stream.train_on_files(spark, source, Layout("class_first", 3, 2, min_len=2), model, start, out, mark, batch_size=10)
        s = x @ local.values[0] + local.values[1]
        d = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True) - np.eye(2)[y]
        local = local.updated([x.T @ d / 3, d.sum(axis=0) / 3], model.optimizer)  # 25 rows are three batches
    got = params.collect_params(snapshots.latest(spark, out), model)
    assert got.step == 3
    for a, b in zip(got.values, local.values):
        np.testing.assert_allclose(a, b, rtol=1e-9)
