from statistics import NormalDist

import numpy as np
import pytest

from rowgrad.functions import draws
from rowgrad.functions.optim import Adam, Momentum, RMSProp
from rowgrad.operators import message_log, params
from rowgrad.operators.network import dense_model
from rowgrad.operators.params import Parameters
from rowgrad.sources.datasets import DATASETS, dataset, image_model

RULES = [Adam(lr=0.1), Momentum(lr=0.1, momentum=0.9), RMSProp(lr=0.1)]


def test_two_adam_steps_by_hand():
    p = Parameters.fresh([np.array([1.0])], Adam(lr=0.1))
    p = p.updated([np.array([2.0])], Adam(lr=0.1))
    # m = .2, v = .004; the step size makes up for both starting at zero
    assert p.values[0][0] == pytest.approx(1.0 - 0.1 * np.sqrt(0.001) / 0.1 * 0.2 / (np.sqrt(0.004) + 1e-8))
    p = p.updated([np.array([-1.0])], Adam(lr=0.1))
    m, v = 0.9 * 0.2 - 0.1, 0.999 * 0.004 + 0.001
    first = 1.0 - 0.1 * np.sqrt(0.001) / 0.1 * 0.2 / (np.sqrt(0.004) + 1e-8)
    assert p.values[0][0] == pytest.approx(first - 0.1 * np.sqrt(1 - 0.999**2) / (1 - 0.81) * m / (np.sqrt(v) + 1e-8))


def test_two_momentum_steps_by_hand():
    rule = Momentum(lr=0.1, momentum=0.5)
    p = Parameters.fresh([np.array([1.0])], rule).updated([np.array([2.0])], rule).updated([np.array([4.0])], rule)
    assert p.values[0][0] == pytest.approx(1.0 - 0.1 * 2.0 - 0.1 * 5.0)


def test_rmsprop_starts_at_one():
    rule = RMSProp(lr=0.1, decay=0.9)
    p = Parameters.fresh([np.array([1.0])], rule).updated([np.array([2.0])], rule)
    assert p.values[0][0] == pytest.approx(1.0 - 0.1 * 2.0 / np.sqrt(0.9 + 0.4 + 1e-10))


@pytest.mark.parametrize("rule", RULES)
def test_table_update_is_the_local_one(spark, rule):
    model = dense_model([70, 80, 3], optimizer=rule)  # more than one chunk
    rng = np.random.default_rng(5)
    local = Parameters.fresh([rng.normal(size=s) for _, _, s in model.tensors()], rule)
    table = params.to_table(spark, model, local)
    for _ in range(2):
        g = [rng.normal(size=s) for _, _, s in model.tensors()]
        local = local.updated(g, rule)
        grads = params.to_table(spark, model, Parameters.fresh(g, rule)).select("layer", "name", "chunk", "values")
        table = params.apply_gradient(table, grads, rule)
    got = params.collect_params(table, model)
    assert got.step == 2
    for a, b in zip([*got.values, *sum(got.slots, [])], [*local.values, *sum(local.slots, [])]):
        np.testing.assert_allclose(a, b, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("rule", RULES)
def test_message_log_in_blocks_is_one_by_one(spark, rule):
    model = dense_model([3, 2], optimizer=rule)
    rng = np.random.default_rng(6)
    n = 137
    sent = rng.normal(size=(n, 8))
    local = Parameters.fresh([rng.normal(size=s) for _, _, s in model.tensors()], rule)
    table = params.to_table(spark, model, local)
    rows = []
    for i in range(n):
        rows += [(int(i * 31 % n), 0, "W", 0, [float(v) for v in sent[i * 31 % n][:6]])]
        rows += [(int(i * 31 % n), 0, "b", 0, [float(v) for v in sent[i * 31 % n][6:]])]
    log = spark.createDataFrame(rows, "id long, layer int, name string, chunk int, values array<double>").repartition(5)
    for g in sent:
        local = local.updated([g[:6].reshape(3, 2), g[6:]], rule)
    numbered = log.withColumn("seq", log["id"] + 1)
    for got in (
        message_log.apply_log(table, log, rule, ["id"]),
        message_log.apply_many(table, numbered, rule, n, block=10),
        message_log.apply_many(table, numbered, rule, n, block=137),
        message_log.apply_many(table, numbered, rule, n, block=2, fan=3),
        message_log.apply_many(table, numbered, rule, n, block=3, fan=2),
    ):
        end = params.collect_params(got, model)
        assert end.step == n
        for a, b in zip([*end.values, *sum(end.slots, [])], [*local.values, *sum(local.slots, [])]):
            np.testing.assert_allclose(a, b, rtol=1e-8, atol=1e-9)


@pytest.mark.parametrize("rule", RULES)
def test_states_after_marked_messages(spark, rule):
    model = dense_model([2, 1], optimizer=rule)
    rng = np.random.default_rng(9)
    n = 61
    sent = rng.normal(size=(n, 3))
    local = Parameters.fresh([rng.normal(size=s) for _, _, s in model.tensors()], rule)
    local.step = 4
    table = params.to_table(spark, model, local)
    rows = []
    for i in range(n):
        mark = i * 100 if i % 7 == 3 or i in (0, n - 1) else None
        rows += [(i, mark, 0, "W", 0, [float(v) for v in sent[i][:2]]), (i, mark, 0, "b", 0, [float(sent[i][2])])]
    seq = spark.createDataFrame(rows, "id long, mark long, layer int, name string, chunk int, values array<double>").repartition(5)
    want = {}
    for i, g in enumerate(sent):
        local = local.updated([g[:2].reshape(2, 1), g[2:]], rule)
        want[i * 100] = np.concatenate([v.reshape(-1) for v in local.values])
    numbered = seq.withColumn("seq", seq["id"] + 1)
    for after, states in (
        message_log.apply_marked(table, seq, rule, ["id"]),
        message_log.apply_numbered(table, numbered, rule, n, block=5, fan=100),
        message_log.apply_numbered(table, numbered, rule, n, block=2, fan=3),
    ):
        assert params.collect_params(after, model).step == local.step
        got = {}
        for r in states.collect():
            got.setdefault(r.mark, {})[r.name] = r["values"]
        assert sorted(got) == [m for m in sorted(want) if m // 100 % 7 == 3 or m in (0, (n - 1) * 100)]
        for mark, tensors in got.items():
            np.testing.assert_allclose(np.concatenate([tensors["W"], tensors["b"]]), want[mark], rtol=1e-8, atol=1e-10)


def test_saved_parameters_come_back(spark, tmp_path):
    model = dense_model([70, 80, 3])
    rng = np.random.default_rng(8)
    start = Parameters.fresh([rng.normal(size=s) for _, _, s in model.tensors()], model.optimizer)
    start.step = 12
    params.save_params(params.to_table(spark, model, start), str(tmp_path / "m"))
    back = params.collect_params(params.load_params(spark, str(tmp_path / "m")), model)
    assert back.step == 12
    for a, b in zip([*back.values, *sum(back.slots, [])], [*start.values, *sum(start.slots, [])]):
        assert (a == b).all()


def test_initial_parameters(spark):
    model = dense_model([100, 90, 5], weight_std=0.1, bias=0.01)
    one = params.collect_params(params.initial_table(spark, model, seed=4), model)
    two = params.collect_params(params.initial_table(spark, model, seed=4), model)
    other = params.collect_params(params.initial_table(spark, model, seed=40), model)
    for i, (_, name, _) in enumerate(model.tensors()):
        assert (one.values[i] == two.values[i]).all()
        if name == "b":
            assert (one.values[i] == 0.01).all()
        else:
            assert np.abs(one.values[i]).max() <= 0.2
            assert (one.values[i] != other.values[i]).any()
    # a normal cut at two deviations has 0.88 of the deviation
    assert one.values[0].std() == pytest.approx(0.088, rel=0.03)
    assert abs(one.values[0].mean()) < 0.005


def test_draws_do_not_depend_on_the_tasks(spark):
    def drawn():
        return {r.chunk: r["values"] for r in params.truncated_normal(spark, 10_000, 0.1, 5).collect()}

    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    wide = drawn()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    assert drawn() == wide and sum(map(len, wide.values())) == 10_000
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert before is None


def test_xavier_bounds(spark):
    values = np.concatenate([np.array(r["values"]) for r in params.xavier_uniform(spark, 30, 20, 1).collect()])
    bound = np.sqrt(6 / 50)
    assert len(values) == 600 and np.abs(values).max() <= bound and np.abs(values).max() > 0.9 * bound


def test_data_sets():
    assert {n: s.model.n_params for n, s in DATASETS.items()} == {"mnist": 1_863_690, "higgs": 8_454_145, "molecular": 14_305_295}
    assert image_model().n_params == 3_274_634
    assert dataset("mnist").light_warmup().warmup_rows == 50
    assert dataset("higgs").paths("/data/") == ("/data/higgs_train_all.csv", "/data/higgs_test_all.csv")
    with pytest.raises(ValueError, match="unknown data set"):
        dataset("other")


@pytest.mark.parametrize("n", [1000, 1100])
def test_messages_without_a_chunk_leave_it_as_it_was(spark, n):
    model = dense_model([3, 2])
    start = Parameters.fresh([np.ones((3, 2)), np.full(2, 5.0)], model.optimizer)
    table = params.to_table(spark, model, start)
    rows = [(i, 0, "W", 0, [0.01 * (i % 7)] * 6) for i in range(n)]
    log = spark.createDataFrame(rows, "id long, layer int, name string, chunk int, values array<double>")
    got = {r["name"]: r for r in message_log.apply_log(table, log, model.optimizer, ["id"]).collect()}
    before = {r["name"]: r for r in table.collect()}
    assert got["b"] == before["b"] and got["W"]["step"] == n and got["W"]["values"] != before["W"]["values"]


def test_an_empty_gradient_changes_nothing(spark):
    model = dense_model([3, 2])
    table = params.to_table(spark, model, Parameters.fresh([np.ones((3, 2)), np.zeros(2)], model.optimizer))
    none = table.select("layer", "name", "chunk", "values").limit(0)
    after = params.apply_gradient(table, none, model.optimizer).select(*table.columns)
    assert sorted(map(str, after.collect())) == sorted(map(str, table.collect()))


def test_a_gradient_of_another_length_is_refused(spark):
    model = dense_model([3, 2])
    table = params.to_table(spark, model, Parameters.fresh([np.ones((3, 2)), np.zeros(2)], model.optimizer))
    wrong = spark.createDataFrame([(0, "W", 0, [1.0])], "layer int, name string, chunk int, values array<double>")
    with pytest.raises(Exception, match="differs in length"):
        params.apply_gradient(table, wrong, model.optimizer).collect()


def test_draws_are_uniform_and_normal():
    u = draws.uniforms(np.arange(200)[:, None], 3, np.arange(1, 501))
    assert u.shape == (200, 500) and 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.005
    assert np.abs(np.corrcoef(u[:, :20], rowvar=False) - np.eye(20)).max() < 0.35
    p = np.concatenate([np.linspace(1e-6, 1 - 1e-6, 999), [0.075, 0.925]])
    np.testing.assert_allclose(draws.normal_quantile(p), [NormalDist().inv_cdf(x) for x in p], rtol=1e-12, atol=1e-15)
    assert draws.BELOW_TWO == pytest.approx(NormalDist().cdf(-2), rel=1e-15)
    z = draws.cut_normals(u.reshape(-1))
    assert np.abs(z).max() <= 2 and z.std() == pytest.approx(0.8796, rel=0.01)
