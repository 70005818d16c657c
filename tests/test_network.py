import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgrad.functions import losses
from rowgrad.operators import gradients, network
from rowgrad.operators.evaluate import evaluate
from rowgrad.operators.network import MSE, conv_model, dense_model
from rowgrad.operators.scoring import score


def random_params(model, seed=1):
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 0.4, shape) for _, _, shape in model.tensors()]


def loss_sum(model, params, x, y, mask=None):
    scores, _ = network.forward(model, params, x, mask)
    if model.loss == MSE:
        return ((scores - y) ** 2).sum()
    top = scores.max(axis=1)
    return (np.log(np.exp(scores - top[:, None]).sum(axis=1)) + top - scores[np.arange(len(y)), y]).sum()


MODELS = {
    "dense_xent": dense_model([6, 5, 4, 3]),
    "dense_mse": dense_model([6, 5, 2], loss=MSE),
    "conv": conv_model(6, (2, 3), 4, 3, kernel=5),
    "conv_odd_side": conv_model(5, (2, 2), 4, 3, kernel=3),
    "conv_even_kernel": conv_model(4, (2,), 4, 3, kernel=2),
}


@pytest.mark.parametrize("name", MODELS)
@pytest.mark.parametrize("dropout", [False, True])
def test_gradient_matches_central_differences(name, dropout):
    model = MODELS[name]
    rng = np.random.default_rng(7)
    x = rng.normal(size=(9, model.n_in))
    y = rng.normal(size=(9, model.n_out)) if model.loss == MSE else rng.integers(0, model.n_out, 9)
    params = random_params(model)
    mask = network.dropout_mask(np.arange(9) * 977, model.stages[-1].n_in, 0.5, 3) if dropout else None
    _, factors = network.row_factors(model, params, x, y, mask)
    got = network.weighted_gradient(factors, np.arange(9), np.ones(9))
    eps = 1e-6
    for p, g in zip(params, got):
        flat = p.reshape(-1)
        for i in rng.choice(flat.size, min(flat.size, 25), replace=False):
            old = flat[i]
            flat[i] = old + eps
            up = loss_sum(model, params, x, y, mask)
            flat[i] = old - eps
            down = loss_sum(model, params, x, y, mask)
            flat[i] = old
            assert g.reshape(-1)[i] == pytest.approx((up - down) / (2 * eps), rel=1e-4, abs=1e-5)


def test_dropout_mask_keeps_half_scales_and_repeats():
    keys = np.arange(2000, dtype=np.int64) * 7919
    mask = network.dropout_mask(keys, 64, 0.5, 11)
    assert set(np.unique(mask)) == {0.0, 2.0}
    assert abs(mask.mean() - 1.0) < 0.02
    assert (mask == network.dropout_mask(keys, 64, 0.5, 11)).all()
    assert (mask != network.dropout_mask(keys, 64, 0.5, 12)).mean() > 0.4
    # a row's mask does not depend on the rows around it
    assert (network.dropout_mask(keys[5:6], 64, 0.5, 11) == mask[5:6]).all()


def frame(spark, model, n=60, parts=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, model.n_in))
    if model.loss == MSE:
        y = rng.normal(size=(n, model.n_out))
        rows = [(i, i % 4, [float(v) for v in y[i]], [float(v) for v in x[i]]) for i in range(n)]
        return x, y, spark.createDataFrame(rows, "id long, part_id int, target array<double>, features array<double>").repartition(parts)
    y = rng.integers(0, model.n_out, n)
    rows = [(i, i % 4, int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "id long, part_id int, label int, features array<double>").repartition(parts)


@pytest.mark.parametrize("name", ["dense_xent", "dense_mse", "conv"])
def test_distributed_gradient_is_the_local_one(spark, name):
    model = MODELS[name]
    params = random_params(model)
    x, y, df = frame(spark, model)
    for parts in (1, 7):
        got = gradients.collect_gradient(gradients.gradient_sum(df.repartition(parts), model, params), model)
        _, factors = network.row_factors(model, params, x, y)
        for g, want in zip(got, network.weighted_gradient(factors, np.arange(len(x)), np.ones(len(x)))):
            np.testing.assert_allclose(g, want, rtol=1e-9, atol=1e-9)


def test_groups_survive_early_hand_over(spark, monkeypatch):
    """Partial sums handed on before a task has seen all its rows still add up."""
    model = MODELS["dense_xent"]
    params = random_params(model)
    x, y, df = frame(spark, model)
    want = {}
    for part in range(4):
        rows = np.arange(len(x)) % 4 == part
        _, factors = network.row_factors(model, params, x[rows], y[rows])
        want[part] = network.weighted_gradient(factors, np.arange(rows.sum()), np.ones(rows.sum()))
    monkeypatch.setattr(gradients, "_HELD_BYTES", 1)
    monkeypatch.setattr(network, "BLOCK_BYTES", 2000)
    got = gradients.gradient_sum(df, model, params, ["part_id"])
    for part in range(4):
        for g, w in zip(gradients.collect_gradient(got.filter(F.col("part_id") == part), model), want[part]):
            np.testing.assert_allclose(g, w, rtol=1e-9, atol=1e-9)


def test_mean_over_batches_counts_short_batches_in_full(spark):
    rows = [(0, "W", 0, [1.0, 2.0], 50), (0, "W", 0, [3.0, 6.0], 1)]
    df = spark.createDataFrame(rows, "layer int, name string, chunk int, values array<double>, n_rows long")
    row = gradients.mean_over_batches(df, []).first()
    assert row["values"] == [2.0, 4.0] and row.n_batches == 2


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0, 2.0, 1.0],)], "s array<double>")
    assert [r.p for r in df.select(losses.argmax(F.col("s")).alias("p")).collect()] == [1, 0]


def test_xent_is_stable_for_large_scores(spark):
    df = spark.createDataFrame([([1000.0, 0.0], 1), ([-1000.0, -1000.0], 0)], "s array<double>, y int")
    got = [r.l for r in df.select(losses.softmax_xent(F.col("s"), F.col("y")).alias("l")).collect()]
    assert got[0] == pytest.approx(1000.0) and got[1] == pytest.approx(np.log(2))


def test_scores_refuse_rows_of_another_width(spark):
    model = MODELS["dense_xent"]
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, features array<double>")
    with pytest.raises(Exception, match="expected 6 values"):
        score(df, model, random_params(model), ["id"]).collect()


def test_evaluate_mse_and_error_rate(spark):
    for name in ("dense_mse", "dense_xent"):
        model = MODELS[name]
        params = random_params(model)
        x, y, df = frame(spark, model)
        row = evaluate(df, model, params).first()
        scores, _ = network.forward(model, params, x)
        want = ((scores - y) ** 2).mean() if name == "dense_mse" else (scores.argmax(axis=1) != y).mean()
        assert row.n == 60 and row.error == pytest.approx(want)


def test_too_large_models_are_refused():
    with pytest.raises(ValueError, match="do not fit"):
        dense_model([20000, 20000])
