import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgrad.functions.optim import Adam, RMSProp
from rowgrad.functions.parsing import Layout
from rowgrad.operators import params
from rowgrad.operators.network import MSE, dense_model
from rowgrad.plans.job import run_dataset, settings
from rowgrad.sources import sinks, tables
from rowgrad.sources.datasets import DatasetSpec

CLASSES = DatasetSpec(
    name="vectors",
    train_file="train.csv",
    test_file="test.csv",
    layout=Layout("class_first", 64, 10, min_len=2),
    model=dense_model([64, 24, 10], optimizer=Adam(lr=0.01)),
    n_parts=3,
    warmup_rows=60,
    batch_size=20,
    epochs=1,
    max_age_s=100,
)
VALUES = DatasetSpec(
    name="values",
    train_file="train.csv",
    test_file="test.csv",
    layout=Layout("multi_target", 49, 15),
    model=dense_model([49, 16, 15], loss=MSE, optimizer=RMSProp(lr=0.001), keep_prob=1.0),
    n_parts=3,
    warmup_rows=40,
    batch_size=20,
    epochs=1,
    max_age_s=100,
)


def write(spark, folder, tmp_path, with_label):
    rows = tables.class_rows(tables.read_table(spark, folder, "embeddings"))
    values = F.col("features").cast("array<string>")
    line = F.concat_ws(",", F.col("label").cast("string"), values) if with_label else F.concat_ws(",", values)
    line = F.when(F.col("vec_id") % 50 == 1, "").otherwise(line)
    for name, test in (("train.csv", False), ("test.csv", True)):
        rows.filter((F.col("vec_id") % 5 == 0) == test).select(line.alias("value")).write.text(str(tmp_path / name))


def test_a_whole_run_over_labelled_text(spark, folder, tmp_path):
    write(spark, folder, tmp_path, True)
    curves, saved = str(tmp_path / "curves"), str(tmp_path / "model")
    run = run_dataset(spark, CLASSES, str(tmp_path), seed=3, eval_every=2, curve_path=curves, model_path=saved)
    assert run.skipped["train"]["lines"] == 400 and run.skipped["train"]["blank"] == 10
    assert run.skipped["test"] == {"lines": 100, "blank": 0, "short": 0, "malformed": 0, "label_range": 0}
    phases = [p for p, *_ in run.curve]
    assert phases[:3] == ["warmup"] * 3 and "train" in phases and phases[-1] == "final"
    assert 0.0 <= run.final_error <= 1.0
    assert sinks.read_curve(spark, curves).count() == len(run.curve)
    back = params.collect_params(params.load_params(spark, saved), CLASSES.model)
    assert back.step == run.fit.params.step
    again = run_dataset(spark, CLASSES, str(tmp_path), seed=3, eval_every=2)
    for a, b in zip(again.fit.params.values, run.fit.params.values):
        np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9)
    assert again.final_error == run.final_error


def test_a_whole_run_with_several_targets(spark, folder, tmp_path):
    write(spark, folder, tmp_path, False)
    run = run_dataset(spark, VALUES, str(tmp_path), seed=3, mode="sequential", limit_rows=200, exclude_warmup=True)
    # 160 rows in three parts and groups of up to 100 rows: one push per part
    assert run.fit.params.step == 2 + 3
    assert run.final_error == pytest.approx(run.curve[-1][3])


def test_settings_of_a_data_set_can_be_replaced():
    spec, options = settings(["higgs", "/data"])
    assert (spec.n_parts, spec.batch_size, spec.warmup_rows, spec.epochs) == (64, 128, 20000, 1) and options["folder"] == "/data" and options["eval_every"] == 10
    spec, options = settings(
        "mnist /d --n-parts 7 --batch-size 9 --epochs 2 --light-warmup --train-file t.csv --mode sequential --parse-mode DROPMALFORMED --snapshot-every 3 --drop-partial-groups".split()
    )
    assert (spec.n_parts, spec.batch_size, spec.warmup_rows, spec.epochs) == (7, 9, 9, 2) and spec.paths("/d") == ("/d/t.csv", "/d/mnist_test.csv")
    assert (options["mode"], options["parse_mode"], options["snapshot_every"], options["drop_partial_groups"]) == ("sequential", "DROPMALFORMED", 3, True)
    with pytest.raises(ValueError, match="unknown data set"):
        settings(["other", "/d"])
