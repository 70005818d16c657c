"""A whole run over one data set: scan, parse, warm up, train, evaluate, keep the results."""

from __future__ import annotations

import argparse
import logging
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession

from ..functions.parsing import DROPMALFORMED, FAILFAST, parse_lines
from ..operators.batching import BatchPlan, assign_batches
from ..operators.evaluate import mean_partition_error, partition_errors
from ..operators.params import collect_params, initial_table, save_params, to_table
from ..operators.ranking import first_rows
from ..session import discard, materialize, scratch_owner, scratch_path
from ..sources.datasets import DatasetSpec, dataset
from ..sources.sinks import curve_sink
from ..sources.text import LINE_KEY, read_lines
from .train import MEAN, SEQUENTIAL, Fit, fit_rounds, fit_warmup

log = logging.getLogger("rowgrad")


@dataclass
class Run:
    """What a run leaves behind."""

    fit: Fit
    final_error: float
    skipped: dict[str, dict[str, int]]

    @property
    def curve(self):
        return self.fit.curve


def labelled_rows(spark: SparkSession, path: str, spec: DatasetSpec, mode: str, scratch: str) -> tuple[DataFrame, dict[str, int]]:
    """Usable rows of a file or folder with their line key, written once to ``scratch``; and the skip counts."""
    seen = Observation()
    with scratch_owner(spark):
        rows = parse_lines(read_lines(spark, path), spec.layout, mode, observation=seen)
        rows = materialize(rows, "rows", path=scratch)
    counts = dict(seen.get)
    log.info("%s: %s", path, counts)
    return rows, counts


def run_dataset(
    spark: SparkSession,
    spec: DatasetSpec,
    folder: str,
    *,
    seed: int = 0,
    mode: str = MEAN,
    parse_mode: str = FAILFAST,
    eval_every: int = 10,
    limit_rows: int | None = None,
    exclude_warmup: bool = False,
    drop_partial_groups: bool = False,
    curve_path: str | None = None,
    model_path: str | None = None,
    snapshot_path: str | None = None,
    snapshot_every: int | None = None,
) -> Run:
    """Fit ``spec.model`` to ``spec``'s training file and measure it on the test file.

    ``limit_rows`` trains on the first rows only.  ``exclude_warmup`` holds the warm-up rows out
    of the epochs; by default they are trained on again.  Points of the curve are appended to ``curve_path`` as they are measured.
    """
    model = spec.model
    train_path, test_path = spec.paths(folder)
    scratch = scratch_path(spark, "run")
    train_rows, train_counts = labelled_rows(spark, train_path, spec, parse_mode, f"{scratch}/train")
    test_rows, test_counts = labelled_rows(spark, test_path, spec, parse_mode, f"{scratch}/test")
    if limit_rows is not None:
        train_rows = first_rows(train_rows, LINE_KEY, limit_rows)
    dropout = seed if model.keep_prob < 1.0 else None

    start = collect_params(initial_table(spark, model, seed), model)
    sink = None if curve_path is None else curve_sink(spark, curve_path, f"{spec.name}_{int(time.time())}")
    fit = fit_warmup(train_rows, model, LINE_KEY, spec.warmup_rows, spec.batch_size, start, dropout, sink)
    plan = BatchPlan(tuple(LINE_KEY), spec.n_parts, spec.batch_size, seed=seed)
    trained = fit_rounds(
        train_rows,
        model,
        plan,
        fit.params,
        epochs=spec.epochs,
        mode=mode,
        eval_df=test_rows,
        eval_every=eval_every,
        drop_partial_groups=drop_partial_groups,
        exclude_first=spec.warmup_rows if exclude_warmup else 0,
        dropout_seed=dropout,
        snapshot_path=snapshot_path,
        snapshot_every=snapshot_every,
        sink=sink,
    )
    fit = Fit(trained.params, fit.curve + trained.curve, sink)

    parts = assign_batches(test_rows, BatchPlan(tuple(LINE_KEY), spec.n_parts, 0, seed=seed))
    error = mean_partition_error(partition_errors(parts, model, fit.params.values)).first()["error"]
    fit.record("final", fit.params.step, error)
    if model_path is not None:
        save_params(to_table(spark, model, fit.params), model_path)
    discard(spark, scratch)
    return Run(fit, error, {"train": train_counts, "test": test_counts})


def settings(argv: list[str] | None = None) -> tuple[DatasetSpec, dict]:
    """What the command line asks for: a data set, with its own run settings replaced where given, and the options of ``run_dataset``."""
    parser = argparse.ArgumentParser(description="Fit one of the known data sets.")
    parser.add_argument("name")
    parser.add_argument("folder")
    own = parser.add_argument_group("run settings", "the data set's own where not given")
    own.add_argument("--train-file")
    own.add_argument("--test-file")
    own.add_argument("--n-parts", type=int, help="logical partitions of an epoch")
    own.add_argument("--warmup-rows", type=int)
    own.add_argument("--batch-size", type=int)
    own.add_argument("--epochs", type=int)
    own.add_argument("--light-warmup", action="store_true", help="warm up with a single batch")
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--mode", choices=[MEAN, SEQUENTIAL], default=MEAN)
    parser.add_argument("--parse-mode", choices=[FAILFAST, DROPMALFORMED], default=FAILFAST)
    parser.add_argument("--eval-every", type=int, default=10, help="rounds between measurements")
    parser.add_argument("--limit-rows", type=int)
    parser.add_argument("--exclude-warmup", action="store_true")
    parser.add_argument("--drop-partial-groups", action="store_true")
    parser.add_argument("--curves")
    parser.add_argument("--model")
    parser.add_argument("--snapshots")
    parser.add_argument("--snapshot-every", type=int, help="rounds between snapshots inside an epoch")
    a = parser.parse_args(argv)
    given = {k: v for k in ("train_file", "test_file", "n_parts", "warmup_rows", "batch_size", "epochs") if (v := getattr(a, k)) is not None}
    spec = replace(dataset(a.name), **given)
    options = {k: getattr(a, k) for k in ("folder", "seed", "mode", "parse_mode", "eval_every", "limit_rows", "exclude_warmup", "drop_partial_groups", "snapshot_every")}
    options |= {"curve_path": a.curves, "model_path": a.model, "snapshot_path": a.snapshots}
    return spec.light_warmup() if a.light_warmup else spec, options


def main(argv: list[str] | None = None) -> None:
    spec, options = settings(argv)
    logging.basicConfig(level=logging.INFO)
    run = run_dataset(SparkSession.builder.appName(f"rowgrad-{spec.name}").getOrCreate(), spec, **options)
    print(f"final error {run.final_error:f}")
