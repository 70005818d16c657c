"""Training curves as an append-only table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CURVE_SCHEMA = "phase string, ts timestamp, step long, error double"


def append_curve(curve: DataFrame, path: str, run_id: str) -> None:
    """Add the points of one run; each run has its own folder."""
    curve.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def curve_sink(spark: SparkSession, path: str, run_id: str) -> Callable[[str, datetime, int, float], None]:
    """A function that appends one point as soon as it is measured."""

    def record(phase: str, ts: datetime, step: int, error: float) -> None:
        append_curve(spark.createDataFrame([(phase, ts, step, error)], CURVE_SCHEMA).coalesce(1), path, run_id)

    return record


def read_curve(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    curve = spark.read.schema(f"{CURVE_SCHEMA}, run_id string").parquet(path)
    return curve if run_id is None else curve.filter(F.col("run_id") == run_id)


def newest_points(curve: DataFrame) -> DataFrame:
    """One point for each run, phase and step: the one measured last, where a resumed run has measured again."""
    last = Window.partitionBy("run_id", "phase", "step").orderBy(F.desc("ts"))
    return curve.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
