"""Labelled rows out of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_position_key(df: DataFrame) -> DataFrame:
    """Add ``(file_path, row_index)``, unique for tables that have no key of their own.

    ``df`` must come straight from a parquet scan.
    """
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))


def class_rows(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, label, features)``."""
    return embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


def multi_target_rows(embeddings: DataFrame, n_features: int = 49, n_targets: int = 15) -> DataFrame:
    """``(vec_id, target, features)``: leading values as features, the following ones as targets."""
    values = F.col("embedding").cast("array<double>")
    return embeddings.select(
        "vec_id",
        F.slice(values, n_features + 1, n_targets).alias("target"),
        F.slice(values, 1, n_features).alias("features"),
    )


def single_target_rows(lineitem: DataFrame) -> DataFrame:
    """``(target, features)``: does the line carry return flag R?"""
    return lineitem.select(
        F.array((F.col("l_returnflag") == "R").cast("double")).alias("target"),
        F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"),
    )


def gradient_events(events: DataFrame) -> DataFrame:
    """Message log ``(id, worker, time_sent, arrived, value)``; delivery takes 0 to 120 s."""
    delay = F.make_dt_interval(secs=F.pmod("event_id", F.lit(13)) * 10)
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("worker"),
        F.col("ts").cast("timestamp").alias("time_sent"),
        (F.col("ts") + delay).cast("timestamp").alias("arrived"),
        "value",
    )
