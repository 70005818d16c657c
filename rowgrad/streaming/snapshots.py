"""Results of micro-batches, one folder per batch, so that a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "batch="


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_finished(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Was this batch's folder written to the end?"""
    marker, fs = _folder(spark, f"{path}/{_PREFIX}{batch_id}/_SUCCESS")
    return fs.exists(marker)


def finished_batches(spark: SparkSession, path: str) -> list[int]:
    """Ids of all finished batches, ascending."""
    folder, fs = _folder(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    ids = [int(n.removeprefix(_PREFIX)) for n in names if n.startswith(_PREFIX)]
    return sorted(i for i in ids if is_finished(spark, path, i))


def write_batch(df: DataFrame, path: str, batch_id: int, keep: int | None = None) -> None:
    """Write a batch's snapshot; with ``keep`` only the newest so many stay."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/{_PREFIX}{batch_id}")
    if keep is not None and batch_id >= keep:
        old, fs = _folder(spark, f"{path}/{_PREFIX}{batch_id - keep}")
        fs.delete(old, True)


def read_batch(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{_PREFIX}{batch_id}")


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest finished snapshot, or the newest one older than batch ``before``."""
    if before is not None and is_finished(spark, path, before - 1):
        return read_batch(spark, path, before - 1)  # no listing in the usual case
    done = [b for b in finished_batches(spark, path) if before is None or b < before]
    return read_batch(spark, path, done[-1]) if done else None
