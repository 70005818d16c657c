"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side may be broadcast only when its rows are known to stay under this many bytes.
BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024


def local_session(cpus: int = 8, app: str = "rowgrad") -> SparkSession:
    """A session for tests and for the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="rowgrad-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


_owned = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; inside ``scratch_owner`` it is freed at the end."""
    path = f"{shared_dir(spark)}/rowgrad/{name}-{uuid.uuid4().hex}"
    for paths in getattr(_owned, "stack", []):
        paths.append(path)
    return path


@contextmanager
def scratch_owner(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables made inside, also when it fails; results that are read later must be written elsewhere."""
    stack = _owned.__dict__.setdefault("stack", [])
    paths: list[str] = []
    stack.append(paths)
    try:
        yield
    finally:
        stack.remove(paths)
        for path in paths:
            discard(spark, path)


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The lineage ends at the files, so a lost executor costs a re-read and not a re-shuffle, and
    later jobs get column pruning and row-group pruning.
    """
    target = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    fields = [f"`{c}` {t}" for c, t in df.dtypes]
    return df.sparkSession.read.schema(", ".join(fields)).parquet(target).select(*df.columns)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more; other paths are left alone."""
    if not path.startswith(f"{shared_dir(spark)}/rowgrad/"):
        raise ValueError(f"{path} is no scratch path")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def join_small(df: DataFrame, small: DataFrame, on: list[str] | str, rows: int, row_bytes: int = 64, how: str = "inner") -> DataFrame:
    """Join with a side of at most ``rows`` rows: broadcast under the limit, else Spark's own choice."""
    if rows * row_bytes <= BROADCAST_LIMIT_BYTES:
        small = F.broadcast(small)
    return df.join(small, on, how)


def as_columns(names: list[str] | tuple[str, ...] | str) -> list[Column]:
    return [F.col(n) for n in ([names] if isinstance(names, str) else names)]
