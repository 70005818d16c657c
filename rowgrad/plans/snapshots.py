"""Snapshots of a running fit, so that a lost driver costs a few rounds."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import CURVE_SCHEMA

_PREFIX = "round="
_MANIFEST = f"settings string, epoch long, next_round long, step long, curve array<struct<{', '.join(f'{n}: {t}' for n, t in (c.split() for c in CURVE_SCHEMA.split(', ')))}>>"


@dataclass
class Snapshot:
    """Where a fit stood: the epoch and round that come next, the rounds made, the parameters and the curve so far."""

    epoch: int
    next_round: int
    step: int
    table: DataFrame
    curve: list[tuple[str, datetime, int, float]]


class Rounds:
    """Snapshots below one path, bound to the settings of the fit.

    A snapshot is a folder with parameters and, written after them, a manifest; without a finished manifest it doesn't count.  The
    newest two stay.
    """

    def __init__(self, spark: SparkSession, path: str, settings: str):
        self.spark, self.path, self.settings = spark, path, settings

    def _folder(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def steps(self) -> list[int]:
        """Rounds after which there is a whole snapshot, ascending."""
        folder, fs = self._folder(self.path)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        steps = [int(n.removeprefix(_PREFIX)) for n in names if n.startswith(_PREFIX)]
        return sorted(s for s in steps if fs.exists(self._folder(f"{self.path}/{_PREFIX}{s}/manifest/_SUCCESS")[0]))

    def commit(self, table: DataFrame, curve: list[tuple[str, datetime, int, float]], epoch: int, next_round: int, step: int) -> None:
        at = f"{self.path}/{_PREFIX}{step}"
        older = [s for s in self.steps() if s != step]
        # a snapshot of the same round that was cut off, or of a run that goes on after more epochs, is written anew
        _, fs = self._folder(at)
        fs.delete(self._folder(f"{at}/manifest")[0], True)
        table.write.mode("overwrite").parquet(f"{at}/params")
        manifest = [(self.settings, epoch, next_round, step, [tuple(p) for p in curve])]
        self.spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{at}/manifest")
        for s in older[:-1]:
            fs.delete(self._folder(f"{self.path}/{_PREFIX}{s}")[0], True)

    def restore(self) -> Snapshot | None:
        """The newest snapshot, or None; one of other settings is an error."""
        steps = self.steps()
        if not steps:
            return None
        at = f"{self.path}/{_PREFIX}{steps[-1]}"
        m = self.spark.read.schema(_MANIFEST).parquet(f"{at}/manifest").first()
        if m["settings"] != self.settings:
            raise ValueError(f"{at} is a snapshot of another fit: {m['settings']}, not {self.settings}")
        return Snapshot(m["epoch"], m["next_round"], m["step"], self.spark.read.parquet(f"{at}/params"), [tuple(p) for p in m["curve"]])
