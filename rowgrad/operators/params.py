"""Parameter tables: ``(layer, name, chunk, values, <slots>, step)``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import cut_normals, uniforms
from ..functions.optim import Optimizer
from .network import ModelSpec

CHUNK = 4096
KEYS = ["layer", "name", "chunk"]


@dataclass
class Parameters:
    """The driver's copy of a model: tensors, optimizer slots and the number of updates made."""

    values: list[np.ndarray]
    slots: list[list[np.ndarray]]
    step: int = 0

    @staticmethod
    def fresh(values: list[np.ndarray], optimizer: Optimizer) -> "Parameters":
        values = [np.asarray(v, dtype=np.float64) for v in values]
        return Parameters(values, [[np.full_like(v, s) for v in values] for s in optimizer.slot_start])

    def updated(self, gradient: list[np.ndarray], optimizer: Optimizer) -> "Parameters":
        """The parameters after one more gradient."""
        step = self.step + 1
        values, slots = [], [[] for _ in self.slots]
        for i, g in enumerate(gradient):
            new = optimizer.advance([s[i] for s in self.slots], g)
            values.append(self.values[i] + optimizer.change(new, g, step, np.sqrt))
            for kept, s in zip(slots, new):
                kept.append(s)
        return Parameters(values, slots, step)


def chunk_keys(model: ModelSpec) -> list[tuple[int, str, int]]:
    return [(layer, name, c) for layer, name, shape in model.tensors() for c in range(-(-int(np.prod(shape)) // CHUNK))]


def chunk_column(tensors: list[np.ndarray]) -> pa.ListArray:
    """Tensors cut into the value lists of a parameter table, in ``chunk_keys`` order."""
    ends, at = [0], 0
    for t in tensors:
        ends += [at + min(i + CHUNK, t.size) for i in range(0, t.size, CHUNK)]
        at += t.size
    flat = np.concatenate([t.reshape(-1) for t in tensors])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def from_chunks(model: ModelSpec, rows: dict[tuple[int, str, int], np.ndarray]) -> list[np.ndarray]:
    """Tensors from ``{(layer, name, chunk): values}``."""
    out = []
    for layer, name, shape in model.tensors():
        n = -(-int(np.prod(shape)) // CHUNK)
        out.append(np.concatenate([np.asarray(rows[layer, name, c]) for c in range(n)]).reshape(shape))
    return out


def to_table(spark: SparkSession, model: ModelSpec, params: Parameters) -> DataFrame:
    """The parameter table; at most ``MODEL_LIMIT_BYTES`` per column by construction."""
    keys = chunk_keys(model)
    columns = {k: [key[i] for key in keys] for i, k in enumerate(KEYS)}
    columns = {"layer": pa.array(columns["layer"], pa.int32()), "name": columns["name"], "chunk": pa.array(columns["chunk"], pa.int32())}
    columns["values"] = chunk_column(params.values)
    for name, slot in zip(model.optimizer.slots, params.slots):
        columns[name] = chunk_column(slot)
    columns["step"] = pa.array([params.step] * len(keys), pa.int64())
    return spark.createDataFrame(pa.table(columns))


def collect_params(table: DataFrame, model: ModelSpec) -> Parameters:
    """Read all parameters; their size was checked when the ``ModelSpec`` was made."""
    slots = list(model.optimizer.slots)
    got = table.select(*KEYS, "values", *slots, "step").toArrow()
    tensors = {c: tensors_of(got, model, c) for c in ["values", *slots]}
    return Parameters(tensors["values"], [tensors[s] for s in slots], got.column("step")[0].as_py())


def tensors_of(table: pa.Table, model: ModelSpec, column: str) -> list[np.ndarray]:
    """The tensors in one column of a collected parameter or gradient table."""
    keys = zip(*[table.column(k).to_pylist() for k in KEYS])
    values = [v.values.to_numpy(zero_copy_only=False) for v in table.column(column)]
    return from_chunks(model, dict(zip(keys, values)))


def save_params(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def apply_gradient(table: DataFrame, gradient: DataFrame, optimizer: Optimizer) -> DataFrame:
    """One update of a parameter table by a gradient table ``(layer, name, chunk, values)``.

    A chunk without gradient keeps its values, slots and step; one of another length is an error.
    """
    g = gradient.select(*KEYS, F.col("values").alias("_g"))
    given = F.col("_g").isNotNull()
    wrong = given & (F.size("_g") != F.size("values"))
    g_checked = F.when(wrong, F.raise_error(F.lit("a gradient chunk differs in length from its parameters"))).otherwise(F.col("_g"))
    joined = table.join(g, KEYS, "left").withColumn("_g", g_checked).withColumn("step", F.col("step") + given.cast("int"))
    lanes = F.arrays_zip("values", *optimizer.slots, "_g")

    def lane(x: Column) -> Column:
        new = optimizer.advance([x[s] for s in optimizer.slots], x["_g"])
        moved = x["values"] + optimizer.change(new, x["_g"], F.col("step"), F.sqrt)
        return F.struct(moved.alias("values"), *[s.alias(n) for s, n in zip(new, optimizer.slots)])

    done = joined.withColumn("_lanes", F.transform(lanes, lane))
    return done.select(*KEYS, *[F.when(given, F.col("_lanes")[n]).otherwise(F.col(n)).alias(n) for n in ["values", *optimizer.slots]], "step")


def flat_values(table: DataFrame, column: str = "values") -> DataFrame:
    """One row per parameter: ``(layer, name, idx, <column>)``."""
    return table.select("layer", "name", "chunk", F.posexplode(column).alias("_i", column)).select(
        "layer", "name", (F.col("chunk") * CHUNK + F.col("_i")).cast("int").alias("idx"), column
    )


def _drawn(spark: SparkSession, n: int, seed: int, draw) -> DataFrame:
    """``(chunk, values)`` of ``n`` values; ``draw(uniform)`` turns numbers from [0, 1) into values.

    A value's number depends on the seed and its place alone, not on chunks or tasks.
    """

    def run(batches):
        for batch in batches:
            for chunk in batch.column("chunk").to_pylist():
                places = np.arange(chunk * CHUNK, min(n, (chunk + 1) * CHUNK))
                values = draw(uniforms(np.zeros(1, np.int64), seed, places + 1))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), chunk_column([values])], ["chunk", "values"])

    chunks = spark.range(-(-n // CHUNK)).select(F.col("id").cast("int").alias("chunk"))
    return chunks.mapInArrow(run, "chunk int, values array<double>")


def truncated_normal(spark: SparkSession, n: int, std: float, seed: int) -> DataFrame:
    """Normal draws, none beyond two deviations."""
    return _drawn(spark, n, seed, lambda uniform: cut_normals(uniform) * std)


def constant(spark: SparkSession, n: int, value: float) -> DataFrame:
    return _drawn(spark, n, 0, lambda uniform: np.full(len(uniform), float(value)))


def xavier_uniform(spark: SparkSession, n_in: int, n_out: int, seed: int) -> DataFrame:
    """Uniform within ±sqrt(6 / (n_in + n_out))."""
    bound = (6.0 / (n_in + n_out)) ** 0.5
    return _drawn(spark, n_in * n_out, seed, lambda uniform: (2 * uniform - 1) * bound)


def initial_table(spark: SparkSession, model: ModelSpec, seed: int = 0) -> DataFrame:
    """A fresh parameter table: truncated-normal weights, constant biases, slots at their start."""
    table = None
    for i, (layer, name, shape) in enumerate(model.tensors()):
        n = int(np.prod(shape))
        drawn = truncated_normal(spark, n, model.weight_std, seed + i) if name == "W" else constant(spark, n, model.bias)
        drawn = drawn.select(F.lit(layer).alias("layer"), F.lit(name).alias("name"), "chunk", "values")
        table = drawn if table is None else table.unionByName(drawn)
    starts = {s: F.transform("values", lambda _, v=v: F.lit(v)) for s, v in zip(model.optimizer.slots, model.optimizer.slot_start)}
    return table.withColumns({**starts, "step": F.lit(0).cast("long")})
