"""Apply a log of gradient messages to a parameter table, one after the other, in parallel.

The optimizer slots are running averages, ``s' = decay * s + …``, so a block of messages acts on
them as ``s_end = decay^n * s_start + (slots of the block run from zero)``, and the parameter changes depend on the slots
alone.  A short log is run through in one group for each chunk.  A long one is cut into blocks: one pass sums each block up, a
scan carries the slots over the blocks, and a second pass works out each block's parameter changes from its true
starting slots.  The scan itself goes over groups of blocks, groups of groups and so on, so that no task sees
more than a fixed number of messages or blocks, however long the log is.

A message may carry a ``mark``: the parameters right after it are then kept as a state of that number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.optim import Optimizer
from ..session import join_small, materialize
from .gradients import sum_values
from .params import KEYS
from .ranking import row_positions
from .scoring import matrix

BLOCK = 1024  # messages of a chunk that one group runs through
FAN = 1024  # blocks, or groups of blocks, that one step of the scan carries over
STATE = ["mark", *KEYS, "values"]


def apply_log(table: DataFrame, messages: DataFrame, optimizer: Optimizer, order: list[str], total: int | None = None) -> DataFrame:
    """The parameter table after all ``messages`` ``(*order, layer, name, chunk, values)``.

    ``order`` must be a total order of the messages.  A message acts on the chunks it carries; a chunk that none
    carries keeps values, slots and step.  ``total`` is the number of messages, counted here if not given.
    """
    after, _ = apply_marked(table, messages.withColumn("mark", F.lit(None).cast("long")), optimizer, order, total, marked=False)
    return after


def apply_marked(
    table: DataFrame, messages: DataFrame, optimizer: Optimizer, order: list[str], total: int | None = None, marked: bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """As ``apply_log``, and the states ``(mark, layer, name, chunk, values)`` after the messages with a ``mark``.

    A marked message carries every chunk whose state is wanted.
    """
    ids = messages.select(*order).distinct()
    if total is None:
        total = ids.count()
    if not total:
        return table, None
    # only the ids are sorted and numbered; the payload moves once, to the group that works on it
    numbered = row_positions(ids, order, name="seq")
    seq = join_small(messages.select(*order, *KEYS, "values", "mark"), numbered, order, rows=total)
    return _applied(table, seq, optimizer, total, BLOCK, FAN, marked)


def apply_many(table: DataFrame, seq: DataFrame, optimizer: Optimizer, total: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """As ``apply_log`` for messages that are already numbered: ``seq`` ascends with their order, from 1 to at most ``total``."""
    unmarked = seq.withColumn("mark", F.lit(None).cast("long"))
    return _applied(table, unmarked, optimizer, total, block, fan, False)[0]


def apply_numbered(
    table: DataFrame, seq: DataFrame, optimizer: Optimizer, total: int, block: int = BLOCK, fan: int = FAN, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """As ``apply_many``, and the states after the messages with a ``mark``; both are written together, to ``path`` if given."""
    return _applied(table, seq, optimizer, total, block, fan, True, path)


def _applied(table, seq, optimizer, total, block, fan, marked, path=None) -> tuple[DataFrame, DataFrame | None]:
    work = seq.select(*KEYS, "seq", "values", F.col("mark").cast("long").alias("mark"))
    moved = _whole(table, work, optimizer) if total <= block else _by_blocks(table, work, optimizer, total, block, fan, marked)
    slots = list(optimizer.slots)
    if not marked:
        return moved.where("mark is null").select(*KEYS, "values", *slots, "step"), None
    # read twice: as the new table, and as states
    moved = materialize(moved, "applied", path=path)
    return moved.where("mark is null").select(*KEYS, "values", *slots, "step"), moved.where("mark is not null").select(*STATE)


def _whole(table: DataFrame, seq: DataFrame, optimizer: Optimizer) -> DataFrame:
    """A log short enough for one group of each chunk: rows of the new table, and of states (without slots)."""
    slots = list(optimizer.slots)
    schema = f"layer int, name string, chunk int, mark long, values array<double>, {_arrays(slots)}, step long"

    def run_chunk(key, left, right):
        _known(key, left)
        values, step = _rows(left, "values")[0], left.column("step")[0].as_py()
        starts = [_rows(left, s)[0] for s in slots]
        states, marks, ends, n = [], [], starts, right.num_rows
        if n:
            right = right.sort_by("seq")
            g = _rows(right, "values")
            run = _running(optimizer, starts, g)
            so_far = values + np.cumsum(_changes(optimizer, run, g, step), axis=0)
            marks, at = _marks(right)
            states, values, ends = list(so_far[at]), so_far[-1], [s[-1] for s in run]
        nothing = [None] * len(marks)
        columns = {"mark": pa.array([*marks, None], pa.int64()), "values": [*states, values], **{s: [*nothing, e] for s, e in zip(slots, ends)}}
        return _table({**_keys(key, len(marks) + 1), **columns, "step": pa.array([step + n] * (len(marks) + 1), pa.int64())})

    before = table.select(*KEYS, "values", *slots, "step")
    return before.groupBy(*KEYS).cogroup(seq.groupBy(*KEYS)).applyInArrow(run_chunk, schema)


def _by_blocks(table: DataFrame, seq: DataFrame, optimizer: Optimizer, total: int, block: int, fan: int, marked: bool) -> DataFrame:
    """The same rows for a log of any length."""
    slots = list(optimizer.slots)
    by_block = [*KEYS, "block"]
    n_blocks = -(-total // block)
    blocked = seq.withColumn("block", F.floor((F.col("seq") - 1) / block).cast("int"))

    def summarize(key, messages):
        g = _rows(messages.sort_by("seq"), "values")
        run = _running(optimizer, [np.zeros(g.shape[1]) for _ in slots], g)
        return _table({**_keys(key), **{n: [s[-1]] for n, s in zip(slots, run)}, "n": pa.array([len(g)], pa.int64())})

    def run_block(key, left, right):
        right = right.sort_by("seq")
        g, step = _rows(right, "values"), left.column("step")[0].as_py()
        run = _running(optimizer, [_rows(left, s)[0] for s in slots], g)
        so_far = np.cumsum(_changes(optimizer, run, g, step), axis=0)
        marks, at = _marks(right)
        nothing = [None] * len(marks)
        columns = {"mark": pa.array([*marks, None], pa.int64()), "change": [*so_far[at], so_far[-1]], **{s: [*nothing, e[-1]] for s, e in zip(slots, run)}}
        return _table({**_keys(key, len(marks) + 1), **columns, "n": pa.array([len(g)] * (len(marks) + 1), pa.int64())})

    summaries = blocked.groupBy(*by_block).applyInArrow(summarize, f"layer int, name string, chunk int, block int, {_arrays(slots)}, n long")
    starts = _carried(table.select(*KEYS, *slots, "step"), summaries, dict(zip(slots, optimizer.decays)), n_blocks, fan)
    schema = f"layer int, name string, chunk int, block int, mark long, change array<double>, {_arrays(slots)}, n long"
    changes = starts.groupBy(*by_block).cogroup(blocked.groupBy(*by_block)).applyInArrow(run_block, schema)
    # both passes end here: what follows reads one row for each block and mark
    changes = materialize(changes, "changes")
    whole = changes.where("mark is null")
    ends = whole.groupBy(*KEYS).agg(F.max_by(F.struct(*slots), "block").alias("_last"), F.sum("n").alias("_n"))
    moved = sum_values(whole.select(*KEYS, F.col("change").alias("values"), F.lit(1).alias("n_rows")), [])
    moved = moved.select(*KEYS, F.col("values").alias("_change"))
    joined = table.join(moved, KEYS, "left").join(ends, KEYS, "left")

    def added(values, change):
        return F.zip_with(values, change, lambda p, c: p + c)

    after = joined.select(
        *KEYS,
        F.lit(None).cast("long").alias("mark"),
        F.coalesce(added("values", "_change"), F.col("values")).alias("values"),
        *[F.coalesce(F.col("_last")[s], F.col(s)).alias(s) for s in slots],
        (F.col("step") + F.coalesce("_n", F.lit(0))).alias("step"),
    )
    if not marked:
        return after
    values = _carried(table.select(*KEYS, F.col("values").alias("change"), "step"), whole.select(*by_block, "change", "n"), {"change": 1.0}, n_blocks, fan)
    values = values.select(*by_block, F.col("change").alias("_start"), "step")
    states = changes.where("mark is not null").drop("step").join(values, by_block)
    nothing = [F.lit(None).cast("array<double>").alias(s) for s in slots]
    return after.unionByName(states.select(*KEYS, "mark", added("_start", "change").alias("values"), *nothing, "step"))


def _carried(state: DataFrame, parts: DataFrame, lanes: dict[str, float], n_blocks: int, fan: int) -> DataFrame:
    """What each block starts from: ``(layer, name, chunk, block, *lanes, step)``.

    ``state`` holds the lanes and the step before the first block, ``parts`` what each block of ``n`` messages adds to
    them; a lane decays by its factor with every message.
    """
    names = list(lanes)
    decays = list(lanes.values())
    sums = f"layer int, name string, chunk int, block int, {_arrays(names)}, n long"
    starts = f"layer int, name string, chunk int, block int, {_arrays(names)}, step long"

    def through(run, part):
        """The lanes before each of the blocks, and after the last."""
        n, fed = part.column("n").to_pylist(), [_rows(part, x) for x in names]
        before = [[] for _ in names]
        for i in range(len(n)):
            for k, decay in enumerate(decays):
                before[k].append(run[k])
                run[k] = decay ** n[i] * run[k] + fed[k][i]
        return before, run, n

    def combine(key, part):
        part = part.sort_by("block")
        width = len(part.column(names[0])[0])
        _, run, n = through([np.zeros(width) for _ in names], part)
        return _table({**_keys(key), **{x: [r] for x, r in zip(names, run)}, "n": pa.array([sum(n)], pa.int64())})

    def walk(key, left, right):
        _known(key, left)
        right = right.sort_by("block")
        before, _, n = through([_rows(left, x)[0] for x in names], right)
        steps = left.column("step")[0].as_py() + np.cumsum([0, *n])[: len(n)]
        columns = {**dict(zip(names, before)), "step": pa.array(steps, pa.int64())}
        return _table({**_keys(key[:3], len(n)), "block": right.column("block").combine_chunks(), **columns})

    if n_blocks <= fan:
        return state.groupBy(*KEYS).cogroup(parts.groupBy(*KEYS)).applyInArrow(walk, starts)
    above = parts.withColumn("_above", F.floor(F.col("block") / fan).cast("int"))
    grouped = above.groupBy(*KEYS, "_above").applyInArrow(combine, sums)
    higher = _carried(state, grouped, lanes, -(-n_blocks // fan), fan)
    return higher.groupBy(*KEYS, "block").cogroup(above.groupBy(*KEYS, "_above")).applyInArrow(walk, starts)


def _known(key, left: pa.Table) -> None:
    if not left.num_rows:
        raise ValueError(f"messages carry the chunk {[k.as_py() for k in key]}, which the parameter table lacks")


def _arrays(names: list[str]) -> str:
    return ", ".join(f"{n} array<double>" for n in names)


def _keys(key, n: int = 1) -> dict[str, pa.Array]:
    return {k: pa.array([v.as_py()] * n, v.type) for k, v in zip([*KEYS, "block"], key)}


def _table(columns: dict) -> pa.Table:
    doubles = pa.list_(pa.float64())
    return pa.table({k: pa.array(v, doubles) if isinstance(v, list) else v for k, v in columns.items()})


def _rows(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    return matrix(values, len(values[0]) if len(values) else 0)


def _marks(messages: pa.Table) -> tuple[list[int], np.ndarray]:
    """The marks of sorted messages and the rows they are in."""
    marks = messages.column("mark").combine_chunks()
    at = np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False))
    return marks.take(pa.array(at)).to_pylist(), at


def _running(optimizer: Optimizer, start: list[np.ndarray], g: np.ndarray) -> list[np.ndarray]:
    """The slots after each of the gradients in the rows of ``g``.

    ``s_i = decay * s_(i-1) + fed_i`` is summed by doubling: after a pass each row holds what the
    last 1, 2, 4, … gradients left behind.
    """
    out = []
    fed = optimizer.advance([np.zeros_like(s) for s in start], g)
    for s0, decay, s in zip(start, optimizer.decays, fed):
        s[0] += decay * s0
        reach = 1
        while reach < len(s):
            s[reach:] += decay**reach * s[:-reach]
            reach *= 2
        out.append(s)
    return out


def _changes(optimizer: Optimizer, run: list[np.ndarray], g: np.ndarray, step: int) -> np.ndarray:
    """The parameter change of each of the gradients in ``g`` after ``step`` earlier ones."""
    steps = step + np.arange(1.0, len(g) + 1)[:, None]
    return optimizer.change(run, g, steps, np.sqrt)
