"""Logical partitions, mini-batches and push groups.

Every assignment is a function of a row's key, the seed and the epoch, never of how Spark happens
to lay the rows out, so a repeated task or another cluster gives the same batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_small
from .ranking import first_keys, running_before

_HASH_BITS = 60
TASK_BYTES = 64 << 20  # what one ranking task is meant to see
ROW_BYTES = 256  # a row, where its width isn't known


@dataclass(frozen=True)
class BatchPlan:
    """How rows are spread over logical partitions and cut into batches.

    ``key`` must be unique (see ``sources.text`` and ``sources.tables`` for position keys).
    ``batch_size=0`` makes one batch of a whole logical partition.
    ``hashing="md5"`` is slower but can be recomputed by any SQL engine.
    """

    key: tuple[str, ...]
    n_parts: int
    batch_size: int
    push_every: int = 5
    seed: int = 0
    hashing: str = "xxhash64"

    def __post_init__(self):
        if self.hashing not in ("xxhash64", "md5"):
            raise ValueError(f"unknown hashing {self.hashing!r}")
        if self.n_parts < 1 or self.batch_size < 0 or self.push_every < 1:
            raise ValueError("n_parts and push_every start at 1, batch_size at 0")


def row_hash(key: tuple[str, ...], salt: int, hashing: str = "xxhash64") -> Column:
    """60 random-looking bits per key."""
    if hashing == "md5":
        digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(salt))))
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return F.shiftrightunsigned(F.xxhash64(*key, F.lit(salt)), 64 - _HASH_BITS)


def with_parts(df: DataFrame, plan: BatchPlan, epoch: int = 0) -> DataFrame:
    """Add ``row_hash`` and ``part_id``; the assignment is drawn anew for every epoch."""
    hashed = df.withColumn("row_hash", row_hash(plan.key, plan.seed + epoch, plan.hashing))
    return hashed.withColumn("part_id", F.pmod("row_hash", F.lit(plan.n_parts)).cast("int"))


def cells_for(rows: int, row_bytes: int = ROW_BYTES) -> int:
    """Into how many hash ranges a table is cut so that a task holds one of them."""
    return max(1, -(-rows * row_bytes // TASK_BYTES))


def redistribute(df: DataFrame, plan: BatchPlan, epoch: int = 0, slices: int = 1) -> DataFrame:
    """Move every row to the task ``task_id`` of its ``part_id``: ``slices`` tasks for each logical partition, and no other partition in them."""
    parted = with_parts(df, plan, epoch)
    # whole numbers: a double would round the hash
    slice_id = F.pmod(F.expr(f"row_hash div {plan.n_parts}"), F.lit(slices)).cast("int")
    parted = parted.withColumn("task_id", F.col("part_id") * slices + slice_id)
    return parted.repartitionById(plan.n_parts * slices, F.col("task_id"))


def with_cells(df: DataFrame, plan: BatchPlan, epoch: int, cells: int) -> DataFrame:
    """Add ``cell``: the range of the hash a row falls in, ascending with the hash, the same ranges for all logical partitions."""
    width = (1 << _HASH_BITS) // cells + 1
    return with_parts(df, plan, epoch).withColumn("cell", F.floor(F.col("row_hash") / F.lit(width)).cast("int") if cells > 1 else F.lit(0))


def cell_offsets(parted: DataFrame) -> DataFrame:
    """Per ``(part_id, cell)``: rows of the part in earlier cells, and rows of the whole part.

    Reads key columns only; the counts are combined on the map side, and no task adds up all cells of a part.
    """
    counts = parted.groupBy("part_id", "cell").agg(F.count(F.lit(1)).alias("cell_rows"))
    return running_before(counts, "part_id", "cell", "cell_rows", "cell_start", "part_rows")


def part_sizes(df: DataFrame, plan: BatchPlan, epoch: int = 0) -> DataFrame:
    """Rows of every logical partition that has any: ``(part_id, part_rows)``."""
    return with_parts(df.select(*plan.key), plan, epoch).groupBy("part_id").agg(F.count(F.lit(1)).alias("part_rows"))


def assign_batches(df: DataFrame, plan: BatchPlan, epoch: int = 0, cells: int | None = None, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Add ``row_hash, part_id, cell, batch_id, group_id, batch_rows, group_batches, part_rows``.

    Inside a logical partition rows are ordered by their hash and cut into ``batch_size`` rows;
    ``push_every`` batches in a row form a group.  ``batch_rows`` and ``group_batches`` tell the
    true size of a row's batch and group, as the last ones may be short.

    All partitions are cut into the same hash ranges, the cells, sized by ``row_bytes``, and a task ranks the rows of one cell: a row's place is its
    place in its part's share of the cell plus the part's rows in earlier cells.  These starts travel with the rows, as one
    more row for each part and cell, so that nothing is broadcast and the rows move once.  Neighbouring places are in the same or
    the next cell, so a group's rows end up in one or two tasks.
    """
    if plan.batch_size == 0:
        sizes = part_sizes(df, plan, epoch)
        ranked = join_small(with_parts(df, plan, epoch).withColumn("cell", F.lit(0)), sizes, "part_id", rows=plan.n_parts).withColumn("batch_id", F.lit(0))
        return with_group_columns(ranked, F.col("part_rows"), plan.push_every)
    if cells is None:
        cells = cells_for(df.count(), row_bytes)
    parted = with_cells(df, plan, epoch, cells)
    starts = cell_offsets(with_cells(df.select(*plan.key), plan, epoch, cells)).drop("cell_rows")
    together = parted.unionByName(starts.withColumn("_start", F.lit(True)), allowMissingColumns=True).repartition(cells, "cell")
    # a start has no hash and so comes first in its part's share of the cell
    share = Window.partitionBy("cell", "part_id").orderBy(F.asc_nulls_first("row_hash"), *plan.key)
    so_far = share.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = together.withColumns({"_at": F.row_number().over(share), **{c: F.first(c).over(so_far) for c in ("cell_start", "part_rows")}})
    place = F.col("_at") - 2 + F.col("cell_start")
    ranked = ranked.where("_start is null").withColumn("batch_id", F.floor(place / plan.batch_size).cast("int"))
    return with_group_columns(ranked, F.lit(plan.batch_size), plan.push_every).drop("_start", "_at", "cell_start")


def with_group_columns(df: DataFrame, size: Column, push_every: int) -> DataFrame:
    """From ``batch_id`` and ``part_rows``: the group, and the true sizes of batch and group."""
    group = F.floor(F.col("batch_id") / push_every)
    batches = F.ceil(F.col("part_rows") / size)
    return df.withColumns(
        {
            "group_id": group.cast("int"),
            "batch_rows": F.least(size, F.col("part_rows") - F.col("batch_id") * size).cast("int"),
            "group_batches": F.least(F.lit(push_every), batches - group * push_every).cast("int"),
        }
    )


def push_groups(batched: DataFrame, push_every: int) -> DataFrame:
    """One row per push: which batches it covers, and whether it is complete."""
    groups = batched.groupBy("part_id", "group_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("batch_id").alias("first_batch"),
        F.max("batch_id").alias("last_batch"),
        F.max("group_batches").alias("n_batches"),
    )
    return groups.withColumn("complete", F.col("n_batches") == push_every)


def warmup_slices(df: DataFrame, key: list[str], n: int, batch_size: int, usable: Column | None = None, count_skipped: bool = False) -> DataFrame:
    """The first ``n`` rows by key with ``slice_id``: consecutive windows of ``batch_size`` rows.

    ``usable`` marks rows that may be trained on.  With ``count_skipped`` the others still take a
    slot in their slice before they are dropped, so slices can run short; otherwise slices are cut
    from usable rows only.
    """
    if batch_size < 1:
        raise ValueError("warm-up slices need a batch size of at least 1")
    ranked = first_keys(df, key, n)
    if usable is not None and not count_skipped:
        sample = join_small(df.select(*key, usable.alias("_ok")), ranked.drop("_rank"), key, rows=n, how="left_semi")
        ranked = first_keys(sample.filter("_ok"), key, n)
    chosen = df if usable is None else df.filter(usable)
    sliced = ranked.withColumn("slice_id", F.floor((F.col("_rank") - 1) / batch_size).cast("int")).drop("_rank")
    return join_small(chosen, sliced, key, rows=n)
