"""Row positions over whole tables without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import as_columns, join_small, materialize

_LOW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number of a partition here


def row_positions(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "pos") -> DataFrame:
    """Number rows 1, 2, … by ``order`` (a total order) inside each ``group``.

    The rows are range-partitioned by group and order, so one huge group spreads over many tasks.
    The sorted rows are written once with their place in their partition; adding the number of
    rows that the same group has in earlier partitions gives the position.
    """
    group = group or []
    keys = as_columns([*group, *order])
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(ranged.withColumn("_m", F.monotonically_increasing_id()), "positions")
    placed = placed.withColumns({"_range": F.shiftright("_m", 33), "_at": F.col("_m").bitwiseAND(F.lit(_LOW_BITS))})
    # One row per group and partition it touches: at most partitions + groups rows.
    spans = placed.groupBy("_range", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_range", *group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    if group:
        # kept as a table, so that its true size decides how it is joined
        spans = materialize(spans, "spans")
        rows = spans.count()
    else:
        rows = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = join_small(placed, spans, ["_range", *group], rows=rows, row_bytes=256)
    return joined.withColumn(name, F.col("_at") + F.col("_shift") + 1).drop("_m", "_range", "_at", "_shift")


_SPAN = 1 << 12  # places of a group that one task of a running sum sees


def running_before(df: DataFrame, group: str, order: str, amount: str, before: str, whole: str) -> DataFrame:
    """Add, for each row, the sum of ``amount`` over the group's rows with smaller ``order``, and over all its rows.

    ``order`` is an int from 0, unique in its group.  Sums are made inside spans of it first and then over the spans, so that a long
    group is no single task's.
    """
    spanned = df.withColumn("_span", F.floor(F.col(order) / _SPAN))
    spans = spanned.groupBy(group, "_span").agg(F.sum(amount).alias("_sum"))
    of_group = Window.partitionBy(group)
    earlier = of_group.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(group, "_span", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), F.sum("_sum").over(of_group).alias(whole))
    inside = Window.partitionBy(group, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = spanned.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(spans, [group, "_span"])
    return placed.withColumn(before, F.col("_before") + F.col("_inside")).drop("_span", "_before", "_inside")


_DRAWN = 4096  # keys that the driver looks at to choose a splitter


def first_keys(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """The ``n`` smallest keys with their rank (1-based), for any ``n``.  Only key columns are read.

    A splitter is drawn from a sample, and the keys up to it are counted exactly; if they are too few, a later one is
    taken.  Only the keys up to the splitter are then sorted and numbered, over many tasks.
    """
    keys = df.select(*key)
    total = keys.count()
    if n < total:
        drawn = keys.sample(min(1.0, _DRAWN / total), seed=1).orderBy(*as_columns(key)).limit(4 * _DRAWN).collect()
        at = min(len(drawn), -(-len(drawn) * n // total) + 64)
        while at < len(drawn):
            limit = F.struct(*[F.lit(drawn[at][k]).cast(keys.schema[k].dataType).alias(k) for k in key])
            below = keys.where(F.struct(*key) <= limit)
            if below.count() >= n:
                keys = below
                break
            at += max(64, at // 2)
    return row_positions(keys, key, name="_rank").where(F.col("_rank") <= n)


def first_rows(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by a unique key; wide rows stay where they are."""
    return join_small(df, first_keys(df, key, n).drop("_rank"), key, rows=n, how="left_semi")


def without_first_rows(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """All rows but the first ``n`` by a unique key."""
    return join_small(df, first_keys(df, key, n).drop("_rank"), key, rows=n, how="left_anti")
