from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowgrad.operators import batching, ranking
from rowgrad.operators.batching import BatchPlan
from rowgrad.sources import tables


def test_row_positions_follow_the_order_in_every_group(spark):
    df = spark.range(0, 5000, 1, 16).select(F.pmod(F.col("id") * 7919, F.lit(5000)).alias("k"), (F.col("id") % 3 == 0).cast("int").alias("g"))
    df = df.withColumn("g", F.when(F.col("k") < 3000, 0).otherwise(F.col("g")))  # one group holds most rows
    rows = ranking.row_positions(df, ["k"], ["g"]).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.g].append((r.pos, r.k))
    assert sum(map(len, groups.values())) == 5000
    for got in groups.values():
        got.sort()
        assert [p for p, _ in got] == list(range(1, len(got) + 1))
        assert [k for _, k in got] == sorted(k for _, k in got)


def test_first_rows_and_the_rest_split_the_table(spark):
    df = spark.range(100).select(((F.col("id") * 37) % 100).alias("k"), F.lit("x").alias("v"))
    first = {r.k for r in ranking.first_rows(df, ["k"], 30).collect()}
    rest = {r.k for r in ranking.without_first_rows(df, ["k"], 30).collect()}
    assert first == set(range(30)) and rest == set(range(30, 100))


def test_first_keys_of_any_number(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_DRAWN", 100)
    df = spark.range(0, 3000, 1, 7).select(F.concat(F.lit("f"), F.col("id") % 3).alias("f"), F.pmod(F.col("id") * 2011, F.lit(3000)).alias("k"), F.lit(1).alias("v"))
    order = sorted((r.f, r.k) for r in df.collect())
    for n in (0, 1, 500, 2500, 2999, 3000, 4000):
        got = ranking.first_keys(df, ["f", "k"], n)
        assert sorted((r._rank, r.f, r.k) for r in got.collect()) == [(i, *key) for i, key in enumerate(order[:n], 1)]
        plan = got._jdf.queryExecution().executedPlan().toString()
        # one task sees the counts of the ranges, none the keys
        assert "Limit" not in plan and "TakeOrdered" not in plan and plan.split("Exchange SinglePartition")[1].split("+-")[1].strip().startswith("*")
        assert "HashAggregate(keys=[_range" in plan.split("Exchange SinglePartition")[1].split("+-")[1]


def expected(rows, plan):
    """Batches by sorting every part in plain Python."""
    parts = defaultdict(list)
    for r in rows:
        parts[r.part_id].append((r.row_hash, r.k))
    out = {}
    for part, members in parts.items():
        members.sort()
        size = plan.batch_size or len(members)
        batches = -(-len(members) // size)
        for place, (_, k) in enumerate(members):
            b = place // size
            g = b // plan.push_every
            out[k] = (part, b, min(size, len(members) - b * size), g, min(plan.push_every, batches - g * plan.push_every))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 400), parts=st.integers(1, 6), size=st.integers(0, 40), push=st.integers(1, 4), cells=st.integers(1, 5), tasks=st.integers(1, 9))
def test_each_row_is_in_one_batch_whatever_the_layout(spark, n, parts, size, push, cells, tasks):
    plan = BatchPlan(("k",), parts, size, push, seed=3)
    df = spark.range(0, n, 1, tasks).withColumnRenamed("id", "k")
    rows = batching.assign_batches(df, plan, epoch=1, cells=cells).collect()
    assert len(rows) == n
    got = {r.k: (r.part_id, r.batch_id, r.batch_rows, r.group_id, r.group_batches) for r in rows}
    assert got == expected(rows, plan)


def test_epochs_and_seeds_draw_anew(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    plan = BatchPlan(("k",), 8, 10)

    def parts(p, e):
        return {r.k: r.part_id for r in batching.with_parts(df, p, e).collect()}

    assert parts(plan, 0) == parts(plan, 0)
    assert parts(plan, 0) != parts(plan, 1)


def test_redistribute_keeps_parts_apart_and_splits_them(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    for slices in (1, 3):
        moved = batching.redistribute(df, BatchPlan(("k",), 6, 10), slices=slices)
        rows = moved.select("k", "part_id", F.spark_partition_id().alias("task")).collect()
        assert len({r.k for r in rows}) == len(rows) == 1000 and all(r.part_id == r.task // slices for r in rows)
        assert len({r.task for r in rows}) == 6 * slices


def test_epoch_repartition_tells_the_task_of_every_row(spark, folder):
    import duckdb

    from rowgrad.plans import queries
    from rowgrad.plans.oracles import ORACLES

    events = spark.read.parquet(f"{folder}/events.parquet")
    got = sorted((r.epoch, r.event_id, r.part_id, r.task_id) for r in queries.epoch_repartition(spark, folder).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
        asked = db.execute(f"SELECT epoch, event_id, part_id, task_id FROM ({ORACLES['epoch_repartition']})").fetchall()
    assert got == sorted(asked) and len(got) == 2 * events.count()
    # the tasks that the rows are in are those that the result names, also where every partition has many
    for slices in (2, 5):
        moved = batching.redistribute(events.select("event_id"), queries.REPARTITION_PLAN, 1, slices)
        assert moved.where(F.spark_partition_id() != F.col("task_id")).count() == 0 and moved.count() == events.count()
        assert {r.n for r in moved.groupBy("part_id").agg(F.countDistinct("task_id").alias("n")).collect()} == {slices}


def test_a_task_of_an_epoch_gets_no_more_rows_in_a_larger_table(spark, folder, monkeypatch):
    from rowgrad.plans import queries

    n = spark.read.parquet(f"{folder}/events.parquet").count()
    monkeypatch.setattr(queries, "MOVED_ROWS", n // (8 * 32))
    rows = queries.epoch_repartition(spark, folder).groupBy("epoch", "task_id").count().collect()
    assert len(rows) > 2 * 7 * 32 and max(r["count"] for r in rows) < 6 * n // (8 * 32) + 10


def test_rows_move_once(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.array(F.lit(1.0)).alias("features"))
    batched = batching.assign_batches(df, BatchPlan(("k",), 6, 10), cells=4)
    plan = batched._jdf.queryExecution().executedPlan().toString()
    # one exchange has the wide rows in it; behind it the window works on what is there
    assert plan.count("Exchange hashpartitioning(cell") == 1


def test_running_sums_by_spans(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_SPAN", 3)
    rows = [(g, i, (i * 7 + g) % 5 + 1) for g in range(3) for i in range(20 + g) if i % (g + 1) == 0]
    df = spark.createDataFrame(rows, "g int, i int, n long")
    for r in ranking.running_before(df, "g", "i", "n", "before", "whole").collect():
        assert r.before == sum(n for g, i, n in rows if g == r.g and i < r.i) and r.whole == sum(n for g, i, n in rows if g == r.g)


def test_push_groups_mark_short_ones(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    got = batching.push_groups(batching.assign_batches(df, BatchPlan(("k",), 1, 4, 2)), 2).orderBy("group_id").collect()
    assert [(g.n_rows, g.n_batches, g.complete) for g in got] == [(8, 2, True), (8, 2, True), (7, 2, True)]
    got = batching.push_groups(batching.assign_batches(df, BatchPlan(("k",), 1, 8, 2)), 2).orderBy("group_id").collect()
    assert [(g.n_rows, g.n_batches, g.complete) for g in got] == [(16, 2, True), (7, 1, False)]


def test_skipped_lines_can_take_slots(spark):
    df = spark.range(40).withColumnRenamed("id", "k")
    usable = F.col("k") % 4 != 0
    packed = batching.warmup_slices(df, ["k"], 20, 5, usable).collect()
    slotted = batching.warmup_slices(df, ["k"], 20, 5, usable, count_skipped=True).collect()
    good = [k for k in range(20) if k % 4]
    assert {r.k: r.slice_id for r in packed} == {k: i // 5 for i, k in enumerate(good)}
    assert {r.k: r.slice_id for r in slotted} == {k: k // 5 for k in good}


def test_tables_without_a_key_get_their_position(spark, folder):
    item = tables.with_position_key(tables.read_table(spark, folder, "lineitem"))
    key = ("file_path", "row_index")
    assert item.select(*key).distinct().count() == item.count()
    sizes = batching.assign_batches(item.select(*key), BatchPlan(key, 4, 100), cells=3).groupBy("part_id", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.max("batch_rows").alias("said"))
    rows = sizes.collect()
    assert all(r.n == r.said <= 100 for r in rows) and sum(r.n for r in rows) == item.count()
