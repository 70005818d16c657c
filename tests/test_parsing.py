import math

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rowgrad.functions import parsing
from rowgrad.functions.parsing import DROPMALFORMED, Layout
from rowgrad.sources import text

CLASSES = Layout("class_first", 3, 10, min_len=2)


def lines(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, value string")


def test_class_first_keeps_other_columns(spark):
    rows = parsing.parse_lines(lines(spark, "5,0,127,255", "0, 1.5 ,2,-3e1"), CLASSES).orderBy("id").collect()
    assert [(r.id, r.label, r.features) for r in rows] == [(0, 5, [0.0, 127.0, 255.0]), (1, 0, [1.5, 2.0, -30.0])]


def test_blank_short_and_label_range_are_skipped_in_both_modes(spark):
    df = lines(spark, "", "7", "10,1,2,3", "-1,1,2,3", "9,1,2,3")
    for mode in ("FAILFAST", DROPMALFORMED):
        assert [r.id for r in parsing.parse_lines(df, CLASSES, mode).collect()] == [4]


@pytest.mark.parametrize("bad", ["x,1,2,3", "5.0,1,2,3", "5,1,x,3", "5,1,2", "5,1,2,3,4", "5,1,2,3f", "5,1,,3", "5,1,2,"])
def test_malformed_lines(spark, bad):
    df = lines(spark, bad, "1,1,2,3")
    assert [r.id for r in parsing.parse_lines(df, CLASSES, DROPMALFORMED).collect()] == [1]
    with pytest.raises(Exception, match="malformed line"):
        parsing.parse_lines(df, CLASSES).collect()


def test_min_len_tells_blank_from_short(spark):
    df = lines(spark, "", "7", None)
    reasons = {r.id: r.reason for r in parsing.classify_lines(df, CLASSES).collect()}
    assert reasons == {0: "blank", 1: "short", 2: "blank"}


def test_target_last(spark):
    row = parsing.parse_lines(lines(spark, "1,2,0.5"), Layout("target_last", 2, 1)).first()
    assert row.features == [1.0, 2.0] and row.target == [0.5]


def test_multi_target_ignores_further_columns(spark):
    df = lines(spark, "1,2,3,4", "1,2,3,4,junk", "1,2,3")
    rows = parsing.parse_lines(df, Layout("multi_target", 2, 2), DROPMALFORMED).orderBy("id").collect()
    assert [(r.id, r.features, r.target) for r in rows] == [(0, [1.0, 2.0], [3.0, 4.0]), (1, [1.0, 2.0], [3.0, 4.0])]


def test_special_numbers_are_numbers(spark):
    row = parsing.parse_lines(lines(spark, "1,inf,NaN,-Infinity"), CLASSES).first()
    assert row.features[0] == math.inf and math.isnan(row.features[1]) and row.features[2] == -math.inf


def test_observation_counts_skips_in_the_same_pass(spark):
    seen = Observation("skips")
    df = lines(spark, "", "7", "12,1,2,3", "x,1,2,3", "1,1,2,3")
    assert parsing.parse_lines(df, CLASSES, DROPMALFORMED, observation=seen).count() == 1
    assert seen.get == {"lines": 5, "blank": 1, "short": 1, "malformed": 1, "label_range": 1}


def test_one_hot(spark):
    row = spark.createDataFrame([(2,)], "label int").select(parsing.one_hot(F.col("label"), 4).alias("h")).first()
    assert row.h == [0, 0, 1, 0]


def test_line_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    for name, n in (("a.txt", 2000), ("b.txt", 37)):
        (tmp_path / name).write_text("".join("\n" if i % 7 == 0 else f"{name}-{i}\n" for i in range(n)))
    seen = []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1k", "5k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        lines = text.read_lines(spark, str(tmp_path))
        # the text itself isn't read again for its numbers
        assert "FileScan text" not in lines._jdf.queryExecution().executedPlan().toString()
        rows = lines.collect()
        seen.append({(r.file_path, r.line_no): r.value for r in rows})
        assert len(rows) == len(seen[-1]) == 2037
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert seen[0] == seen[1] == seen[2]
    for (path, line_no), value in seen[0].items():
        assert value == ("" if line_no % 7 == 0 else f"{path.rsplit('/', 1)[1]}-{line_no}")
