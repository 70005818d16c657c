"""Text lines with a line number that does not depend on how the files are split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import join_small, materialize

LINE_KEY = ["file_path", "line_no"]


def read_lines(spark: SparkSession, path: str, copy: str | None = None) -> DataFrame:
    """``(value, file_path, line_no)`` for every line, blank ones included.

    The reader of plain text is used on purpose: the one for CSV drops blank lines unseen.  The text is read once and
    copied, each line with its file block and its place in it, to ``copy`` or a scratch table.  A line's number is the number of lines in
    earlier blocks of its file plus its place in its own; the lines of a block are counted from the narrow columns of the copy.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_m"),
    )
    lines = materialize(lines, "lines", path=copy)
    blocks = lines.groupBy("file_path", "_block").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file_path", "_block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    # One row per file block; kept as a table so that its true size decides how it is joined.
    starts = materialize(starts, "line-starts")
    rows, longest = starts.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("file_path")), F.lit(0))).first()
    joined = join_small(lines, starts, ["file_path", "_block"], rows=rows, row_bytes=64 + longest)
    return joined.select("value", "file_path", (F.col("_m") + F.col("_shift")).alias("line_no"))


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of files as they arrive."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)
