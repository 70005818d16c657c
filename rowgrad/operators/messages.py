"""The log of gradient messages: age, rejection, counters and evaluation points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import row_positions


def age_micros(arrived: Column, time_sent: Column) -> Column:
    return F.unix_micros(arrived) - F.unix_micros(time_sent)


def with_acceptance(messages: DataFrame, max_age_s: float) -> DataFrame:
    """Add ``age_us`` and ``accepted``: younger than ``max_age_s`` on arrival.

    Rejected messages stay in, so that they can be counted.  Works on streams as well.
    """
    aged = messages.withColumn("age_us", age_micros(F.col("arrived"), F.col("time_sent")))
    return aged.withColumn("accepted", F.col("age_us") < F.lit(int(max_age_s * 1_000_000)))


def message_counts(messages: DataFrame) -> DataFrame:
    """One row ``(received, rejected)``; rejected messages count as received."""
    return messages.agg(F.count(F.lit(1)).alias("received"), F.count_if(~F.col("accepted")).alias("rejected"))


def evaluation_points(messages: DataFrame, every: int = 10) -> DataFrame:
    """Messages after which the model is evaluated: each ``every``-th received one, if accepted.

    Rejected messages take part in the count, so a point is lost when its message is rejected.
    """
    numbered = row_positions(messages, ["arrived", "id"], name="received")
    return numbered.filter((F.col("received") % every == 0) & F.col("accepted"))
