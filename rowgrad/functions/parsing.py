"""Labelled text lines to typed rows, as Column expressions only.

Three layouts are known: label first, one target last, several targets last.  A parser keeps
every other column of its input, so a line key travels with the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASS_FIRST = "class_first"
TARGET_LAST = "target_last"
MULTI_TARGET = "multi_target"

FAILFAST = "FAILFAST"
DROPMALFORMED = "DROPMALFORMED"


@dataclass(frozen=True)
class Layout:
    """Where label and features sit in a line.

    ``n_out`` is the number of classes for ``class_first`` and the number of targets otherwise.
    ``min_len`` is the shortest line that is looked at: 1 drops blank lines, 2 also single characters.
    """

    kind: str
    n_features: int
    n_out: int
    min_len: int = 1

    def __post_init__(self):
        if self.kind not in (CLASS_FIRST, TARGET_LAST, MULTI_TARGET):
            raise ValueError(f"unknown layout {self.kind!r}")
        if self.kind == TARGET_LAST and self.n_out != 1:
            raise ValueError("the target_last layout has one target")

    @property
    def answer(self) -> str:
        return "label" if self.kind == CLASS_FIRST else "target"


def fields_of(value: Column) -> Column:
    """Split at commas, trailing empty fields kept."""
    return F.split(value, ",", -1)


def features_to_float(fields: Column) -> Column:
    """String fields to doubles; a field that is no number becomes NULL."""
    return fields.try_cast(T.ArrayType(T.DoubleType()))


def one_hot(label: Column, n_classes: int) -> Column:
    """0/1 array with a single 1 at ``label``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: (i == label).cast("int"))


def _type_suffix(value: Column) -> Column:
    # A cast reads '5f' and '5d' as numbers; they are none in a data file.  The plain search for
    # the letters spares most lines the pattern.
    letters = [F.contains(value, F.lit(c)) for c in "fFdD"]
    return (letters[0] | letters[1] | letters[2] | letters[3]) & value.rlike(r"[0-9.]\s*[fFdD]\s*(,|$)")


def _has_null(values: Column) -> Column:
    # A search that finds nothing answers NULL if the array holds one; that is much faster than
    # looking at the elements through a lambda.
    found = F.array_contains(values, F.lit(-1.0))
    return F.when(found, F.exists(values, F.isnull)).otherwise(found.isNull())


def _once(column: Column) -> Column:
    """Keep a column from being worked out again for each use: plans are not merged across a generator."""
    return F.explode(F.array(column))


def _typed(fields: Column, layout: Layout) -> dict[str, Column]:
    """Label or target, features, and ``_fits``: has the line the right width?"""
    nf, n_fields = layout.n_features, F.size(fields)
    if layout.kind == CLASS_FIRST:
        answer, features = F.get(fields, F.lit(0)).try_cast("int"), F.slice(fields, 2, nf)
        fits = n_fields == nf + 1
    else:
        # Columns after the last target are ignored where there are several targets.
        answer, features = features_to_float(F.slice(fields, nf + 1, layout.n_out)), F.slice(fields, 1, nf)
        fits = n_fields >= nf + layout.n_out if layout.kind == MULTI_TARGET else n_fields == nf + 1
    return {layout.answer: answer, "features": features_to_float(features), "_fits": fits}


def _reason(value: Column, layout: Layout) -> Column:
    answer, length = F.col(layout.answer), F.length(value)
    missing = answer.isNull() if layout.answer == "label" else _has_null(answer)
    reason = (
        F.when(length.isNull() | (length == 0), "blank")
        .when(length < layout.min_len, "short")
        .when(~F.col("_fits") | missing | _has_null(F.col("features")) | _type_suffix(value), "malformed")
    )
    if layout.answer == "label":
        reason = reason.when(~answer.between(0, layout.n_out - 1), "label_range")
    return reason


def classify_lines(df: DataFrame, layout: Layout, value: str = "value") -> DataFrame:
    """Parse every line and say in ``reason`` why it cannot be used (NULL: it can).

    Reasons: ``blank``, ``short``, ``malformed``, ``label_range``.
    """
    split = df.select("*", _once(fields_of(F.coalesce(value, F.lit("")))).alias("_fields"))
    typed = split.withColumns(_typed(F.col("_fields"), layout)).drop("_fields")
    return typed.select("*", _once(_reason(F.col(value), layout)).alias("reason")).drop("_fits")


def parse_lines(
    df: DataFrame,
    layout: Layout,
    mode: str = FAILFAST,
    value: str = "value",
    observation=None,
) -> DataFrame:
    """Usable rows as ``(…, label|target, features)``.

    Blank, short and out-of-range lines are always skipped.  A malformed line fails the job
    (``FAILFAST``) or is skipped too (``DROPMALFORMED``).  An ``Observation`` collects the skip
    counts during the same pass.
    """
    if mode not in (FAILFAST, DROPMALFORMED):
        raise ValueError(f"unknown mode {mode!r}")
    rows = classify_lines(df, layout, value)
    if observation is not None:
        counts = [F.count_if(F.col("reason") == r).alias(r) for r in ("blank", "short", "malformed", "label_range")]
        rows = rows.observe(observation, F.count(F.lit(1)).alias("lines"), *counts)
    keep = F.col("reason").isNull()
    if mode == FAILFAST:
        error = F.raise_error(F.concat(F.lit("malformed line: "), F.col(value))).cast("boolean")
        keep = F.when(F.col("reason") == "malformed", error).otherwise(keep)
    return rows.filter(keep).drop(value, "reason")


def reject_counts(df: DataFrame, layout: Layout, value: str = "value") -> DataFrame:
    """Number of lines by outcome; usable lines count as ``kept``."""
    rows = classify_lines(df, layout, value)
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
