"""Predictions, losses and error metrics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """Index of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax_xent(scores: Column, label: Column) -> Column:
    """Cross-entropy of one row, with the largest score taken out before the exponentials."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
    return F.log(total) + top - F.get(scores, label)


def squared_error_sum(scores: Column, target: Column) -> Column:
    """Sum over the outputs of one row."""
    squares = F.zip_with(scores, target, lambda s, t: (s - t) * (s - t))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def mse(scores: Column, target: Column) -> Column:
    """Aggregate: mean squared error over rows and outputs."""
    return F.sum(squared_error_sum(scores, target)) / F.sum(F.size(target))


def accuracy(predicted: Column, label: Column) -> Column:
    """Aggregate: share of rows whose prediction is right."""
    return F.avg((predicted == label).cast("double"))


def error_rate(predicted: Column, label: Column) -> Column:
    """Aggregate: share of rows whose prediction is wrong."""
    return 1 - accuracy(predicted, label)
