"""Activations and what is done to logits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow at either end."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def probability(logit: Column, temperature: float = 1.0) -> Column:
    return sigmoid(logit if temperature == 1.0 else logit / F.lit(float(temperature)))


def softmax(logit: Column, group: list[str], temperature: float = 1.0) -> Column:
    """Softmax over the rows that share the group's columns."""
    over = Window.partitionBy(*group)
    x = logit / F.lit(float(temperature))
    e = F.exp(x - F.max(x).over(over))
    return e / F.sum(e).over(over)


def activation(multi_label: bool, asked: str = "auto") -> str:
    """sigmoid or softmax; auto is sigmoid for tasks with several labels."""
    asked = asked.strip().lower()
    if asked not in ("auto", "sigmoid", "softmax"):
        raise ValueError(f"activation {asked!r}")
    return asked if asked != "auto" else "sigmoid" if multi_label else "softmax"


def compatibility(start: Column, end: Column) -> Column:
    """Scaled product of two projections (arrays of equal length)."""
    product = F.aggregate(F.zip_with(start, end, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return product / F.sqrt(F.size(start))


def centred_prefix(value: Column, group: list[str], order: list) -> Column:
    """Running sum, up to and with each row, of what a value is above its group's mean."""
    own = Window.partitionBy(*group)
    mean = F.avg(value).over(own)
    # The sum of (value - mean) over the first k rows is their sum less k times the mean.
    before = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value).over(before) - F.count(value).over(before) * mean
