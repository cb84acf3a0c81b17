"""Aggregate expressions, each named for what it does with nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_over_all_weights(value: Column, weight: Column) -> Column:
    """sum(v w) / sum(w), where rows with a null value still count in the denominator; 0 if all values are null."""
    return F.coalesce(F.sum(value * weight), F.lit(0.0)) / F.sum(weight)


def mean_over_present_weights(value: Column, weight: Column) -> Column:
    """sum(v w) / sum(w) over the rows with a value."""
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def mae(error: Column) -> Column:
    return F.avg(F.abs(error))


def rmse(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


def log_ratio(truth: Column, predicted: Column) -> Column:
    """ln(predicted / truth), null unless both are finite and above zero."""
    ok = (truth > 0) & (predicted > 0) & (truth < float("inf")) & (predicted < float("inf"))
    return F.when(ok, F.log(predicted) - F.log(truth))


def symmetric_range(value: Column, centre: float) -> Column:
    """The largest distance from the centre; 1 if there is none."""
    far = F.max(F.abs(F.nanvl(value, F.lit(None)) - centre))
    return F.when(far > 0, far).otherwise(1.0)
