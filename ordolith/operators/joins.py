"""Equi joins; Catalyst picks the strategy from checked sizes, adaptive execution splits skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def on(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> Column:
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("a join needs as many keys on the left as on the right")
    cond = F.lit(True)
    for a, b in zip(left_keys, right_keys):
        cond = cond & (left[a] == right[b])
    return cond


def inner_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], *select: Column | str) -> DataFrame:
    """All pairs of rows with equal keys; null keys meet nothing."""
    out = left.join(right, on(left, right, left_keys, right_keys))
    return out.select(*select) if select else out


def semi_reduced_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], *select: Column | str) -> DataFrame:
    """An inner join whose left rows without a partner are dropped first, by the right side's distinct keys."""
    wanted = right.select(*right_keys).distinct()
    return inner_join(left.join(wanted, on(left, wanted, left_keys, right_keys), "left_semi"), right, left_keys, right_keys, *select)


def outer_join(left, right, left_keys, right_keys, how: str = "left") -> DataFrame:
    return left.join(right, on(left, right, left_keys, right_keys), how)


def as_of_join(left: DataFrame, right: DataFrame, time: str, by: list[str], value: str, ties: str) -> DataFrame:
    """For each left row the value of the latest right row of its key at its time or before: one union, one window."""
    a = left.select(*by, time, ties, F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("_left"))
    b = right.select(*by, time, F.lit(None).cast(left.schema[ties].dataType).alias(ties), value, F.lit(0).alias("_left"))
    w = Window.partitionBy(*by).orderBy(time, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_left = 1").drop("_left")
