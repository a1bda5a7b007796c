"""Keyed reductions and grouping, with their dense *to-index* forms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import Key, OrderedFrame, ordered
from ..store import stored

REDUCERS = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "any": F.bool_or, "all": F.bool_and, "product": F.product}


def reducers(aggs: Mapping[str, tuple[str, str | Column] | Column]) -> list[Column]:
    return [(REDUCERS[a[0]](a[1]) if isinstance(a, tuple) else a).alias(name) for name, a in aggs.items()]


def reduce_by_key(df: DataFrame, by: list[str | Column], aggs: Mapping[str, tuple[str, str | Column] | Column]) -> DataFrame:
    """One row per key. Reducers are associative and commutative, so each task combines before the shuffle."""
    return df.groupBy(*by).agg(*reducers(aggs))


def reduce_pair(df: DataFrame, key: str, value: str, how: str) -> DataFrame:
    """(key, value) pairs to one pair per key."""
    return reduce_by_key(df, [key], {value: (how, value)})


def dense(df: DataFrame, key: str, size: int, neutral: Mapping[str, object]) -> OrderedFrame:
    """Exactly ``size`` rows, key 0 to size - 1; columns of missing keys get their neutral value, occupied slots keep theirs.

    Raises when the plan runs if a key is outside the range.
    """
    spark = df.sparkSession
    inside = F.when((F.col(key) >= 0) & (F.col(key) < size), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("key out of range: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    marked = df.withColumn(key, inside.cast("bigint")).withColumn("_there", F.lit(True))
    slots = spark.range(size).withColumnRenamed("id", key)
    # a full join, so that the check above sees every row
    joined = slots.join(marked, key, "full")
    filled = {c: F.when(F.col("_there"), F.col(c)).otherwise(F.lit(v).cast(df.schema[c].dataType)) for c, v in neutral.items()}
    return OrderedFrame(joined.withColumns(filled).drop("_there"), (Key(key),), key)


def reduce_to_index(df: DataFrame, key: str, size: int, aggs: Mapping[str, tuple[str, str | Column] | Column], neutral: Mapping[str, object]) -> OrderedFrame:
    return dense(reduce_by_key(df, [key], aggs), key, size, neutral)


def group_items(frame: OrderedFrame, *values: str) -> Column:
    """Aggregate: the group's rows as an array of structs in the frame's order (ascending columns only)."""
    order = [k.name for k in frame.order]
    if any(k.descending for k in frame.order):
        raise ValueError("groups are ordered by ascending columns")
    return F.array_sort(F.collect_list(F.struct(*order, *(v for v in values if v not in order))))


def group_by_key(frame: OrderedFrame, by: list[str | Column], out: Mapping[str, Column], *values: str) -> DataFrame:
    """``out`` are expressions over the array column ``items`` of each group, which holds the whole group in order.

    For groups of bounded size; use ``reduce_by_key`` where a reduction says the same.
    """
    grouped = frame.df.groupBy(*by).agg(group_items(frame, *values).alias("items"))
    return grouped.withColumns(dict(out)).drop("items")


def group_to_index(frame: OrderedFrame, key: str, size: int, out: Mapping[str, Column], neutral: Mapping[str, object], *values: str) -> OrderedFrame:
    return dense(group_by_key(frame, [key], out, *values), key, size, neutral)


def group_median(df: DataFrame, by: str, value: str, name: str = "median") -> DataFrame:
    """(by, name): of each group's sorted values the one at max(n div 2 - 1, 0), without collecting a group.

    All rows get their position by group and value; a group is a span of positions, so its median is one row of the
    frame. Groups of any size are spread over tasks, as positions are counted in two levels. Nulls are left out.
    """
    rows = ordered(df.where(F.col(value).isNotNull()).select(by, value), by, value).with_index("_at").df
    rows = stored(rows, "positions")
    spans = rows.groupBy(by).agg((F.min("_at") + F.greatest(F.floor(F.count("*") / 2), F.lit(1)) - 1).cast("bigint").alias("_at"))
    return rows.join(spans.select("_at"), "_at", "left_semi").select(by, F.col(value).alias(name))
