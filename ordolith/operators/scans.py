"""Prefix sums over an ordered frame, by one window or in two levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..frame import BUCKET_ROWS, ONE_TASK_BYTES, OrderedFrame, estimated_bytes

#: How a scan combines: the aggregate over rows, and the combination of two values. Nulls count as missing. Strings are
#: collected and then joined.
SCANS: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
    "concat": (F.collect_list, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))),
}


def prefix_sum(frame: OrderedFrame, value: str | Column, name: str, how: str = "sum", initial=None, exclusive: bool = False, one_task_bytes: int | None = None, bucket_rows: int = BUCKET_ROWS) -> OrderedFrame:
    """Adds initial + x_0 + ... + x_i (exclusive: up to x_(i-1)); partitioning never changes the result.

    Beyond ``one_task_bytes`` rows are indexed, scanned in buckets of positions, and each bucket adds the scan of the
    totals before it (one row a bucket).
    """
    aggregate, combine = SCANS[how]
    value = F.col(value) if isinstance(value, str) else value
    bound = -1 if exclusive else 0
    start = F.lit(initial)

    def over(c: str | Column, w) -> Column:
        found = aggregate(c).over(w)
        return F.array_join(found, "") if how == "concat" else found

    def seeded(c: Column) -> Column:
        return c if initial is None else combine(start, c)

    if estimated_bytes(frame.df) <= (ONE_TASK_BYTES if one_task_bytes is None else one_task_bytes):
        w = Window.orderBy(*frame.columns()).rowsBetween(Window.unboundedPreceding, bound)
        return OrderedFrame(frame.df.withColumn(name, seeded(over(value, w))), frame.order, frame.index)
    indexed = frame.with_index("_idx", one_task_bytes)
    rows = indexed.df.withColumn("_v", value).withColumn("_bucket", F.floor(F.col("_idx") / bucket_rows))
    if how in ("last", "concat"):  # needs the rows in order: the bucket's last local value
        local = Window.partitionBy("_bucket").orderBy("_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        totals = rows.withColumn("_t", over("_v", local)).groupBy("_bucket").agg(F.first("_t").alias("_t"))
    else:
        totals = rows.groupBy("_bucket").agg(aggregate("_v").alias("_t"))
    before = totals.select("_bucket", over("_t", Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inner = Window.partitionBy("_bucket").orderBy("_idx").rowsBetween(Window.unboundedPreceding, bound)
    out = rows.join(before, "_bucket").withColumn("_own", over("_v", inner))
    out = out.withColumn(name, seeded(combine(F.col("_before"), F.col("_own"))))
    kept = [c for c in frame.df.columns if c != name]
    return OrderedFrame(out.select(*kept, name), frame.order, frame.index)


def ex_prefix_sum(frame: OrderedFrame, value: str | Column, name: str, how: str = "sum", initial=0, **more) -> OrderedFrame:
    """The exclusive scan; its first value is ``initial``."""
    return prefix_sum(frame, value, name, how, initial, exclusive=True, **more)
