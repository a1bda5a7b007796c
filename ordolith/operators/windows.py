"""Count windows: overlapping ones of k rows, and disjoint blocks."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..frame import BUCKET_ROWS, ONE_TASK_BYTES, Key, OrderedFrame, estimated_bytes


def window(frame: OrderedFrame, k: int, value: str | Column, name: str = "items", partial: bool = False, one_task_bytes: int | None = None, bucket_rows: int = BUCKET_ROWS) -> OrderedFrame:
    """For each position the array of the next k values: max(0, n - k + 1) rows, or with ``partial`` also the shorter tails.

    Large inputs go in buckets of positions; the k - 1 rows after a bucket's end are copied into it.
    """
    if k < 1:
        raise ValueError("a window has at least one row")
    value = F.col(value) if isinstance(value, str) else value
    f = frame.with_index("idx", one_task_bytes)
    rows = f.df.withColumn("_v", F.struct(value.alias("v")))
    if estimated_bytes(frame.df) <= (ONE_TASK_BYTES if one_task_bytes is None else one_task_bytes):
        spec = Window.orderBy("idx").rowsBetween(0, k - 1)
        out = rows.withColumn(name, F.collect_list("_v").over(spec))
    else:
        size = max(bucket_rows, k)
        own = F.floor(F.col("idx") / size)
        halo = (F.col("idx") % size < k - 1) & (F.col("idx") >= size)
        copies = rows.withColumn("_bucket", F.explode(F.when(halo, F.array(own, own - 1)).otherwise(F.array(own))))
        spec = Window.partitionBy("_bucket").orderBy("idx").rowsBetween(0, k - 1)
        out = copies.withColumn(name, F.collect_list("_v").over(spec)).where(F.col("_bucket") == own).drop("_bucket")
    out = out.withColumn(name, F.transform(name, lambda x: x["v"])).drop("_v")
    return OrderedFrame(out if partial else out.where(F.size(name) == k), (Key("idx"),), "idx" if partial else None)


def flat_window(frame: OrderedFrame, k: int, value: str | Column, emit, name: str = "item", partial: bool = False, **more) -> OrderedFrame:
    """``emit(items)``: an array of what each window gives, from none to many rows."""
    w = window(frame, k, value, "_items", partial, **more)
    out = w.df.select("idx", F.posexplode(emit(F.col("_items"))).alias("emitted", name)).withColumn("emitted", F.col("emitted").cast("bigint"))
    return OrderedFrame(out, (Key("idx"), Key("emitted")))


def disjoint_window(frame: OrderedFrame, k: int, value: str | Column, name: str = "items", **more) -> OrderedFrame:
    """Blocks of k rows, the last one shorter: one row a block, idx is its first position."""
    if k < 1:
        raise ValueError("a block has at least one row")
    value = F.col(value) if isinstance(value, str) else value
    f = frame.with_index("idx", **more)
    block = F.floor(F.col("idx") / k)
    out = f.df.groupBy(block.alias("_block")).agg(F.array_sort(F.collect_list(F.struct("idx", value.alias("v")))).alias("_items"))
    return OrderedFrame(out.select((F.col("_block") * k).alias("idx"), F.transform("_items", lambda x: x["v"]).alias(name)), (Key("idx"),))


def reduced_blocks(frame: OrderedFrame, k: int, aggs: dict[str, Column], **more) -> OrderedFrame:
    """Blocks whose function is a reduction: combined before the shuffle, no arrays."""
    f = frame.with_index("idx", **more)
    out = f.df.groupBy((F.floor(F.col("idx") / k) * k).alias("idx")).agg(*(c.alias(n) for n, c in aggs.items()))
    return OrderedFrame(out, (Key("idx"),))


def flat_disjoint_window(frame: OrderedFrame, k: int, value: str | Column, emit, name: str = "item", **more) -> OrderedFrame:
    w = disjoint_window(frame, k, value, "_items", **more)
    out = w.df.select("idx", F.posexplode(emit(F.col("_items"))).alias("emitted", name)).withColumn("emitted", F.col("emitted").cast("bigint"))
    return OrderedFrame(out, (Key("idx"), Key("emitted")))
