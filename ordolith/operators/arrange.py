"""Sorting, merging, concatenation and rebalancing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Key, OrderedFrame, keys
from .local import union_all


def sort(df: DataFrame, *order: str | Key, ties: tuple[str, ...] = ()) -> OrderedFrame:
    """A new total order; ``ties`` makes it total where the keys are not."""
    return OrderedFrame(df, keys((*order, *ties)))


def sort_stable(frame: OrderedFrame, *order: str | Key) -> OrderedFrame:
    """Rows with equal keys keep their previous order."""
    new = keys(order)
    names = {k.name for k in new}
    return OrderedFrame(frame.df, (*new, *(k for k in frame.order if k.name not in names)))


def merge(first: OrderedFrame, *others: OrderedFrame, source: str = "source") -> OrderedFrame:
    """Ordered frames with one order become one; ties go by source, then by the source's rows."""
    if any(o.order != first.order for o in others):
        raise ValueError("a merge needs frames with the same order")
    tagged = [f.df.withColumn(source, F.lit(i)) for i, f in enumerate((first, *others))]
    return OrderedFrame(union_all(*tagged), (*first.order, Key(source)))


def concat(first: OrderedFrame, *others: OrderedFrame, source: str = "source") -> OrderedFrame:
    """All rows of the first frame, then all of the next, each in its order."""
    if any(o.order != first.order for o in others):
        raise ValueError("a concatenation needs frames with the same order columns")
    tagged = [f.df.withColumn(source, F.lit(i)) for i, f in enumerate((first, *others))]
    return OrderedFrame(union_all(*tagged), (Key(source), *first.order))


def rebalance(frame: OrderedFrame, partitions: int | None = None) -> OrderedFrame:
    """Partitions of about equal size, in order; the rows are the same."""
    args = [*([partitions] if partitions else []), *frame.columns()]
    return OrderedFrame(frame.df.repartitionByRange(*args).sortWithinPartitions(*frame.columns()), frame.order, frame.index)


def top_k(frame: OrderedFrame, k: int) -> OrderedFrame:
    """The first k rows: each task keeps k."""
    return OrderedFrame(frame.df.orderBy(*frame.columns()).limit(k), frame.order)
