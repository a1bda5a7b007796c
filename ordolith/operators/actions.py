"""Reductions of a whole frame. Each is lazy: a frame of one row, computed when it is read."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import OrderedFrame
from .keyed import REDUCERS, group_items


def size(df: DataFrame, name: str = "size") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def all_reduce(df: DataFrame, value: str | Column, how: str, name: str, initial=None) -> DataFrame:
    """Fold of all rows; ``initial`` counts once, whatever the partitioning. Without rows: initial, else null."""
    folded = REDUCERS[how](value)
    if initial is not None:
        start = F.lit(initial)
        combine = {"sum": lambda a: start + F.coalesce(a, F.lit(0)), "min": lambda a: F.least(start, a), "max": lambda a: F.greatest(start, a), "product": lambda a: start * F.coalesce(a, F.lit(1))}
        folded = combine[how](folded)
    return df.agg(folded.alias(name))


def ordered_fold(frame: OrderedFrame, value: str, zero: Column, step, name: str) -> DataFrame:
    """A fold whose function is not commutative, in order; for frames of bounded size."""
    items = F.array_sort(F.collect_list(F.struct(*(k.name for k in frame.order), F.col(value).alias("_v"))))
    return frame.df.agg(F.aggregate(items, zero, lambda acc, x: step(acc, x["_v"])).alias(name))


def hyper_log_log(df: DataFrame, value: str | Column, precision: int = 12, name: str = "distinct") -> DataFrame:
    """The estimated number of distinct values, with 2 ** precision registers (4 to 18)."""
    if not 4 <= precision <= 18:
        raise ValueError("precision goes from 4 to 18")
    return df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(value, F.lit(precision))).alias(name))


def sample(df: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """k rows without replacement, or all; each task keeps k."""
    return df.orderBy(F.rand(seed)).limit(k)


def gather(frame: OrderedFrame) -> list:
    """All rows on the driver, in order; for small frames."""
    return frame.sorted().collect()


#: Rows that ``all_gather`` sends to every task at most.
GATHER_ROWS = 1_000_000


def all_gather(frame: OrderedFrame, *columns: str, name: str = "items", most: int = GATHER_ROWS) -> DataFrame:
    """One row for every task: the frame's rows in order, as an array of structs. Raises beyond ``most`` rows."""
    if frame.df.limit(most + 1).count() > most:
        raise ValueError(f"a frame of more than {most} rows is not for every task")
    return F.broadcast(frame.df.agg(group_items(frame, *columns).alias(name)))


def print_frame(frame: OrderedFrame, name: str, out: TextIO | None = None) -> None:
    """All rows in order between two lines with the name, numbered; the driver holds one partition at a time."""
    out = out or sys.stdout
    print(f"-- {name}: begin", file=out)
    for i, row in enumerate(frame.sorted().toLocalIterator()):
        print(f"[{i}]", *row, file=out)
    print(f"-- {name}: end", file=out)


def show(frame: OrderedFrame, n: int = 20) -> None:
    frame.sorted().show(n, truncate=False)
