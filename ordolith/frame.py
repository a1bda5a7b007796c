"""``OrderedFrame``: a DataFrame and the columns that put its rows in a total order.

Spark rows have no position. Here order is declared, carried through local operators and turned into a position
column only where an operator needs one. Operators whose output order is open (reductions, joins, bag unions) return
plain DataFrames; ``ordered`` gives those an order again.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

#: Plans whose estimated size is at most this many bytes are indexed or scanned by one task; larger ones in two levels.
#: The estimate is that of compressed files, and one task holds the rows of all sides of a zip, so it is kept small.
ONE_TASK_BYTES = 4 << 20
#: Rows in a bucket of the two-level plans.
BUCKET_ROWS = 1 << 18


@dataclass(frozen=True)
class Key:
    """One column of an order."""

    name: str
    descending: bool = False

    def column(self) -> Column:
        return F.col(self.name).desc_nulls_last() if self.descending else F.col(self.name).asc_nulls_first()


def keys(order: Sequence[str | Key]) -> tuple[Key, ...]:
    """'-x' means descending."""
    return tuple(k if isinstance(k, Key) else Key(k[1:], True) if k.startswith("-") else Key(k) for k in order)


@dataclass(frozen=True)
class OrderedFrame:
    df: DataFrame
    order: tuple[Key, ...]
    index: str | None = None  # a column that already is the 0-based position

    def __post_init__(self):
        if not self.order:
            raise ValueError("an ordered frame needs at least one order column")
        missing = [k.name for k in self.order if k.name not in self.df.columns]
        if missing:
            raise ValueError(f"order columns {missing} are not in the frame: {self.df.columns}")

    def columns(self) -> list[Column]:
        return [k.column() for k in self.order]

    def check_total(self) -> OrderedFrame:
        """Raise unless no two rows share their order key."""
        if self.df.groupBy(*(k.name for k in self.order)).count().where("count > 1").limit(1).count():
            raise ValueError("the order is not total: rows share an order key")
        return self

    def with_index(self, name: str = "idx", one_task_bytes: int | None = None) -> OrderedFrame:
        """Adds the 0-based position as a bigint column, which then is the order."""
        if self.index:
            df = self.df if self.index == name else self.df.withColumn(name, F.col(self.index))
            return OrderedFrame(df, (Key(name),), name)
        if estimated_bytes(self.df) <= (ONE_TASK_BYTES if one_task_bytes is None else one_task_bytes):
            w = Window.orderBy(*self.columns())
            return OrderedFrame(self.df.withColumn(name, F.row_number().over(w).cast("bigint") - 1), (Key(name),), name)
        return OrderedFrame(indexed_in_two_levels(self.df, self.columns(), name), (Key(name),), name)

    def cached(self) -> OrderedFrame:
        """The same frame computed once, in the shared folder: later readers, and lost executors, read it from there."""
        return OrderedFrame(stored(self.df, "cached"), self.order, self.index)

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.columns())


def ordered(df: DataFrame, *order: str | Key) -> OrderedFrame:
    return OrderedFrame(df, keys(order))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate; costs no job. A generator's rows aren't in it, so a plan that has one counts as large."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return 1 << 62 if re.search(r"\bGenerate\b", plan.toString()) else int(str(plan.stats().sizeInBytes()))


def indexed_in_two_levels(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Range shuffle and local sort, stored once; then the partitions' sizes, one row each, become offsets.

    The range boundaries come from a sample that differs from run to run, so the sorted rows are stored with their place:
    offsets and rows are then read from the same files.
    """
    place = F.monotonically_increasing_id()
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), "sorted")
    part, local = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.withColumn("_part", part).join(before, "_part").withColumn(name, local + F.col("_before")).drop("_part", "_before", "_place")
