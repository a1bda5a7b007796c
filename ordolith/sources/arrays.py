"""Ordered frames from generators, lists and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..frame import Key, OrderedFrame, ordered
from ..operators.arrange import concat


def generate(spark: SparkSession, n: int, **columns: Column) -> OrderedFrame:
    """Positions 0 .. n - 1 as ``idx``, with columns computed from it."""
    return OrderedFrame(spark.range(n).withColumnRenamed("id", "idx").withColumns(columns), (Key("idx"),), "idx")


def distribute(spark: SparkSession, rows: Sequence[tuple], schema: str) -> OrderedFrame:
    """A driver's list as an ordered frame; its place in the list is ``idx``."""
    fields = StructType.fromDDL("idx bigint, " + schema)
    return OrderedFrame(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], fields), (Key("idx"),), "idx")


def concat_to(spark: SparkSession, sources: Sequence[Sequence[tuple]], schema: str) -> OrderedFrame:
    """Several lists, one after the other."""
    if not sources:
        raise ValueError("nothing to concatenate")
    return concat(*(OrderedFrame(f.df, f.order) for f in (distribute(spark, s, schema) for s in sources)))


def read_table(spark: SparkSession, path: str, *order: str) -> OrderedFrame:
    """A Parquet table with a declared order; filters and column choices reach the scan."""
    return ordered(spark.read.parquet(path), *order)


def scaled(value: Column, factor: int = 100) -> Column:
    """A decimal number in whole units, so that sums don't depend on their order."""
    return F.round(value * factor).cast("bigint")
