"""Local operators: no shuffle, order kept (but for the bag union)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import Key, OrderedFrame


def map_rows(frame: OrderedFrame, *select: Column | str, **columns: Column) -> OrderedFrame:
    """One row for one row. Order columns pass through unless a given column replaces them."""
    out = frame.df.withColumns(columns) if columns else frame.df
    if select:
        kept = [k.name for k in frame.order]
        picked = out.select(*select)
        out = out.select(*select, *(c for c in kept if c not in picked.columns))
    return OrderedFrame(out, frame.order, frame.index if frame.index in out.columns else None)


def filter_rows(frame: OrderedFrame, condition: Column | str) -> OrderedFrame:
    """Rows that meet the condition; a null condition drops. The filter reaches the scan. Positions become stale."""
    return OrderedFrame(frame.df.where(condition), frame.order)


def flat_map(frame: OrderedFrame, items: Column, name: str, emitted: str = "emitted") -> OrderedFrame:
    """A row for each element of the array ``items``, in order; null and empty arrays give none."""
    out = frame.df.select("*", F.posexplode(items).alias(emitted, name)).withColumn(emitted, F.col(emitted).cast("bigint"))
    return OrderedFrame(out, (*frame.order, Key(emitted)))


def bernoulli_sample(frame: OrderedFrame, fraction: float, seed: int = 1) -> OrderedFrame:
    """Each row by itself with probability ``fraction``."""
    return OrderedFrame(frame.df.sample(fraction=fraction, seed=seed), frame.order)


def hash_sample(frame: OrderedFrame, key: Column, modulus: int, below: int, factor: int = 7919) -> OrderedFrame:
    """Rows whose integer key falls below a mark under a linear hash: the same rows wherever and however it runs."""
    return OrderedFrame(frame.df.where(F.pmod(key * factor, F.lit(modulus)) < below), frame.order)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union; frames need the same columns and types."""
    for other in others:
        if dict(other.dtypes) != dict(first.dtypes):
            raise ValueError(f"a union needs equal columns: {first.dtypes} and {other.dtypes}")
    return reduce(DataFrame.unionByName, others, first)
