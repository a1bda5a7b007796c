"""Positional joins of ordered frames: strict, cut and pad."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType

from ..frame import Key, OrderedFrame
from .windows import disjoint_window


def default_of(kind: DataType):
    """The value that fills a cell where nothing else was asked for."""
    return 0 if isinstance(kind, NumericType) else "" if isinstance(kind, StringType) else False if isinstance(kind, BooleanType) else None


def indexed(frame: OrderedFrame, columns: list[str], flag: str) -> DataFrame:
    return frame.with_index("idx").df.select("idx", *columns, F.lit(True).alias(flag))


def zip_frames(frames: list[tuple[OrderedFrame, list[str]]], mode: str = "strict", padding: dict[str, object] | None = None) -> OrderedFrame:
    """The i-th rows side by side. ``frames``: (frame, columns to take), with distinct column names.

    strict: raises if lengths differ. cut: as many rows as the shortest. pad: as many as the longest, with ``padding`` or
    the type's default where a frame has ended; a null that a frame holds stays null.
    """
    names = [c for _, cols in frames for c in cols]
    if len(set(names)) != len(names):
        raise ValueError(f"zipped columns need different names: {names}")
    if mode not in ("strict", "cut", "pad"):
        raise ValueError(f"no such mode: {mode}")
    parts = [indexed(f, cols, f"_in{i}") for i, (f, cols) in enumerate(frames)]
    if mode == "strict":
        sizes = [p.count() for p in parts]
        if len(set(sizes)) > 1:
            raise ValueError(f"zip needs frames of equal length, not {sizes}")
    out = reduce(lambda a, b: a.join(b, "idx", "full" if mode == "pad" else "inner"), parts)
    if mode == "pad":
        fill = {}
        for i, (_, cols) in enumerate(frames):
            for c in cols:
                kind = parts[i].schema[c].dataType
                fill[c] = F.when(F.col(f"_in{i}"), F.col(c)).otherwise(F.lit((padding or {}).get(c, default_of(kind))).cast(kind))
        out = out.withColumns(fill)
    return OrderedFrame(out.select("idx", *names), (Key("idx"),), "idx")


def zip_aligned(frame: OrderedFrame, *maps: dict[str, Column]) -> OrderedFrame:
    """Zip of several maps of one frame: each row beside itself. Rows stay where they are, so nothing is shuffled."""
    names = [c for m in maps for c in m]
    if len(set(names)) != len(names):
        raise ValueError(f"zipped columns need different names: {names}")
    order = [k.name for k in frame.order]
    if set(names) & set(order):
        raise ValueError(f"zipped columns can't replace the order {order}")
    return OrderedFrame(frame.df.select(*order, *(v.alias(c) for m in maps for c, v in m.items())), frame.order, frame.index)


def zip_windows(frames: list[tuple[OrderedFrame, str, int]], mode: str = "strict", padding: dict[str, object] | None = None) -> OrderedFrame:
    """The i-th blocks side by side as arrays. ``frames``: (frame, column, block size).

    strict: raises if block counts differ or a block is short. cut: whole blocks that all frames have. pad: all blocks,
    filled up to their size.
    """
    parts = []
    for i, (f, column, k) in enumerate(frames):
        b = disjoint_window(f, k, column, column).df
        parts.append(b.select((F.col("idx") / k).cast("bigint").alias("block"), column, F.lit(True).alias(f"_in{i}")))
    if mode == "strict":
        seen = [p.agg(F.count("*").alias("n"), F.coalesce(F.min(F.size(c)), F.lit(k)).alias("least")).first() for p, (_, c, k) in zip(parts, frames)]
        if len({r.n for r in seen}) > 1 or any(r.least < k for r, (_, _, k) in zip(seen, frames)):
            raise ValueError(f"zipped windows need equally many whole blocks: {[(r.n, r.least) for r in seen]}")
    if mode == "cut":
        parts = [p.where(F.size(c) == k) for p, (_, c, k) in zip(parts, frames)]
    out = reduce(lambda a, b: a.join(b, "block", "full" if mode == "pad" else "inner"), parts)
    if mode == "pad":
        fill = {}
        for i, (_, c, k) in enumerate(frames):
            kind = parts[i].schema[c].dataType
            value = F.lit((padding or {}).get(c, default_of(kind.elementType))).cast(kind.elementType)
            have = F.when(F.col(f"_in{i}"), F.col(c)).otherwise(F.array().cast(kind))
            fill[c] = F.concat(have, F.array_repeat(value, k - F.size(have)))
        out = out.withColumns(fill)
    return OrderedFrame(out.select("block", *(c for _, c, _ in frames)), (Key("block"),), "block")
