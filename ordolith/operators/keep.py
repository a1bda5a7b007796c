"""Frames that are computed once, run at once, or given up.

Readers don't use a frame up: one that isn't cached is computed again for each of them.
"""

from __future__ import annotations

from ..frame import OrderedFrame
from ..store import drop_stored


def cache(frame: OrderedFrame) -> OrderedFrame:
    """The frame computed now, in the shared folder, where lineage ends; one that is cached is given back as it is."""
    return frame if hasattr(frame.df, "stored_at") else frame.cached()


def execute(*frames: OrderedFrame) -> None:
    """Compute frames now, every row and column, and throw the rows away."""
    for f in frames:
        f.df.write.format("noop").mode("overwrite").save()


def dispose(*frames: OrderedFrame) -> None:
    """Delete the files of cached frames; whatever still reads one raises from then on."""
    for f in frames:
        if not hasattr(f.df, "stored_at"):
            raise ValueError("only a cached frame can be disposed of")
    drop_stored(*(f.df for f in frames))
