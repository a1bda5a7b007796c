"""Ordered-array analytics on Spark: DataFrames whose rows have a declared total order."""

from .frame import OrderedFrame, ordered

__all__ = ["OrderedFrame", "ordered"]
