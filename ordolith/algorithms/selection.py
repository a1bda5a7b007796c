"""The k-th smallest value without a full sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_rank(df: DataFrame, value: str, k: int, keep: int = 10_000) -> DataFrame:
    """(value): the element at 0-based rank k. Rounds narrow [low, high] by approximate quantiles and exact counts.

    A round's counts are one row; when at most ``keep`` rows are left, they are sorted. Values that fill the whole
    interval are the answer at once.
    """
    if k < 0:
        raise ValueError("ranks begin at 0")
    rows, below = df.where(F.col(value).isNotNull()), 0
    while True:
        n = rows.count()
        if below + n <= k:
            raise ValueError(f"there are only {below + n} values")
        if n <= keep:
            return rows.select(value).orderBy(value).offset(k - below).limit(1)
        share = (k - below + 0.5) / n
        low, high = rows.agg(F.percentile_approx(value, F.array(F.lit(max(0.0, share - 0.01)), F.lit(min(1.0, share + 0.01))), F.lit(10_000)).alias("q")).first().q
        less, inside = rows.agg(F.count(F.when(F.col(value) < low, 1)), F.count(F.when(F.col(value).between(low, high), 1))).first()
        if below + less <= k < below + less + inside:
            if low == high:
                return rows.where(F.col(value) == low).select(value).limit(1)
            rows, below = rows.where(F.col(value).between(low, high)), below + less
            if inside == n:  # no progress: many equal values at the ends
                return rows.select(value).orderBy(value).offset(k - below).limit(1)
        elif k < below + less:
            rows = rows.where(F.col(value) < low)
        else:
            rows, below = rows.where(F.col(value) > high), below + less + inside
