"""Suffix arrays by prefix doubling, and what is built on them. A text is a frame (i, c): position and symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import ordered
from ..operators.scans import ex_prefix_sum
from ..store import stored


def symbols(df: DataFrame, text: str, *by: str) -> DataFrame:
    """(by..., i, c): code points of each text."""
    return df.select(*by, F.posexplode(F.filter(F.split(text, ""), lambda x: x != "")).alias("i", "c")).withColumn("i", F.col("i").cast("bigint"))


def joined(df: DataFrame, text: str, order: str) -> DataFrame:
    """(i, c): all texts as one, in order, with a line end after each; positions come from a prefix sum of lengths."""
    rows = ordered(df.select(order, F.concat(F.coalesce(text, F.lit("")), F.lit("\n")).alias("_text")), order)
    placed = ex_prefix_sum(rows, F.length("_text").cast("bigint"), "_start").df
    return symbols(placed, "_text", "_start").select((F.col("_start") + F.col("i")).alias("i"), "c")


def named_prefixes(text: DataFrame) -> list[DataFrame]:
    """Per round h = 0, 1, ... (i, name): the rank, from 1, of the 2 ** h symbols at i among all such; each round is stored.

    A round names pairs of names by one sort; the last is the one whose names all differ.
    """
    names = ordered(text.groupBy("c").count(), "c").with_index("name").df.select("c", "name")
    rounds = [stored(text.join(names, "c").select("i", (F.col("name") + 1).alias("name")), "names")]
    n = rounds[0].count()
    while rounds[-1].select("name").distinct().count() < n:
        now, h = rounds[-1], 1 << (len(rounds) - 1)
        ahead = now.select((F.col("i") - h).alias("i"), F.col("name").alias("next"))
        pairs = now.join(ahead, "i", "left").select("i", "name", F.coalesce("next", F.lit(0).cast("bigint")).alias("next"))
        keys = ordered(pairs.select("name", "next").distinct(), "name", "next").with_index("_new").df
        rounds.append(stored(pairs.join(keys, ["name", "next"]).select("i", (F.col("_new") + 1).alias("name")), "names"))
    return rounds


def suffix_array(text: DataFrame, rounds: list[DataFrame] | None = None) -> DataFrame:
    """(rank, i): suffixes in order, a suffix before those it begins."""
    last = (rounds or named_prefixes(text))[-1]
    return last.select((F.col("name") - 1).alias("rank"), "i")


def is_suffix_array(text: DataFrame, sa: DataFrame) -> DataFrame:
    """(ok): positions are a permutation, and neighbours are in order: by symbol, then by the rank of the next suffix."""
    n = text.count()
    whole = sa.agg(((F.count("*") == n) & (F.countDistinct("i") == n) & F.coalesce(F.min("i") == 0, F.lit(n == 0))).alias("ok"))
    after = sa.select((F.col("i") - 1).alias("i"), F.col("rank").alias("after"))
    rows = sa.join(text, "i").join(after, "i", "left").withColumn("after", F.coalesce("after", F.lit(-1).cast("bigint")))
    nxt = rows.select((F.col("rank") - 1).alias("rank"), F.col("c").alias("c2"), F.col("after").alias("after2"))
    bad = rows.join(nxt, "rank").where(~((F.col("c") < F.col("c2")) | ((F.col("c") == F.col("c2")) & (F.col("after") < F.col("after2")))))
    return whole.union(bad.agg((F.count("*") == 0).alias("ok"))).agg(F.bool_and("ok").alias("ok"))


def burrows_wheeler(text: DataFrame, sa: DataFrame) -> DataFrame:
    """(rank, c): the symbol before each suffix; before the first stands the last."""
    n = text.count()
    return sa.withColumn("j", F.pmod(F.col("i") - 1, F.lit(n))).join(text.withColumnRenamed("i", "j"), "j").select("rank", "c")


def longest_common_prefixes(text: DataFrame) -> DataFrame:
    """(rank, lcp): symbols that a suffix shares with the one before it (0 for the first).

    From the longest named prefixes down: where both suffixes go on with the same name, they share its length.
    """
    rounds = named_prefixes(text)
    sa = suffix_array(text, rounds)
    before = sa.select((F.col("rank") + 1).alias("rank"), F.col("i").alias("j"))
    now = sa.join(before, "rank", "left").withColumn("lcp", F.lit(0).cast("bigint"))
    for h, names in reversed(list(enumerate(rounds[:-1]))):
        mine = names.select(F.col("i").alias("_i"), F.col("name").alias("_a"))
        other = names.select(F.col("i").alias("_j"), F.col("name").alias("_b"))
        met = now.join(mine, F.col("i") + F.col("lcp") == F.col("_i"), "left").join(other, F.col("j") + F.col("lcp") == F.col("_j"), "left")
        longer = F.when(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)), F.col("lcp") + (1 << h)).otherwise(F.col("lcp"))
        now = met.select("rank", "i", "j", longer.alias("lcp"))
    return now.select("rank", "lcp")


def wavelet_level(text: DataFrame, bits: int, level: int) -> DataFrame:
    """(place, bit): one level of a wavelet tree over symbol codes of ``bits`` bits, sorted stably by the bits above."""
    code = F.ascii("c").cast("bigint")
    above, bit = F.shiftright(code, bits - level), F.shiftright(code, bits - level - 1).bitwiseAND(F.lit(1).cast("bigint"))
    return ordered(text.select("i", above.alias("above"), bit.alias("bit")), "above", "i").with_index("place").df.select("place", "bit")
