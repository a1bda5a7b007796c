"""Operator 1: secret scans with DataFrame functions only.

Three base kinds are regular expressions. The method adds high-entropy strings: candidate runs of a character class
are read with a sliding window whose Shannon entropy is kept by incremental counts (one count goes up, one goes
down, and the sum of c * log2 c follows). Base spans and allow-listed parts are blanked before, so only what is left of
a run is a candidate. Entropy sums are whole numbers (millionths of a bit), so every engine and every order gives the
same spans.

Offsets are code points, ends exclusive. Nulls: a null text is an empty text and has no spans. Repeated rows give equal
results, whatever their ids. An empty table gives no rows. Columns other than id and text are not read. Time is linear
in a text's length and spans; a text is held a few times over.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table

KEYS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs: a run that is too short holds no longer one, so the minimum length can stand in the pattern.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
BASE = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))


class EntropyClass(NamedTuple):
    """Runs of ``pattern`` that match ``needs``; a window of ``window`` characters with ``bits`` or more is hot."""

    kind: str
    pattern: str
    needs: str
    window: int
    bits: float


CLASSES = (
    EntropyClass("entropy_hex", "[0-9A-Fa-f]{20,}", "[0-9].*[A-Fa-f]|[A-Fa-f].*[0-9]", 20, 2.9),
    EntropyClass("entropy_base64", "[A-Za-z0-9+/_=-]{20,}", "[0-9].*[A-Za-z]|[A-Za-z].*[0-9]", 20, 3.7),
)
#: Parts that are never scanned for entropy: UUIDs, placeholders, alphabets in order.
ALLOWED = (
    "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Xx]{8,}",
    "0123456789|[Aa][Bb][Cc][Dd][Ee][Ff][Gg][Hh]",
)
#: Values in a block of a running sum: appending to an array copies it, so long arrays are built of blocks.
BLOCK = 256


def terms(window: int) -> list[int]:
    """c * log2(c) in millionths, for counts 0 to ``window``."""
    return [round(c * math.log2(c) * 1e6) if c else 0 for c in range(window + 1)]


def limit(c: EntropyClass) -> int:
    """The largest sum of terms of a hot window: its entropy is log2(window) - sum / window."""
    return round(c.window * (math.log2(c.window) - c.bits) * 1e6)


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, combine) -> Column:
    """For each of the numbers (0 or more) what those before it combine to, 0 for the first; in linear time."""
    start = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("out"))

    def block(v, k):
        return F.aggregate(F.slice(v, k * BLOCK + 1, F.lit(BLOCK)), start, lambda acc, x: F.struct(combine(acc["now"], x).alias("now"), F.array_append(acc["out"], acc["now"]).alias("out")))

    def joined_blocks(blocks):
        before = F.aggregate(blocks, start, lambda acc, x: F.struct(combine(acc["now"], x["now"]).alias("now"), F.array_append(acc["out"], acc["now"]).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, before, lambda x, s: F.transform(x["out"], lambda n: combine(s, n))))

    def whole(v):
        last = F.ceil(F.size(v) / BLOCK).cast("int") - 1
        return F.when(F.size(v) > 0, bound(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: block(v, k)), joined_blocks)).otherwise(F.array().cast("array<int>"))

    return bound(values, whole)


def parted(text: Column, pattern: str) -> Column:
    """array<struct<gap, m>>: what lies before each leftmost match, and the match; the last has no match."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<at, byte, m>>: all leftmost matches with their code point and byte offsets, in order.

    The pieces between matches come from a split by the same pattern, so lengths add up to offsets.
    """
    none = F.array().cast("array<struct<at:int,byte:int,m:string>>")
    add = lambda a, b: a + b

    def located(pieces):
        at, byte = (running(F.transform(pieces, lambda p: size(p["gap"]) + F.coalesce(size(p["m"]), F.lit(0))), add) for size in (F.length, F.octet_length))
        every = F.arrays_zip(pieces.alias("p"), at.alias("at"), byte.alias("byte"))
        found = F.filter(every, lambda x: x["p"]["m"].isNotNull())
        return F.transform(found, lambda x: F.struct((x["at"] + F.length(x["p"]["gap"])).alias("at"), (x["byte"] + F.octet_length(x["p"]["gap"])).alias("byte"), x["p"]["m"].alias("m")))

    return F.when(text.rlike(pattern), bound(parted(text, pattern), located)).otherwise(none)


def as_spans(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda x: span(x["at"], x["byte"], F.length(x["m"]), kind, rank))


def span(at: Column, byte: Column, length: Column, kind: str, rank: int) -> Column:
    """All kinds match ASCII only, so a span has as many bytes as code points."""
    return F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + length).alias("end"), F.lit(kind).alias("kind"), byte.alias("byte"), (byte + length).alias("byte_end"))


def rebuilt(text: Column, spans: Column, filled) -> Column:
    """The text with ``filled(span, end)`` for each of its sorted spans; end: the byte where all spans before it end.

    Cut from the bytes, where a place is found without reading what lies before it.
    """

    def cut(raw, s):
        before = running(F.transform(s, lambda x: x["byte_end"]), F.greatest)
        piece = lambda x, e: F.concat(F.substring(raw, e + 1, F.greatest(x["byte"] - e, F.lit(0))).cast("string"), filled(x, e))
        rest = F.substring(raw, F.array_max(F.transform(s, lambda x: x["byte_end"])) + 1, F.octet_length(raw)).cast("string")
        return F.array_join(F.concat(F.zip_with(s, before, piece), F.array(rest)), "")

    return F.when(F.size(spans) > 0, bound(F.encode(text, "UTF-8"), lambda raw: bound(F.array_sort(spans), lambda s: cut(raw, s)))).otherwise(text)


def blanked(text: Column, pattern: str) -> Column:
    """The text with as many spaces for each match."""
    return F.when(text.rlike(pattern), F.array_join(F.transform(parted(text, pattern), lambda p: F.concat(p["gap"], F.rpad(F.lit(""), F.coalesce(F.length(p["m"]), F.lit(0)), F.lit(" ")))), "")).otherwise(text)


def hot_part(m: Column, c: EntropyClass) -> Column:
    """struct<first, last>: begin of the first and of the last hot window of the candidate, or first = -1."""
    table_of = F.array(*map(F.lit, terms(c.window)))
    term = lambda n: F.element_at(table_of, n + 1)

    def scan(codes):
        def step(acc, i):
            incoming = F.element_at(codes, i)
            outgoing = F.when(i > c.window, F.element_at(codes, F.greatest(i - c.window, F.lit(1)))).otherwise(F.lit(-1))
            up = F.element_at(acc["counts"], incoming + 1)
            # the outgoing count as it is after the incoming character was added
            down = F.when(outgoing >= 0, F.element_at(acc["counts"], F.greatest(outgoing, F.lit(0)) + 1) + F.when(outgoing == incoming, 1).otherwise(0)).otherwise(F.lit(1))
            total = acc["total"] + term(up + 1 - F.when(outgoing == incoming, 1).otherwise(0)) - term(up) + F.when((outgoing >= 0) & (outgoing != incoming), term(down - 1) - term(down)).otherwise(F.lit(0))
            counts = F.transform(acc["counts"], lambda n, k: n + F.when(k == incoming, 1).otherwise(0) - F.when(k == outgoing, 1).otherwise(0))
            hot = (i >= c.window) & (total <= limit(c))
            begin = i - c.window
            return F.struct(counts.alias("counts"), total.alias("total"), F.when(hot & (acc["first"] < 0), begin).otherwise(acc["first"]).alias("first"), F.when(hot, begin).otherwise(acc["last"]).alias("last"))

        start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    codes = F.transform(F.filter(F.split(m, ""), lambda x: x != ""), lambda x: F.ascii(x))
    return F.element_at(F.transform(F.array(codes), scan), 1)


def entropy_spans(text: Column, c: EntropyClass, rank: int) -> Column:
    """Spans of hot candidates of a text from which base spans and allow-listed parts were blanked."""
    wanted = F.filter(matches(text, c.pattern), lambda x: x["m"].rlike(c.needs))
    hot = F.filter(F.transform(wanted, lambda x: F.struct(x["at"].alias("at"), x["byte"].alias("byte"), hot_part(x["m"], c).alias("part"))), lambda x: x["part"]["first"] >= 0)
    return F.transform(hot, lambda x: span(x["at"] + x["part"]["first"], x["byte"] + x["part"]["first"], x["part"]["last"] - x["part"]["first"] + c.window, c.kind, rank))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_spans(docs: DataFrame, text: Column, classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> tuple[DataFrame, str, str]:
    """Adds base spans and all spans, one pass of the scan for all that use them; gives the frame and their names."""
    base, left, every = (free(n, docs.columns) for n in ("_base", "_left", "_all"))
    text = F.coalesce(text, F.lit(""))
    by_kind = {}
    for rank, (kind, pattern) in enumerate(BASE):
        found = matches(text, pattern)
        if kind == "assign":
            found = F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
        by_kind[kind] = as_spans(found, kind, rank)
    got = docs.withColumn(base, F.concat(*by_kind.values()))
    spaces = lambda x, e: F.rpad(F.lit(""), F.greatest(x["byte_end"] - F.greatest(x["byte"], e), F.lit(0)), F.lit(" "))
    cleared = rebuilt(text, F.col(base), spaces)
    got = got.withColumn(left, bound(cleared, lambda t: blanked(t, "|".join(allowed))) if allowed else cleared)
    added = [entropy_spans(F.col(left), c, len(BASE) + i) for i, c in enumerate(classes)]
    return got.withColumn(every, F.concat(base, *added)).drop(left), base, every


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, a digest of base spans, and all spans as text."""
    rows, base, every = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("text"))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select("doc_id", *(count(k) for k, _ in BASE), F.sha2(joined(F.col(base)), 256).alias("base_sha256"), joined(F.col(every)).alias("spans"))


def redact_secrets(docs: DataFrame, *, text_col: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """The same rows and columns with every span of the text replaced by ``mark`` (overlapping spans by one)."""
    rows, base, every = with_spans(docs, F.col(text_col))
    marked = rebuilt(F.col(text_col), F.col(every), lambda x, e: F.when(x["byte"] >= e, mark).otherwise(""))
    return rows.withColumn(text_col, marked).drop(base, every)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def _sql_matches(pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""list_transform(range(1, len(regexp_extract_all(text, '{p}')) + 1), lambda i: {{'m': regexp_extract_all(text, '{p}')[i],
        'at': CAST(list_sum(list_transform(string_split_regex(text, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{p}')[1:i-1], lambda x: length(x))), 0) AS BIGINT)}})"""


def oracle_sql() -> str:
    """The same result in DuckDB: windows are counted anew there, which proves the incremental counts."""
    base = []
    for rank, (kind, pattern) in enumerate(BASE):
        keep = "length(regexp_extract(x.m, '" + ASSIGN.replace("'", "''") + "', 2)) >= 6" if kind == "assign" else "true"
        base.append(f"list_transform(list_filter({_sql_matches(pattern)}, lambda x: {keep}), lambda x: {{'start': x.at, 'rank': {rank}, 'end': x.at + length(x.m), 'kind': '{kind}'}})")
    added = []
    for i, c in enumerate(CLASSES):
        f = "[" + ", ".join(map(str, terms(c.window))) + "]"
        sum_of = f"list_sum(list_transform(list_distinct(string_split(substr(x.m, p, {c.window}), '')), lambda ch: {f}[1 + length(substr(x.m, p, {c.window})) - length(replace(substr(x.m, p, {c.window}), ch, ''))]))"
        hot = f"list_filter(range(1, length(x.m) - {c.window} + 2), lambda p: {sum_of} <= {limit(c)})"
        added.append(
            f"""list_filter(list_transform(list_filter({_sql_matches(c.pattern)}, lambda x: regexp_matches(x.m, '{c.needs}')),
            lambda x: {{'start': x.at + list_min({hot}) - 1, 'rank': {len(BASE) + i}, 'end': x.at + list_max({hot}) - 1 + {c.window}, 'kind': '{c.kind}'}}), lambda s: s.start IS NOT NULL)"""
        )
    text = lambda spans: f"""array_to_string(list_transform(list_sort({spans}), lambda s: s.kind || ':' || s.start || ':' || s."end"), ',')"""
    counts = ", ".join(f"CAST(len(list_filter(b, lambda s: s.kind = '{k}')) AS BIGINT) AS n_{k}" for k, _ in BASE)
    allowed = "|".join(ALLOWED)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        s AS (SELECT doc_id, text, list_concat(list_concat({base[0]}, {base[1]}), {base[2]}) AS b FROM d),
        c AS (SELECT doc_id, b, CASE WHEN len(b) = 0 THEN text ELSE array_to_string(list_transform(string_split(text, ''),
            lambda ch, i: CASE WHEN len(list_filter(b, lambda s: s.start < i AND s."end" >= i)) > 0 THEN ' ' ELSE ch END), '') END AS text FROM s),
        l AS (SELECT doc_id, b, array_to_string(list_transform(list_zip(string_split_regex(text, '{allowed}'), regexp_extract_all(text, '{allowed}')),
            lambda x: x[1] || repeat(' ', coalesce(length(x[2]), 0))), '') AS text FROM c),
        a AS (SELECT doc_id, b, list_concat(list_concat(b, {added[0]}), {added[1]}) AS a FROM l)
        SELECT doc_id, {counts}, sha256(coalesce({text('b')}, '')) AS base_sha256, coalesce({text('a')}, '') AS spans FROM a"""
