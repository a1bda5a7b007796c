"""Operator 5: benchmark decontamination by template canonicalisation.

Words of texts and items become templates: numbers, names and units turn into typed placeholders, other words are
lower-cased without surrounding punctuation. Windows of the template are hashed and joined with the item windows, and
where they meet the slots are compared: the same item value must always stand for the same document value, along one
alignment. An item has leaked into a document if consistent windows cover ``coverage`` of the item's words.

Document windows pass a bit array of the item windows first. Its size is fixed, so it can be broadcast whatever the
benchmark's size; what passes by chance meets no item in the exact join. Item windows are joined by broadcast only after
their number was checked, and else by a shuffle with salted document windows.

Result: one row per document and leaked template, under the smallest item id of the template (items are of one template
if their plain words agree and their slots repeat alike; an id of null only where there is no other). Nulls: a null text
holds nothing; a null document or item id is kept as null. Rows that repeat id and text are one document; different
texts under one id, or under none, are documents of their own. An item shorter than a window is one window; an item
without words is not searched for. Windows of which less than half are plain words open an alignment by the values of
one of the template's items only (by the template if it has no other), but count by their template in every alignment
that is open. An empty table on either side gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, anti_join, arrow_schema, held, mix, slices, stored, table, text_key, windows, word_hash

PLAIN, NUMBER, NAME, UNIT = range(4)
UNITS = frozenset(b"mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg lb lbs oz pound pounds ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degrees mph kph watt watts volt volts".split())
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "+-$%")
DIGITS = re.compile(rb"[+-]?[$]?[0-9][0-9.,:/-]*%?")
DIGIT_UNIT = re.compile(rb"[+-]?[0-9][0-9.,]*([a-z]+)")
WORDS_OF_NUMBERS = frozenset(b"one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
BITS = 24
#: Stands between texts; no UTF-8 text holds this byte.
PART = b"\xff"
PARTED = (1 << 64) - 1


def described(raw: bytes) -> int:
    """A raw word as one number: its kind in the low two bits, above it a hash of the normal form (its value)."""
    if raw == PART:
        return PARTED
    word = raw.strip(PUNCTUATION) or raw
    if word.isalpha():  # ASCII letters only: no decoding
        low = word.lower()
        name = len(word) > 1 and word.istitle()
    else:
        text = word.decode("utf-8", "replace")
        low = text.lower().encode()
        name = len(text) > 1 and text[0].isupper() and text[1:].islower()
    if low in WORDS_OF_NUMBERS or DIGITS.fullmatch(low):
        kind = NUMBER
    elif low in UNITS or (m := DIGIT_UNIT.fullmatch(low)) and m[1] in UNITS:
        kind = UNIT
    else:
        kind = NAME if name else PLAIN
    return word_hash(low) >> 3 << 2 | kind


_PLACEHOLDERS = mix(np.arange(4, dtype=np.uint64))


def templates(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts: which text, the value, and what stands in the template (value or placeholder).

    A capitalised word is a name wherever it stands: at the start of a sentence both readings are possible, and as a
    slot it also meets other names, while slot consistency still compares its value.
    """
    memo = held("decontaminate", lambda: Memo(described))
    words = (b" " + PART + b" ").join([(t or "").encode() for t in texts]).split()
    value = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    parts = value == np.uint64(PARTED)
    text_of = np.cumsum(parts)[~parts]
    value = value[~parts]
    kind = (value & np.uint64(3)).astype(np.int8)
    return text_of, value, np.where(kind == PLAIN, value, _PLACEHOLDERS[kind])


def kinds(value: np.ndarray) -> np.ndarray:
    return (value & np.uint64(3)).astype(np.int8)


def bits_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - BITS)).astype(np.int64), ((h << np.uint64(BITS)) >> np.uint64(64 - BITS)).astype(np.int64)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


VALUES = np.uint64(0xA24BAED4963EE407)


def windows_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """``windows(h, k)`` at the places ``at``."""
    x = mix(h[at])
    for i in range(1, k):
        x = mix(x * np.uint64(3) + h[at + i])
    return x


def plain_words(value: np.ndarray, k: int) -> np.ndarray:
    """The number of plain words in each k-word window."""
    n = np.r_[0, np.cumsum(kinds(value) == PLAIN)]
    return n[k:] - n[:-k]


def template_windows(shape: np.ndarray, k: int, size: int) -> np.ndarray:
    """Hashes of k-word windows; of items shorter than ``size``, windows of another length never meet."""
    h = windows(shape, k)
    return h if k == size else mix(h + np.uint64(k))


def among(array: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of ``h`` that pass the bit array."""
    a, b = bits_of(h)
    hit = np.flatnonzero((array[a >> 3] >> (a & 7) & 1).astype(bool))
    return hit[(array[b[hit] >> 3] >> (b[hit] & 7) & 1).astype(bool)]


ITEM_WINDOWS = "item_id bigint, words int, size int, at int, hash bigint, slots binary, opens boolean"
DOC_WINDOWS = "doc_id bigint, tie bigint, at int, hash bigint, slots binary, opens boolean"


def slot_pattern(value: np.ndarray) -> bytes:
    """For each word its value, or for a slot its kind and the place where its value occurs first: equal for equal templates."""
    kind = kinds(value)
    _, first, of = np.unique(value, return_index=True, return_inverse=True)
    return np.where(kind == PLAIN, value, _PLACEHOLDERS[kind] + first[of].astype(np.uint64)).tobytes() + kind.tobytes()


def named_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, first, text): every different text, with the smallest id of its template and that item's text."""
    schema = "id bigint, text string, template binary"
    out = arrow_schema(items.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            rows = [(i, t, hashlib.blake2b(slot_pattern(v), digest_size=16).digest()) for i, t in zip(ids, texts) if len(v := templates([t])[1])]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    found = stored(items.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null").mapInArrow(run, schema), "items")
    first = found.groupBy("template").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text")).alias("x"))
    return found.select("template", "text").distinct().join(first, "template").select(F.col("x.id").alias("item_id"), F.col("x.text").alias("first"), "text")


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """Windows of every template, with the slot values of its first item.

    Windows that don't open an alignment by their template have further rows, which open one by the hash of the values
    that one of the template's items has there.
    """
    out = arrow_schema(items.sparkSession, ITEM_WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, first, text in zip(*(c.to_pylist() for c in batch.columns)):
                (_, value, shape), mine = templates([first]), templates([text])[1]
                n = len(value)
                k = min(size, n)
                h = template_windows(shape, k, size)
                opens = 2 * plain_words(value, k) >= k
                opens = opens if opens.any() else np.ones(len(h), bool)
                exact = mix(windows(mine, k) ^ VALUES)
                for i in range(len(h)):
                    slots = value[i : i + k].tobytes()
                    if text == first:
                        rows.append((item, n, k, i, int(as_long(h)[i]), slots, bool(opens[i])))
                    if not opens[i]:
                        rows.append((item, n, k, i, int(as_long(exact)[i]), slots, True))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    return items.select("item_id", "first", "text").mapInArrow(run, ITEM_WINDOWS).distinct()


def leaked(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 8, coverage: float = 0.7, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, tie, item_id, matched_words, item_words, replaced_slots: consistent leaks of at least ``coverage``.

    tie: the text's key, as one id may stand for several texts.
    """
    spark = docs.sparkSession
    targets = stored(item_windows(named_items(items, item_id, item_text), size), "item-windows")
    short = sorted(r.size for r in targets.where(F.col("size") < size).select("size").distinct().collect())  # sizes below the window
    h = F.col("hash")
    first = F.shiftrightunsigned(h, 64 - BITS)
    second = F.shiftrightunsigned(F.shiftleft(h, BITS), 64 - BITS)
    places = targets.select("opens", F.explode(F.array(first, second)).alias("b")).distinct().toArrow()  # 2**25 at most
    arrays = []
    for opens in (True, False):
        b = places.filter(pa.compute.equal(places["opens"], opens))["b"].to_numpy()
        arrays.append(np.zeros(1 << (BITS - 3), np.uint8))
        np.bitwise_or.at(arrays[-1], b >> 3, (1 << (b & 7)).astype(np.uint8))
    seen = spark.sparkContext.broadcast(arrays)
    longest = targets.agg(F.max("words")).first()[0] or 0
    out = arrow_schema(spark, DOC_WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening, others = seen.value
        for batch in batches:
            for lo, hi in slices(batch.columns, batch.num_rows):
                docs, ties, texts = (c.slice(lo, hi - lo).to_pylist() for c in batch.columns)
                text_of, value, shape = templates(texts)
                first = np.searchsorted(text_of, np.arange(len(texts)))
                rows: list = []
                for k in (*short, size):
                    if len(value) < k:
                        continue
                    inside = text_of[k - 1 :] == text_of[: len(text_of) - k + 1]
                    h = template_windows(shape, k, size)
                    hit = among(opening, h)
                    hit = hit[inside[hit]]
                    met = [(hit, h[hit], True)]
                    heavy = np.flatnonzero(inside & (2 * plain_words(value, k) < k)) if k == size else hit[:0]
                    if len(heavy):
                        exact = mix(windows_at(value, heavy, k) ^ VALUES)
                        same = among(opening, exact)
                        met.append((heavy[same], exact[same], True))
                        start = np.union1d(hit, heavy[same])
                        # no alignment reaches further from a window that opens it than the longest item
                        if len(start):
                            after = start[np.minimum(np.searchsorted(start, heavy), len(start) - 1)]
                            before = start[np.maximum(np.searchsorted(start, heavy, "right") - 1, 0)]
                            heavy = heavy[np.minimum(abs(after - heavy), abs(heavy - before)) < longest]
                            heavy = heavy[among(others, h[heavy])]
                            met.append((heavy, h[heavy], False))
                    for at, of, opens in met:
                        rows += [(docs[d], ties[d], i - b, x, value[i : i + k].tobytes(), opens) for i, x, d, b in zip(at.tolist(), as_long(of).tolist(), text_of[at].tolist(), first[text_of[at]].tolist())]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    text = F.col(text_col)
    hits = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text).alias("tie"), text.alias("text")).where("text is not null").mapInArrow(run, DOC_WINDOWS)
    hits = stored(hits, "window-hits")
    right = targets.withColumnsRenamed({"at": "item_at", "slots": "item_slots"})
    few = targets.count() <= broadcast_rows

    def with_items(left: DataFrame, items: DataFrame, on: str, *spread: str) -> DataFrame:
        same = F.col(on).eqNullSafe(F.col("_on"))
        items = items.withColumnRenamed(on, "_on")
        if few:
            return left.join(F.broadcast(items), same)
        salts = 16
        salted = left.withColumn("salt", F.pmod(F.hash(*spread), F.lit(salts)))
        spread_items = items.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return salted.join(spread_items, same & (F.col("salt") == F.col("_salt")))

    # each window alone: values of plain words were compared by the hash, slots are kept for the alignment
    names = ["doc_id", "tie", "item_id", "shift", "item_at", "words", "size", "slots", "item_slots"]
    met = with_items(hits.where("opens").drop("opens"), right.where("opens"), "hash", "doc_id", "tie", "at").withColumn("shift", F.col("at") - F.col("item_at")).select(*names)
    met = stored(met, "met-windows")
    # the other windows of what is open: each has one place in the document
    wanted = with_items(met.select("doc_id", "tie", "item_id", "shift").distinct(), right.where("not opens").drop("opens"), "item_id", "doc_id", "tie", "shift").withColumn("at", F.col("shift") + F.col("item_at"))
    there = hits.where("not opens").select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), F.col("at").alias("_at"), F.col("hash").alias("_hash"), "slots")
    more = wanted.join(there, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")) & (F.col("at") == F.col("_at")) & (F.col("hash") == F.col("_hash"))).select(*names)
    return consistent(met.union(more), coverage)


def consistent(met: DataFrame, coverage: float) -> DataFrame:
    """One alignment (document, item, shift) at a time: windows whose slots agree with one mapping of values.

    A window says for each placeholder which document value stands for which item value. Per alignment the pairs are
    counted; a window is consistent if each of its pairs is the most frequent one of its item value (ties: the
    smallest), and then its words are covered.
    """
    schema = "doc_id bigint, tie bigint, item_id bigint, shift int, item_at int, words int, size int, kind array<struct<k:int,d:bigint,i:bigint>>"
    out = arrow_schema(met.sparkSession, schema)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, tie, item, shift, at, n, k, d, i in zip(*(c.to_pylist() for c in batch.columns)):
                d, i = np.frombuffer(d, np.int64), np.frombuffer(i, np.int64)
                t = kinds(i.view(np.uint64))
                rows.append((doc, tie, item, shift, at, n, k, [{"k": int(t[j]), "d": int(d[j]), "i": int(i[j])} for j in np.flatnonzero(t)]))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    found = met.distinct().mapInArrow(pairs, schema)
    # an alignment holds at most as many windows as the item, so its list is bounded by the item's length
    grouped = found.groupBy("doc_id", "tie", "item_id", "shift").agg(F.max("words").alias("words"), F.array_sort(F.collect_set(F.struct("item_at", "size", "kind"))).alias("w"))
    every = F.flatten(F.transform("w", lambda x: x["kind"]))
    ok = lambda x: F.forall(x["kind"], lambda s: ~F.exists("_every", lambda o: (o["k"] == s["k"]) & (o["i"] == s["i"]) & (o["d"] != s["d"])) | (F.element_at("_best", F.concat_ws(":", s["k"], s["i"])) == s["d"]))
    distinct = F.array_distinct(F.transform("_every", lambda s: F.concat_ws(":", s["k"], s["i"])))

    def mode(key):
        mine = F.transform(F.filter("_every", lambda s: F.concat_ws(":", s["k"], s["i"]) == key), lambda s: s["d"])
        ranked = F.array_sort(F.transform(F.array_distinct(mine), lambda d: F.struct((-F.size(F.filter(mine, lambda m: m == d))).alias("n"), d.alias("d"))))
        return F.struct(key.alias("key"), F.element_at(ranked, 1)["d"].alias("value"))

    scored = grouped.withColumn("_every", every).withColumn("_best", F.map_from_entries(F.transform(distinct, mode)))
    scored = scored.withColumn("_good", F.filter("w", ok))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_good", lambda x: F.sequence(x["item_at"], x["item_at"] + x["size"] - 1)))))
    changed = F.size(F.array_distinct(F.transform(F.filter(F.flatten(F.transform("_good", lambda x: x["kind"])), lambda s: s["d"] != s["i"]), lambda s: F.concat_ws(":", s["k"], s["i"]))))
    scored = scored.select("doc_id", "tie", "item_id", covered.alias("matched_words"), F.col("words").alias("item_words"), changed.alias("replaced_slots"))
    enough = scored.where(F.col("matched_words") >= coverage * F.col("item_words"))
    return enough.groupBy("doc_id", "tie", "item_id").agg(F.max("matched_words").cast("bigint").alias("matched_words"), F.max("item_words").cast("bigint").alias("item_words"), F.min("replaced_slots").cast("bigint").alias("replaced_slots"))


def drop_leaked(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose own text holds no item; all columns as they were."""
    return anti_join(docs, leaked(docs, items, id_col=id_col, text_col=text_col, **how), id_col, text_col)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tie")
