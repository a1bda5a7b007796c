"""Operator 6: removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``width`` bytes that covers it also starts earlier (smaller id, or the same document and an
earlier start). Strings are judged on the input.

1. Every ``width``-byte window has an anchor: the gram of 36 bytes in it with the least hash (the leftmost of equal
   ones). Equal windows have equal anchors, so what may repeat is found by grouping anchors, about one for every
   thirty bytes. Runs of windows with one anchor are one row, with hashes of all their bytes; each task keeps the
   earliest of its equal runs, so a passage in a third of all documents sends one row a task.
2. Runs with one anchor and equal hashes of 128 bits over all their bytes repeat the earliest of them. Anchors with
   different runs need their bytes: these are read into shards by anchor, and a shard gets a suffix array (Larsson-Sadakane refinement of ranks), common prefixes
   of neighbours (Kasai), and from these its equal windows; all but the earliest are repeats.
3. An anchor with very many different runs is spread over several shards. Those meet by binary search: each shard sorts
   the 128-bit hashes of its windows and cuts them at common splitters, evenly spaced, and the slices of all shards
   between two splitters are merged. A slice of a shard is one packed row.

Nulls: a null text has no bytes; a null id comes before all others. Texts under one id are documents of their own, in
the order of a hash of the text; rows that repeat id and text are one document and get the same result. An empty
table gives no rows. Other columns are not read. A text of any length is held whole; it is hashed in parts of a million
bytes that overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, map_groups, mix, slices, stored, table

GRAM = 36
PLACE = 20
_B = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
_BYTES, _OTHERS = np.random.default_rng(5).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def powers() -> tuple[np.ndarray, np.ndarray]:
    """B ** i and its inverse modulo 2 ** 64."""
    if not _POWERS:
        n = 1 << PLACE
        for base in (_B, pow(_B, -1, 1 << 64)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _POWERS.append(np.cumprod(a, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hashes of all 36-byte grams: of 1, 2, 4, ... 32 bytes by joining halves, then 4 more."""
    m = np.uint64(0xD6E8FEB86659FD93)
    step = lambda a: (a ^ (a >> np.uint64(31))) * m
    parts = [_BYTES[x]]
    for k in (1, 2, 4, 8, 16):
        a = parts[-1]
        parts.append(step(a[:-k] * np.uint64(3) + a[k:]))
    whole, four = parts[5], parts[2]
    return step(whole[: len(x) - GRAM + 1] * np.uint64(5) + four[32 : 32 + len(x) - GRAM + 1])


def anchors(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in bytes x (fewer than 2 ** 20): first and last start, anchor hash, run hash."""
    n = len(x) - width + 1
    g = gram_hashes(x)
    key = (g >> np.uint64(PLACE)) << np.uint64(PLACE) | np.arange(len(g), dtype=np.uint64)
    least, k, span = key, 1, width - GRAM + 1
    while 2 * k <= span:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if span > k:
        least = np.minimum(least[: n], least[span - k : span - k + n])
    place = (least[:n] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    cut = np.flatnonzero(place[1:] != place[:-1]) + 1
    first, last = np.r_[0, cut], np.r_[cut - 1, n - 1]
    return first, last, place[first], g


def run_hashes(x: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits over all bytes of each run, its length and its anchor's place: two sums with random weights of bytes."""
    up, down = powers()
    shape = mix((place - first).astype(np.uint64) * np.uint64(1024) + (last - first).astype(np.uint64))
    got = []
    for weights in (_BYTES, _OTHERS):
        total = np.r_[np.uint64(0), np.cumsum(weights[x] * up[: len(x)], dtype=np.uint64)]
        got.append(mix((total[last + width] - total[first]) * down[first] + shape))
    return got[0], got[1]


def document_runs(raw: bytes, width: int) -> tuple[np.ndarray, ...]:
    """first, last, anchor hash, run hashes (two) of a document; long ones in parts that overlap by a window less one byte."""
    step = (1 << PLACE) - 4096
    got = []
    for at in range(0, max(1, len(raw) - width + 1), step):
        x = np.frombuffer(raw[at : at + step + width - 1], np.uint8)
        if len(x) < width:
            break
        first, last, place, g = anchors(x, width)
        got.append((first + at, last + at, mix(g[place]), *run_hashes(x, first, last, place, width)))
    return tuple(map(np.concatenate, zip(*got))) if got else (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 3


RUNS = "key bigint, h bigint, c bigint, c2 bigint, doc bigint, tie bigint, b int, e int"


def runs(docs: DataFrame, width: int) -> DataFrame:
    """Rows of runs, combined in each task: h is null for a run that equals an earlier one of its task."""
    out = arrow_schema(docs.sparkSession, RUNS)

    def emit(held):
        doc, tie, b, e, h, c, c2 = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((b, tie, doc, c2, c))
        doc, tie, b, e, h, c, c2 = (x[order] for x in (doc, tie, b, e, h, c, c2))
        again = np.r_[False, (c[1:] == c[:-1]) & (c2[1:] == c2[:-1]) & (h[1:] == h[:-1])]
        lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(c))))
        keep = ~again | (doc != doc[lead]) | (tie != tie[lead]) | (b != b[lead])  # a repeated row is the same run
        doc, tie, b, e, h, c, c2, again = (x[keep] for x in (doc, tie, b, e, h, c, c2, again))
        key = np.where(again, mix(doc.view(np.uint64) + b.astype(np.uint64) * np.uint64(_B)), h).view(np.int64)
        for lo in range(0, len(key), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            cols = [pa.array(key[s]), pa.array(h[s].view(np.int64), mask=again[s]), pa.array(c[s].view(np.int64), mask=again[s]), pa.array(c2[s].view(np.int64), mask=again[s]), pa.array(doc[s]), pa.array(tie[s]), pa.array(b[s].astype(np.int32)), pa.array(e[s].astype(np.int32))]
            yield pa.record_batch(cols, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for lo, hi in slices(batch.columns, batch.num_rows):
                for doc, tie, text in zip(*(c.slice(lo, hi - lo).to_pylist() for c in batch.columns)):
                    b, *rest = document_runs(text.encode(), width)
                    held.append((np.full(len(b), doc, np.int64), np.full(len(b), tie, np.int64), b, *rest))
                    n += len(b)
                if n > 600_000:
                    yield from emit(held)
                    held, n = [], 0
        if held:
            yield from emit(held)

    return docs.select("doc", "tie", "text").mapInArrow(run, RUNS)


FOUND = "doc bigint, tie bigint, b int, e int, h bigint, repeat boolean"


def judged(rows: DataFrame) -> DataFrame:
    """Repeated runs (repeat), and the earliest of each of the different runs of one anchor (not repeat). Unique anchors go.

    One shuffle by anchor, a spilling sort, and one streaming pass that holds a batch, whatever a group's size.
    """
    out = arrow_schema(rows.sparkSession, FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_h = last_c = last_c2 = waiting = lead = None  # of the open group: anchor, run hashes, its only run so far, first equal run
        kinds = 0
        for batch in batches:
            local = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            doc, tie, b, e = (batch.column(i).to_numpy() for i in range(4, 8))
            rest = np.flatnonzero(~local)
            h = batch.column(1).to_numpy(zero_copy_only=False)[rest].astype(np.int64) if not local.any() else batch.column(1).fill_null(0).to_numpy()[rest]
            c, c2 = (batch.column(i).fill_null(0).to_numpy()[rest] for i in (2, 3))
            d, t, bb, ee = doc[rest], tie[rest], b[rest], e[rest]
            parts = [(doc[local], tie[local], b[local], e[local], np.zeros(local.sum(), np.int64), True)]
            if len(h):
                goes_on = last_h is not None and h[0] == last_h
                new_h = np.r_[not goes_on, h[1:] != h[:-1]]
                new_c = new_h | np.r_[not (goes_on and c[0] == last_c and c2[0] == last_c2), (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])]
                group = np.cumsum(new_h) - (0 if goes_on else 1)
                n = np.bincount(group, new_c).astype(int)
                if goes_on:
                    n[0] += kinds
                    if kinds == 1 and n[0] > 1:
                        parts.append((*([x] for x in waiting), False))
                first = new_c & (n[group] > 1)
                of = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), -1))
                same = (of < 0) & (np.array([lead == x for x in zip(d, t, bb)]) if of[0] < 0 else False)
                same |= (of >= 0) & (d == d[of]) & (t == t[of]) & (bb == bb[of])
                again = ~new_c & ~same  # a repeated row is the same run, not a repeat
                if of[-1] >= 0:
                    lead = (d[of[-1]], t[of[-1]], bb[of[-1]])
                parts.append((d[again], t[again], bb[again], ee[again], h[again], True))
                parts.append((d[first], t[first], bb[first], ee[first], h[first], False))
                last_h, last_c, last_c2, kinds = h[-1], c[-1], c2[-1], int(n[-1])
                if kinds == 1 and new_c[group == group[-1]].any():
                    i = np.flatnonzero((group == group[-1]) & new_c)[0]
                    waiting = (d[i], t[i], bb[i], ee[i], h[i])
            for *cols, flag in parts:
                if len(cols[0]):
                    yield pa.record_batch([*(pa.array(x, ty) for x, ty in zip(cols, out.types)), pa.array([flag] * len(cols[0]))], schema=out)

    return rows.repartition("key").sortWithinPartitions("key", "c", "c2", "doc", "tie", "b").mapInArrow(run, FOUND)


def suffix_ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of bytes x by Larsson-Sadakane refinement, and ranks.

    Suffixes are sorted to their ends: Kasai's step holds only in a full order. Ranks of 8-byte prefixes come from one sort of packed words. Then groups of equal rank, and only those, are sorted
    by the rank that stands as far ahead as the sorted prefix is long, which doubles it.
    """
    n = len(x)
    padded = np.r_[x, np.zeros(8, np.uint8)].astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n]
    sa = np.argsort(word, kind="stable").astype(np.int32)
    sorted_word = word[sa]
    head = np.r_[True, sorted_word[1:] != sorted_word[:-1]]
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0)).astype(np.int32)
    rank = np.empty(n + 1, np.int32)
    rank[sa], rank[n] = start, -1
    alone = head & np.r_[head[1:], True]
    todo = np.flatnonzero(~alone)  # places in sa that lie in unsorted groups
    h = 8
    while len(todo):
        i = sa[todo]
        ahead = rank[np.minimum(i.astype(np.int64) + h, n)].astype(np.int64) + 1
        own = rank[i].astype(np.int64)
        key = (own << 32) | ahead
        order = np.argsort(key, kind="stable")
        i, key = i[order], key[order]
        sa[todo] = i  # groups keep their places, as the own rank leads
        head = np.r_[True, key[1:] != key[:-1]]
        start = np.maximum.accumulate(np.where(head, todo, 0))
        rank[i] = start
        todo = todo[~(head & np.r_[head[1:], True])]
        h *= 2
    return sa, rank


def common_prefixes(x: np.ndarray, sa: np.ndarray, lanes: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """Kasai: for each place in sa, the bytes (``most`` at most) that its suffix shares with the one before.

    All texts (lanes: first byte, length) advance together. From one byte to the next a suffix keeps all but one of
    its common bytes, so only the rest is compared, eight bytes at a time.
    """
    n = len(x)
    before = np.empty(n, np.int32)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    pad = np.r_[x, np.zeros(most + 8, np.uint8)]
    out = np.zeros(n, np.int16)
    keep = np.zeros(len(lanes), np.int64)
    order = np.argsort(-length, kind="stable")
    lanes, length = lanes[order], length[order]
    for t in range(int(length[0]) if len(length) else 0):
        active = int(np.searchsorted(-length, -t, side="left"))
        i = lanes[:active] + t
        j = before[i].astype(np.int64)
        m = np.where(j >= 0, np.maximum(keep[:active] - 1, 0), 0)
        live = np.flatnonzero((j >= 0) & (m < most))
        while len(live):
            same = pad[i[live] + m[live]] == pad[j[live] + m[live]]
            live = live[same]
            m[live] += 1
            live = live[m[live] < most]
        keep[:active] = m
        out[i] = m
    return out[sa]


def shard_repeats(owner: list[tuple[int, int]], at: list[int], texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a shard's runs: text, start in text, whether an equal window is earlier."""
    length = np.array([len(t) for t in texts], np.int64)
    first = np.r_[0, np.cumsum(length + 1)[:-1]]
    x = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    sa, _ = suffix_ranks(x)
    lcp = common_prefixes(x, sa, first, length, width)
    lane = np.searchsorted(first, sa, side="right") - 1
    offset = sa - first[lane]
    whole = offset + width <= length[lane]
    group = np.cumsum(lcp < width)  # equal windows are neighbours
    lane, offset, group = lane[whole], offset[whole], group[whole]
    doc, tie = (np.array(v, np.int64) for v in zip(*owner))
    start = np.array(at, np.int64)[lane] + offset
    order = np.lexsort((start, tie[lane], doc[lane], group))
    group = group[order]
    return lane[order], offset[order], np.r_[False, group[1:] == group[:-1]]


REPEATS = "doc bigint, tie bigint, b int, e int"


def ranges_of(lane, offset, owner, at):
    """Rows (doc, tie, b, e) of windows, neighbours joined."""
    order = np.lexsort((offset, lane))
    lane, offset = lane[order], offset[order]
    cut = np.r_[True, (lane[1:] != lane[:-1]) | (offset[1:] != offset[:-1] + 1)] if len(lane) else np.empty(0, bool)
    first = np.flatnonzero(cut)
    last = np.r_[first[1:] - 1, len(lane) - 1] if len(first) else first
    return [(*owner[k], at[k] + a, at[k] + b) for k, a, b in zip(lane[first].tolist(), offset[first].tolist(), offset[last].tolist())]


def run_repeats(found: DataFrame, docs: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """Repeated windows among the different runs of one anchor."""
    spark = found.sparkSession
    many = found.where("not repeat")
    by_anchor = many.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("b") + width).alias("bytes"))
    most = max(1, shard_bytes // (2 * (2 * width)))  # runs of one anchor in one shard
    total, hot_windows = by_anchor.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") > most, F.col("bytes") - F.col("n") * (width - 1))), F.lit(0))).first()
    shards = max(1, -(-total // shard_bytes))
    splitters = evenly(max(1, -(-hot_windows // (shard_bytes // PACKED.itemsize))))
    hot = by_anchor.where(F.col("n") > most).select("h", F.ceil(F.col("n") / most).cast("bigint").alias("k"))
    # an anchor may hold a large part of all runs, so runs meet the hot anchors by a part of their own place as well
    parts = 16
    many = many.withColumn("part", F.pmod(F.xxhash64("doc", "tie", "b", F.lit(1)), F.lit(parts)))
    hot = hot.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).hint("merge")
    spread = many.join(hot, ["h", "part"], "left").withColumn("salt", F.when(F.col("k").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc", "tie", "b"), F.col("k"))))
    spread = spread.select("doc", "tie", "b", "e", F.col("k").isNotNull().alias("hot"), F.pmod(F.xxhash64("h", "salt"), F.lit(shards)).alias("shard"))
    wanted = spread.groupBy("doc", "tie").agg(F.collect_list(F.struct("b", "e", "hot", "shard")).alias("runs"))
    cut_schema = "shard bigint, doc bigint, tie bigint, b int, hot boolean, bytes binary"
    cut_out = arrow_schema(spark, cut_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.columns, batch.num_rows):
                rows = []
                for doc, tie, text, parts in zip(*(c.slice(lo, hi - lo).to_pylist() for c in batch.columns)):
                    raw = text.encode()
                    rows += [(r["shard"], doc, tie, r["b"], r["hot"], raw[r["b"] : r["e"] + width]) for r in parts]
                for k in range(0, len(rows), 20_000):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 20_000]), cut_out.types)], schema=cut_out)

    bytes_of = docs.select("doc", "tie", "text").join(wanted, ["doc", "tie"]).select("doc", "tie", "text", "runs").mapInArrow(cut, cut_schema)
    both = REPEATS + ", slice bigint, windows binary"

    def shard(_, cols):
        doc, tie, b, hot, raw = cols
        seen: dict = {}
        for i, key in enumerate(zip(doc, tie, b)):  # a repeated row gives its runs twice
            seen.setdefault(key, i)
        pick = list(seen.values())
        owner, at, texts = [(doc[i], tie[i]) for i in pick], [b[i] for i in pick], [raw[i] for i in pick]
        lane, offset, again = shard_repeats(owner, at, texts, width)
        rows = [(*r, None, None) for r in ranges_of(lane[again], offset[again], owner, at)]
        mine = ~again & np.array([hot[i] for i in pick])[lane]
        if mine.any():  # the earliest of each window goes on to meet other shards'
            rows += [(None, None, None, None, k, w) for k, w in cut_windows(lane[mine], offset[mine], owner, at, texts, width, splitters)]
        return rows

    found_here = stored(map_groups(bytes_of, "shard", shard, both), "shard-repeats")
    repeats = found_here.where("windows is null").select("doc", "tie", "b", "e")
    apart = found_here.where("windows is not null").select("slice", "windows")
    if not apart.limit(1).count():
        return repeats
    return repeats.union(map_groups(apart, "slice", merged, REPEATS))


PACKED = np.dtype([("high", "<u8"), ("low", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("b", "<i4")])


def evenly(n: int) -> np.ndarray:
    """n - 1 splitters that part the 64-bit words into n equal ranges."""
    return np.array([(i << 64) // n for i in range(1, n)], np.uint64)


def cut_windows(lane, offset, owner, at, texts, width: int, splitters: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(slice, packed windows): a shard's windows, sorted by hash and cut at the splitters by binary search."""
    import xxhash

    x = np.empty(len(lane), PACKED)
    digest = b"".join([xxhash.xxh3_128_digest(texts[k][o : o + width]) for k, o in zip(lane.tolist(), offset.tolist())])
    x["high"], x["low"] = np.frombuffer(digest, "<u8").reshape(-1, 2).T
    doc, tie = (np.array(v, np.int64) for v in zip(*owner))
    x["doc"], x["tie"], x["b"] = doc[lane], tie[lane], np.array(at, np.int64)[lane] + offset
    x = x[np.argsort(x["high"], kind="stable")]
    edges = [0, *np.searchsorted(x["high"], splitters).tolist(), len(x)]
    return ((k, x[lo:hi].tobytes()) for k, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo)


def merged(_, cols) -> list[tuple[int, int, int, int]]:
    """Windows of one slice, from all shards, that also occur earlier."""
    x = np.frombuffer(b"".join(cols[0]), PACKED)
    x = x[np.lexsort((x["b"], x["tie"], x["doc"], x["low"], x["high"]))]
    again = np.r_[False, (x["high"][1:] == x["high"][:-1]) & (x["low"][1:] == x["low"][:-1])]
    return [(d, t, b, b) for d, t, b in zip(*(x[c][again].tolist() for c in ("doc", "tie", "b")))]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 100, shard_bytes: int = 3_000_000, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes if asked for)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))
    # a repeated row has the same runs at the same places: they are equal to themselves, not repeats
    found = stored(judged(runs(rows.where(F.octet_length("text") >= width), width)), "runs")
    repeats = found.where("repeat").select("doc", "tie", "b", "e").union(run_repeats(found, rows, width, shard_bytes))
    of_doc = repeats.groupBy("doc", "tie").agg(F.collect_list(F.struct("b", "e")).alias("ranges"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_bytes binary" * with_text
    out = arrow_schema(spark, schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.columns, batch.num_rows):
                got = []
                part = batch.slice(lo, hi - lo)
                ranges = part.column(2)
                values = ranges.flatten()
                begins, ends = (values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                at = 0
                for doc_id, text, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), pa.compute.fill_null(pa.compute.list_value_length(ranges), 0).to_pylist()):
                    raw = text.encode()
                    if not n:
                        got.append((doc_id, len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw))
                        continue
                    cover = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(cover, begins[at : at + n], 1)
                    np.add.at(cover, ends[at : at + n] + width, -1)
                    at += n
                    gone = np.cumsum(cover[:-1]) > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    got.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*got), out.types)], schema=out)

    return rows.join(of_doc, ["doc", "tie"], "left").select("doc_id", "text", "ranges").mapInArrow(apply, schema)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: The same rows in DuckDB, by all windows in hexadecimal.
ORACLE_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT doc_id, unnest(list_transform(range(0, length(h) // 2 - 99), lambda i: {'i': i, 'k': md5_number(substr(h, 2 * i + 1, 200))}), recursive := true) FROM d),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
    m AS (SELECT doc_id, i, coalesce(CAST(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 AS INT), 1) AS opens FROM r),
    g AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
    s AS (SELECT doc_id, min(i) AS b, max(i) + 100 AS e FROM g GROUP BY doc_id, run),
    o AS (SELECT doc_id, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS p FROM s),
    k AS (SELECT o.doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * p + 1, 2 * (b - p)), '' ORDER BY b) || substr(any_value(h), 2 * max(e) + 1) AS kept
        FROM o JOIN d ON d.doc_id = o.doc_id GROUP BY o.doc_id)
    SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
        sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
