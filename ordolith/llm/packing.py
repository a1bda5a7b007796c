"""Operator 4: vector best-fit packing of tokenised documents into sequences of bounded length.

Three capacities hold for every sequence: tokens, documents (pieces) and attention cost (sum of squared piece
lengths). A piece's demand depends on its length alone, and lengths are whole numbers up to the token capacity,
so packing N pieces is packing a histogram of at most ``tokens`` lengths: ``plan`` fills one sequence at a time with
the fitting length that leaves the smallest weighted residual norm (or has the largest weighted dot product
with what is left), and repeats each filling as often as its lengths last. Every filling exhausts a length, so the
plan has at most as many fillings as there are lengths, whatever N. Pieces then find their place by their rank
among pieces of equal length, which is counted without collecting or sorting them in one task.

Only documents longer than the token capacity are cut, into full pieces, the first of which may be shorter.

Nulls: a null text is an empty text (one end token); a null id is kept. Repeated rows are packed as often as they occur,
and rows that share an id keep their own pieces. Ties: pieces of one length are alike to the plan; which of them goes
where depends on the order in which tasks read them, the number of sequences doesn't. An empty table gives no rows.
Columns other than id and text are not read. A text of any length is held whole, with its ids.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, arrow_schema, held, slices, stored, table
from .tokenids import END, Pieces, tokenizer_path

BYTES_FILE = "byte_bpe_50k.json"


class ByteEncoder:
    """Ids of a text under the byte-level tokenizer, by remembered words.

    The tokenizer's splitting rule always starts a new piece at a single space or line end that stands between
    two other characters, so such texts are split there and each word (with its leading space) is encoded once.
    Texts with other white space, or with what may be a special token, go to the tokenizer whole.
    """

    #: White space that never stands between two words of a text that is split.
    ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["  ", " \n", "\n ", "\n\n", "<|"]

    def __init__(self, path: str):
        pieces = Pieces(path, "I", lower=False)
        self.whole = pieces.whole
        self.first = Memo(lambda w: pieces(w, self.first.__getitem__), 50_000)
        self.inner = Memo(lambda w: pieces(w, self.inner.__getitem__, " "), 400_000)
        self.newline, self.end = self.whole("\n"), array("I", [END]).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if text[0].isspace() or text[-1].isspace() or any([c in text for c in self.ODD]):
            return self.whole(text) + self.end
        parts, inner = [], self.inner.__getitem__
        for line in text.split("\n"):
            words = line.split(" ")
            parts.append(self.first[words[0]])
            parts.extend(map(inner, words[1:]))
            parts.append(self.newline)
        parts[-1] = self.end
        return b"".join(parts)


def byte_encoder(path: str) -> ByteEncoder:
    return held("bytes " + path, lambda: ByteEncoder(path))


class Capacity(NamedTuple):
    """What one sequence holds at most. At the defaults a sequence of very short pieces is closed by their number;
    the attention cost admits one piece of all tokens, and so binds only where it is set lower."""

    tokens: int = 1024
    documents: int = 64
    cost: int = 1024 * 1024


class Step(NamedTuple):
    """Pieces of one length with ranks first .. first + bins * per go to sequences bin .., ``per`` to each, from ``offset`` on."""

    length: int
    first: int
    per: int
    bin: int
    bins: int
    offset: int


def fill(left: Counter, cap: Capacity, weights: tuple[float, float, float], rule: str) -> Counter:
    """One sequence: of the lengths that are left and meet every residual capacity, the best one, again and again."""
    lengths = np.array(sorted(k for k, v in left.items() if v), np.int64)
    count = np.array([left[k] for k in lengths.tolist()], np.int64)
    scale = np.array(cap, float)
    demand = np.stack([lengths, np.ones_like(lengths), lengths * lengths], 1)
    residual, used = np.array(cap, np.int64), Counter()
    w = np.array(weights)
    while True:
        fits = (demand <= residual).all(1) & (count > 0)
        if not fits.any():
            return used
        if rule == "dot":
            score = ((demand / scale) * (residual / scale) * w).sum(1)
        else:
            score = -(((residual - demand) / scale) ** 2 * w).sum(1)
        best = int(np.flatnonzero(fits)[np.argmax(score[fits])])
        used[int(lengths[best])] += 1
        count[best] -= 1
        residual = residual - demand[best]


def plan(histogram: dict[int, int], cap: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> list[Step]:
    """Steps that place every piece of the histogram; at most ``cap.tokens`` fillings, so the size is bounded."""
    left, steps, ranks, bins = Counter({k: v for k, v in histogram.items() if v > 0}), [], Counter(), 0
    for k in left:
        if k > cap.tokens or k * k > cap.cost or cap.documents < 1:
            raise ValueError(f"a piece of {k} tokens exceeds the capacity {cap}")
    while left:
        pattern = fill(left, cap, weights, rule)
        times = min(left[k] // v for k, v in pattern.items())
        offset = 0
        for k, v in sorted(pattern.items(), reverse=True):
            steps.append(Step(k, ranks[k], v, bins, times, offset))
            ranks[k] += v * times
            left[k] -= v * times
            offset += k * v
            if not left[k]:
                del left[k]
        bins += times
    return steps


def pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokens: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's rank among those of its task and length; stored."""
    schema = "task int, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, local bigint"
    out = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encode, seen = TaskContext.get().partitionId(), byte_encoder(path), Counter()
        for batch in batches:
            for lo, hi in slices(batch.columns, batch.num_rows):
                rows = []
                for doc_id, text in zip(*(c.slice(lo, hi - lo).to_pylist() for c in batch.columns)):
                    ids = encode(text)
                    n = len(ids) // 4
                    at, piece = 0, 0
                    while at < n:
                        k = (n % tokens or tokens) if piece == 0 else tokens
                        rows.append((task, doc_id, piece, at, k, zlib.crc32(ids[4 * at : 4 * (at + k)]), seen[k]))
                        seen[k] += 1
                        at, piece = at + k, piece + 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    return stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "pieces")


def pack(docs: DataFrame, path: str, cap: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm", *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and offset. The driver sees one number per length, never a piece."""
    cut = min(cap.tokens, int(cap.cost**0.5))
    found = pieces(docs, path, id_col=id_col, text_col=text_col, tokens=cut)
    counts = stored(found.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # cut rows at most
    steps = sorted(plan(histogram, cap, weights, rule), key=lambda s: (s.length, s.first))
    plan_of = np.array(steps, np.int64).reshape(-1, 6)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    # both grow with the input, so neither is broadcast; a key is one task's pieces of one length
    ranked = found.join(before.hint("merge"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("local") + F.col("before")).alias("rank"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    out = arrow_schema(docs.sparkSession, schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length0, first, per, bin0, _, offset = plan_of.T
        start_of = np.searchsorted(length0, np.arange(cut + 2))
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            step = np.empty(len(length), np.int64)
            for k in np.unique(length):
                lo, hi = start_of[k], start_of[k + 1]
                mine = length == k
                step[mine] = lo + np.searchsorted(first[lo:hi], rank[mine], side="right") - 1
            nth = rank - first[step]
            seq, off = bin0[step] + nth // per[step], offset[step] + nth % per[step] * length
            yield pa.record_batch([*batch.columns[:5], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], schema=out)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTES_FILE))
