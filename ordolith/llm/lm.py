"""Operator 3: language-model scores by subword lattice likelihood.

A text may be written by any segmentation into pieces of an existing vocabulary; the forward recursion over its
lattice adds the probabilities of all of them. Piece weights are the vocabulary's own scores (ranks, read as a Zipf
law); the share of ends among all training tokens is the weight of the end, one token after the last word. No piece
spans two words, so the document's marginal probability is the product over its words and its end.

A learned model takes those weights as its prior: pieces' expected numbers in the distinct training words, by one
forward-backward pass, are added to it, and each word seen in training is one more arc over its whole lattice, which
takes its count less a discount; the share taken off is what the lattice spreads over all words. ``base_score`` is the
contract's count model beside it.

Work grows with distinct words, not with tokens: counts of all words are gathered with a map-side combine, the lattice
runs once per distinct word, and documents meet their words in two ways. Words with at least a 2**-17 share of all
tokens, of which there can be no more than 2**17, are broadcast and summed in place; all others are rare by that
definition, so joining them by word has no hot key.

Nulls: a null text is an empty text (its end only). A null id counts as not held out. Repeated rows weigh as often as
they occur and each gets its row. With no training rows counts are 0, the end weighs a half and the lattice of the
existing weights is all there is. An empty table gives no rows. Other columns are not read. A word of any length takes memory in proportion to it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, slices, stored, table
from .langid import held_out
from .tokenids import tokenizer_path

PIECES_FILE = "piece_bpe_32k.model"
END = b""
LOG10 = math.log(10)
HOT_BITS = 17
#: Probabilities below this are summed in log space.
TINY = 1e-280


class Lattice:
    """Log weights of pieces; a character that no piece covers is spelt in bytes."""

    def __init__(self, pieces: dict[str, float], byte: float, end: float = 0.0):
        self.pieces, self.byte, self.end = pieces, byte, end
        # what begins a piece without being one: the search for longer ones goes on only there
        self.begun: dict[str, float | None] = {p[:k]: None for p in pieces for k in range(1, len(p))}
        self.begun.update(pieces)
        self.shares = {p: 0.0 if w is None else math.exp(w) for p, w in self.begun.items()}
        self.byte_share = math.exp(byte)

    @classmethod
    def existing(cls, path: str, end_share: float, byte_share: float = 0.01) -> Lattice:
        """From a sentencepiece file: scores are negative ranks, so the weight is that of a Zipf law of the rank.

        Pieces, 256 bytes and the end of a text share the probability of what comes next.
        """
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {sp.id_to_piece(i): -math.log(2.7 - sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        rest = math.log1p(-end_share)
        total = math.log(sum(map(math.exp, found.values()))) - math.log1p(-byte_share) - rest
        return cls({p: w - total for p, w in found.items()}, math.log(byte_share / 256) + rest, math.log(end_share))

    def log_p(self, word: str) -> float:
        """Natural log of the sum over all segmentations of the word (with its boundary mark): forward recursion."""
        s = "▁" + word
        p = self.forward(s)[-1]
        return math.log(p) if p > TINY else self.log_forward(s)[-1]

    def forward(self, s: str) -> list[float]:
        """The probability of each beginning of ``s``; it never grows, so where the whole's isn't tiny none that matters was."""
        n, get = len(s), self.shares.get
        into = [1.0] + [0.0] * n
        for i in range(n):
            a = into[i]
            if get(s[i], 0.0) == 0.0:
                into[i + 1] += a * self.byte_share ** len(s[i].encode("utf-8", "replace"))
            for j in range(i + 1, n + 1):
                w = get(s[i:j], -1.0)
                if w < 0:
                    break
                into[j] += a * w
        return into

    def log_forward(self, s: str) -> list[float]:
        """The same in log space."""
        into: list[list[float]] = [[] for _ in range(len(s) + 1)]
        into[0].append(0.0)
        out = []
        for i, xs in enumerate(into):
            out.append(log_sum(xs))
            for j, _, _, w in self.arcs(s, i):
                into[j].append(out[i] + w)
        return out

    def arcs(self, s: str, i: int) -> Iterator[tuple[int, str, int, float]]:
        """(end, piece, times, log weight) of what may be written next at place i; the empty piece is a byte."""
        if i < len(s) and self.begun.get(s[i]) is None:
            k = len(s[i].encode("utf-8", "replace"))
            yield i + 1, "", k, k * self.byte
        for j in range(i + 1, len(s) + 1):
            w = self.begun.get(s[i:j], 1.0)
            if w is None:
                continue
            if w > 0:
                break
            yield j, s[i:j], 1, w

    def add_expected(self, word: str, to: dict[str, float]) -> None:
        """Adds how often each piece, and a byte, is expected in the word: the mean over its segmentations."""
        s = "▁" + word
        n, get = len(s), self.shares.get
        into = self.forward(s)
        if into[n] <= TINY:
            logs = self.log_forward(s)
            rest = [0.0] * (n + 1)
            for i in reversed(range(n)):
                found = [(piece, k, w + rest[j]) for j, piece, k, w in self.arcs(s, i)]
                rest[i] = log_sum([x for _, _, x in found])
                for piece, k, x in found:
                    to[piece] += k * math.exp(logs[i] + x - logs[n])
            return
        after = [0.0] * n + [1 / into[n]]
        for i in reversed(range(n)):
            a, total = into[i], 0.0
            if get(s[i], 0.0) == 0.0:
                k = len(s[i].encode("utf-8", "replace"))
                total = self.byte_share**k * after[i + 1]
                to[""] += k * a * total
            for j in range(i + 1, n + 1):
                piece = s[i:j]
                w = get(piece, -1.0)
                if w < 0:
                    break
                if w:
                    x = w * after[j]
                    total += x
                    to[piece] += a * x
            after[i] = total

    def learned(self, expected: dict[str, float]) -> Lattice:
        """Its weights as a prior that counts as much as one number a piece, and the expected numbers added."""
        kept = math.log1p(-math.exp(self.end))
        prior = len(self.pieces)
        total = math.fsum(expected.values()) + prior
        weight = lambda n, w: math.log(n + prior * math.exp(w - kept)) - math.log(total) + kept
        return Lattice({p: weight(expected.get(p, 0.0), w) for p, w in self.pieces.items()}, weight(expected.get("", 0.0) / 256, self.byte), self.end)


def log_sum(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum([math.exp(x - m) for x in xs]))


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, trained, all): tokens of all documents, the end as the empty word; each task sums first."""
    schema = "word binary, trained bigint, every bigint"
    out = arrow_schema(docs.sparkSession, schema)

    def emit(trained: Counter, other: Counter):
        for c, t in ((trained, 1), (other, 0)):
            words, n = list(c), np.fromiter(c.values(), np.int64, len(c))
            for lo in range(0, len(words), 1 << 17):
                part = n[lo : lo + (1 << 17)]
                yield pa.record_batch([pa.array(words[lo : lo + (1 << 17)], pa.binary()), pa.array(part * t), pa.array(part)], schema=out)
            c.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, other = Counter(), Counter()
        for batch in batches:
            for lo, hi in slices(batch.columns, batch.num_rows):
                texts, held = (c.slice(lo, hi - lo).to_pylist() for c in batch.columns)
                for c, flag in ((trained, False), (other, True)):
                    mine = [(t or "").encode().lower() for t, h in zip(texts, held) if h is flag]
                    if mine:
                        c.update(b" ".join(mine).split())
                        c[END] += len(mine)
                if len(trained) + len(other) > 400_000:
                    yield from emit(trained, other)
        yield from emit(trained, other)

    return docs.select("text", "held_out").mapInArrow(run, schema).groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("every").alias("every"))


def expected_pieces(words: DataFrame, lattice: Lattice) -> dict[str, float]:
    """How often each piece is expected in the distinct training words; a task sends one row a piece at most."""
    model = words.sparkSession.sparkContext.broadcast(lattice)
    schema = "piece string, expected double"
    out = arrow_schema(words.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: defaultdict[str, float] = defaultdict(float)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                model.value.add_expected(word.decode("utf-8", "replace"), sums)
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], schema=out)

    found = words.where((F.col("trained") > 0) & (F.length("word") > 0)).select("word").mapInArrow(run, schema)
    return {r.piece: r.expected for r in found.groupBy("piece").agg(F.sum("expected").alias("expected")).collect()}  # the vocabulary's size at most


def score_words(words: DataFrame, lattice: Lattice, n: int, v: int, discount: float | None = None) -> DataFrame:
    """Per distinct word its log10 base term and its log10 probability; known: it was trained.

    Without a discount that is the lattice's. With one, a word has its count less the discount among ``n``, and the
    lattice spreads what was taken off the ``v`` words.
    """
    model = words.sparkSession.sparkContext.broadcast(lattice)
    schema = "word binary, every bigint, known bigint, base double, score double"
    out = arrow_schema(words.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(1).to_numpy().astype(float)
            lattice = model.value
            log_p = np.array([lattice.log_p(w.decode("utf-8", "replace")) if w else lattice.end for w in batch.column(0).to_pylist()])
            base = np.log10((c + 1) / (n + v + 1))
            if discount is not None and n:
                with np.errstate(divide="ignore"):  # of a new word nothing but its lattice counts
                    log_p = np.logaddexp(np.log(np.maximum(c - discount, 0) / n), math.log(discount * v / n) + log_p)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array((c > 0).astype(np.int64)), pa.array(base), pa.array(log_p / LOG10)], schema=out)

    return words.mapInArrow(run, schema)


def score_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", learned: bool = False) -> DataFrame:
    """``docs`` has ``held_out``; rows that are not held out train. One row per document.

    ``learned``: score by the model learned from them, else by the vocabulary's existing weights.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "held_out")
    words = stored(count_words(docs), "word-counts")
    zero = F.lit(0)
    number = lambda c: F.count(F.when(c, 1))
    total = lambda c: F.coalesce(F.sum(c), zero)
    trained = F.col("trained")
    n, v, tokens, ends, once, twice = words.agg(total("trained"), number(trained > 0), total("every"), total(F.when(F.length("word") == 0, trained)), number(trained == 1), number(trained == 2)).first()
    lattice, discount = Lattice.existing(path, (ends + 1) / (n + 2)), None
    if learned:
        lattice = lattice.learned(expected_pieces(words, lattice))
        discount = (once + 1) / (once + 2 * twice + 2)  # Good and Turing's, between 0 and 1 whatever there is
    scored = stored(score_words(words, lattice, n, v, discount), "word-scores")
    hot_rows = scored.where(F.col("every") * (1 << HOT_BITS) >= tokens).select("word", "known", "base", "score").toArrow()  # 2**17 at most
    hot = spark.sparkContext.broadcast({w: i for i, w in enumerate(hot_rows["word"].to_pylist())})
    values = spark.sparkContext.broadcast(np.stack([hot_rows[c].to_numpy().astype(float) for c in ("known", "base", "score")] if hot_rows.num_rows else np.zeros((3, 1))))

    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<binary>, times array<int>"
    out = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, place, table_of = TaskContext.get().partitionId() << 33, hot.value.get, values.value
        for batch in batches:
            for lo, hi in slices(batch.columns, batch.num_rows):
                got = []
                for doc_id, text, held in zip(*(c.slice(lo, hi - lo).to_pylist() for c in batch.columns)):
                    tokens = (text or "").encode().lower().split() + [END]
                    at = np.array(list(map(place, tokens)), float)  # None: nan
                    rare = Counter(t for t, p in zip(tokens, np.isnan(at).tolist()) if p) if np.isnan(at).any() else {}
                    s = table_of[:, at[~np.isnan(at)].astype(np.int64)].sum(1)
                    got.append((row, doc_id, held, len(tokens), int(s[0]), s[1], s[2], list(rare), list(rare.values())))
                    row += 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*got), out.types)], schema=out)

    parts = stored(docs.mapInArrow(run, schema), "lm-parts")
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    cold = scored.where(F.col("every") * (1 << HOT_BITS) < tokens).select("word", "known", "base", "score")
    none = F.lit(None)
    sums = rare.join(cold, "word").select("row", none.cast("bigint").alias("doc_id"), none.cast("boolean").alias("held_out"), none.cast("bigint").alias("n_tokens"), (F.col("known") * F.col("k")).alias("n_known"), (F.col("base") * F.col("k")).alias("base"), (F.col("score") * F.col("k")).alias("score"))
    both = parts.drop("rare", "times").unionByName(sums).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return both.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 7, 2))
    return score_documents(docs, tokenizer_path(PIECES_FILE), learned=True)
