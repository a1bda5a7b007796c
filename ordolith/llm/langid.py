"""Operator 2: language identification by multilingual mixture inference.

Training counts letter trigrams (with word boundaries) per language, hashed to a fixed number of buckets, over all
training documents; the counts are summed by Spark, and the model on the driver is languages x buckets, whatever the
input. Prediction takes each word's likelihood under each language and runs expectation-maximisation on every
document's language proportions. The language set is selected by penalised likelihood: of the nested sets of
likeliest languages, the one with the largest log-likelihood less half of log(words) for each further language. The
prediction is the set's most frequent language, and the score its proportion in the mixture of all languages.

Nulls: a null text, or one without letters, is ``und`` with score 0. Rows with a null text or language do not train.
A null id counts as trained and not held out. With no training rows at all everything is ``und``. Repeated rows
weigh as often as they occur, and rows are predicted by their own text, whatever their id. Ties go to the language that
sorts first. An empty table gives no rows. Other columns are not read. Texts of any length are taken whole; memory is a
bounded number of texts, or one. More than ``MOST`` learned languages are an error, as the model grows with them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, free, slices, table

BITS = 17
MOST = 512
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for what is no letter; built once a process."""
    if not _LETTERS:
        t = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _LETTERS.append(t)
    return _LETTERS[0]


def encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, a 0 after each text, and the place where each text begins (with the end)."""
    flat = np.frombuffer(("\n".join(t or "" for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum([0] + [len(t or "") + 1 for t in texts])
    return letters()[np.minimum(flat, 0x10FFFF)], begin


def trigrams(c: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of letters, and the bucket of the trigram around each."""
    at = np.flatnonzero(c)
    wide = c.astype(np.uint64)
    before = np.where(at > 0, wide[np.maximum(at - 1, 0)], 0)
    x = (before << np.uint64(42)) | (wide[at] << np.uint64(21)) | wide[np.minimum(at + 1, len(c) - 1)]
    return at, ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


def trigram_counts(docs: DataFrame, bits: int) -> DataFrame:
    """(lang, bucket, n) of documents (text, lang): summed in each task first."""
    schema = "lang string, bucket int, n bigint"
    out = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = defaultdict(lambda: np.zeros(1 << bits, np.int64))
        for batch in batches:
            for lo, hi in slices(batch.columns, batch.num_rows, 1 << 20):
                texts, langs = (c.slice(lo, hi - lo).to_pylist() for c in batch.columns)
                c, begin = encoded(texts)
                at, bucket = trigrams(c, bits)
                names, lang_of = np.unique(np.array(langs, object).astype(str), return_inverse=True)
                doc = np.repeat(lang_of, np.diff(begin))[at]
                n = np.bincount(doc * (1 << bits) + bucket, minlength=len(names) << bits).reshape(len(names), -1)
                for k, name in enumerate(names):
                    total[str(name)] += n[k]
        for name, n in total.items():
            b = np.flatnonzero(n)
            yield pa.record_batch([pa.array([name] * len(b)), pa.array(b, pa.int32()), pa.array(n[b], pa.int64())], schema=out)

    return docs.mapInArrow(run, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-likelihoods of trigram buckets: float32 [bucket, language]."""

    def __init__(self, rows, bits: int, smoothing: float = 0.2):
        self.langs, lang = np.unique(np.asarray(rows.lang, dtype=object).astype(str), return_inverse=True) if len(rows) else (np.array([], str), np.array([], int))
        self.bits = bits
        n = np.full((1 << bits, max(1, len(self.langs))), smoothing)
        np.add.at(n, (rows.bucket.to_numpy(int), lang), rows.n.to_numpy(float))
        self.log_p = np.log(n / n.sum(0)).astype(np.float32)


def proportions(like: np.ndarray, first: np.ndarray, size: np.ndarray, allowed: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """EM: language proportions of each document, and its log-likelihood. ``like``: words x languages, log.

    first, size: each document's words (none empty). allowed: documents x languages.
    """
    top = like.max(1, keepdims=True)
    p = np.exp(like - top)
    pi = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        r = p * np.repeat(pi, size, axis=0)
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        pi = np.add.reduceat(r, first, axis=0) / size[:, None]
    mass = np.maximum((p * np.repeat(pi, size, axis=0)).sum(1), 1e-300)
    return pi, np.add.reduceat(np.log(mass) + top[:, 0], first)


def infer(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """The likeliest language of each text's selected set, and its proportion among all languages."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not len(model.langs):
        return names, scores
    c, begin = encoded(texts)
    at, bucket = trigrams(c, model.bits)
    if not len(at):
        return names, scores
    starts = np.flatnonzero(np.r_[True, np.diff(at) > 1])  # words: runs of letters
    like = np.add.reduceat(model.log_p[bucket], starts, axis=0).astype(np.float64)
    doc_of = np.searchsorted(begin, at[starts], side="right") - 1
    docs, first, size = np.unique(doc_of, return_index=True, return_counts=True)
    k = like.shape[1]
    pi, full = proportions(like, first, size, np.ones((len(docs), k)))
    single = np.add.reduceat(like, first, axis=0)
    best = single.argmax(1)
    penalty = 0.5 * np.log(size + 1.0) + 2.0
    value = single.max(1)
    # a set of two or more beats one language only if all languages together, the largest set, gain a penalty
    mixed = np.flatnonzero(full - value > penalty)
    if k > 1 and len(mixed):
        words = np.concatenate([np.arange(first[d], first[d] + size[d]) for d in mixed])
        sub, sub_size = like[words], size[mixed]
        sub_first = np.r_[0, np.cumsum(sub_size)[:-1]]
        rank = np.argsort(np.argsort(-pi[mixed], axis=1, kind="stable"), axis=1)
        most = int((pi[mixed] > 1e-3).sum(1).max())
        for m in range(2, min(k, max(2, most)) + 1):
            p, ll = (pi[mixed], full[mixed]) if m == k else proportions(sub, sub_first, sub_size, (rank < m).astype(float))
            better = ll - (m - 1) * penalty[mixed] > value[mixed]
            d = mixed[better]
            value[d] = (ll - (m - 1) * penalty[mixed])[better]
            best[d] = p[better].argmax(1)
    score = pi[np.arange(len(docs)), best]
    for d, b, s in zip(docs.tolist(), best.tolist(), score.tolist()):
        names[d], scores[d] = str(model.langs[b]), min(1.0, max(0.0, s))
    return names, scores


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, train: DataFrame, *, text_col: str = "text", carry: tuple[str, ...] = ("doc_id", "held_out"), bits: int = BITS) -> DataFrame:
    """Adds lang_pred and score to the ``carry`` columns; ``train`` has text and lang."""
    usable = train.where("text is not null and lang is not null").select("text", "lang")
    if (n := usable.select("lang").distinct().limit(MOST + 1).count()) > MOST:
        raise ValueError(f"{n} languages or more to learn; the model holds {MOST}")
    rows = trigram_counts(usable, bits).toPandas()  # languages x 2**bits rows at most
    model = docs.sparkSession.sparkContext.broadcast(Model(rows, bits))
    picked = docs.select(*carry, F.col(text_col).alias(free("_text", carry)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema[:-1]) + ", lang_pred string, score double"
    out = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.columns, batch.num_rows, 1 << 20):
                part = batch.slice(lo, hi - lo)
                names, scores = infer(part.column(part.num_columns - 1).to_pylist(), model.value)
                yield pa.record_batch([*part.columns[:-1], pa.array(names), pa.array(scores, pa.float64())], schema=out)

    return picked.mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 3, 1))
    return identify(docs, docs.where("not held_out"))
