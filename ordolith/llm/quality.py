"""Operator 10: quality rules with an isolation forest over rule statistics.

Every document gets rule statistics over its whole text. An isolation forest (random splits, each tree on a random
share) is fitted on half of the rows labelled good; short average path lengths mark documents unlike those. The
threshold is calibrated on the other labelled rows: of all thresholds that reject at most ``max_loss`` of their good
ones, the one with the least sum of error rates.

All labelled rows that pass the base rules are used: each good one of the first half grows a tree at least, and each of the
others counts for the threshold. Statistics and verdicts cover every document. Only a caller who names ``fit_rows`` fits
on a sample, the rows with the smallest hash of their id.

Nulls: a null text has no words, so it fails the base rules. Null labels are not used. Without labelled rows of
either kind there is no threshold and the base rules alone decide. Verdicts are by text, so rows that share an id, or
have none, are judged apart, and repeated rows alike; their labels are by id. Several labels for one id: the lowest
quality counts. An empty table gives no rows. Columns other than id and text are not read. A text of any length is
held whole, with a few numbers a word.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import anti_join, arrow_schema, map_docs, mix, stored, table, text_key, windows

NOT_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
CONTINUES = bytes(range(0x80, 0xC0))
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
STATS = "doc_id bigint, tie bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, features array<float>"
#: Rule statistics, and for each the step that would be a clear change of it: splits fall up to one step beyond the rows seen.
FEATURES = {"symbols a word": 1.0, "capitals share": 0.3, "word length": 6.0, "repeated share": 0.3, "duplicate line share": 0.5, "log distinct words over log words": 0.2, "top word share": 0.3}


#: Good labelled rows from which on the forest and its threshold use different ones.
FEW = 40
#: Trees of the forest, and the rows that each grows on where there are as many; beyond TREES * SHARE rows shares grow.
TREES, SHARE = 128, 256
#: Rows up to which the threshold is searched in the driver.
AT_ONCE = 20_000


def repeat_words(h: np.ndarray, k: int = 5) -> int:
    """Words that lie in a k-word window which the text has twice or more."""
    w = windows(h, k)
    if not len(w):
        return 0
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(w), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover) > 0).sum())


def statistics(text: str | None) -> tuple:
    """The five contract statistics, then the features."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) - (len(joined) - len(joined.translate(None, CONTINUES)))
    symbols = len(raw.translate(None, NOT_SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()] if n else []
    dup = len(lines) - len(set(lines))
    h = np.array(array("q", map(hash, words)), np.int64).view(np.uint64) if n else np.empty(0, np.uint64)
    repeated = repeat_words(mix(h)) if n else 0
    if not n:
        return 0, 0, symbols, dup, repeated, [0.0] * len(FEATURES)
    size = max(1, len(joined))
    _, counts = np.unique(h, return_counts=True)
    features = [
        symbols / n,
        len(joined.translate(None, NOT_UPPER)) / size,
        chars / n,
        repeated / n,
        dup / max(1, len(lines)),
        np.log1p(len(counts)) / np.log1p(n),
        counts.max() / n,
    ]
    return n, chars, symbols, dup, repeated, [float(x) for x in features]


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make():
        def f(ids, ties, texts):
            return (ids, ties, *zip(*map(statistics, texts)))

        return f

    text = F.col(text_col)
    return map_docs(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text).alias("tie"), text.alias("text")), STATS, make, ["doc_id", "tie", "text"])


class Forest:
    """Isolation forest in flat arrays: per tree and node the feature, the split, and the path length at a leaf.

    Good rows may not vary at all in a statistic that marks bad ones, so a split is drawn from the range of the
    node's rows widened by ``steps``; what lies beyond all rows then ends in an empty leaf, on a short path.
    """

    def __init__(self, x: np.ndarray, steps: np.ndarray, trees: int = TREES, sample: int = SHARE, seed: int | tuple = 1, depth: int | None = None):
        rng = np.random.default_rng(seed)
        self.steps = np.asarray(steps, float)
        n = min(sample, len(x))
        self.depth = depth or depth_of(n)
        nodes = 2 ** (self.depth + 1)
        self.feature = np.zeros((trees, nodes), np.int16)
        self.split = np.full((trees, nodes), np.inf, np.float32)
        self.length = np.zeros((trees, nodes), np.float32)
        self.norm = max(float(expected_path(np.array([n]))[0]), 1e-9)
        for t in range(trees):
            self.grow(t, 1, x[rng.choice(len(x), n, replace=False)], 0, rng)

    def grow(self, t: int, node: int, x: np.ndarray, depth: int, rng) -> None:
        able = np.flatnonzero(x.max(0) - x.min(0) + self.steps > 0) if len(x) > 1 else ()
        if depth == self.depth or not len(able):
            # a leaf passes its rows down its left spine, so that all paths end at the same depth
            value = depth + expected_path(np.array([len(x)]))[0]
            while True:
                self.length[t, node] = value
                if depth == self.depth:
                    return
                node, depth = 2 * node, depth + 1
        f = int(rng.choice(able))
        cut = np.float32(rng.uniform(x[:, f].min() - self.steps[f], x[:, f].max() + self.steps[f]))
        self.feature[t, node], self.split[t, node] = f, cut
        left = x[:, f] <= cut
        self.grow(t, 2 * node, x[left], depth + 1, rng)
        self.grow(t, 2 * node + 1, x[~left], depth + 1, rng)

    @classmethod
    def joined(cls, feature: np.ndarray, split: np.ndarray, length: np.ndarray, norms: np.ndarray) -> Forest:
        """One forest of trees that have grown apart, to the same depth."""
        forest = cls.__new__(cls)
        forest.feature, forest.split, forest.length = feature, split, length
        forest.depth, forest.norm = feature.shape[1].bit_length() - 2, float(norms.mean())
        return forest

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (- mean path / expected path): near 1 for anomalies, about a half or less for the usual."""
        x, total = np.asarray(x, np.float32), np.zeros(len(x), np.float64)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, self.feature[t, node]] > self.split[t, node])
            total += self.length[t, node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def depth_of(n: int) -> int:
    return max(1, int(np.ceil(np.log2(max(2, n)))))


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = n.astype(float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def calibrate(score: np.ndarray, good: np.ndarray, max_loss: float) -> float:
    """The threshold (reject above it) with the least sum of error rates that loses at most ``max_loss`` of the good rows.

    It lies midway between two scores. Without good or without bad rows nothing is rejected.
    """
    if not good.any() or good.all():
        return np.inf
    cut = np.unique(score)
    cut = np.append((cut[:-1] + cut[1:]) / 2, cut[-1])
    lost = 1 - np.searchsorted(np.sort(score[good]), cut, side="right") / good.sum()
    kept = np.searchsorted(np.sort(score[~good]), cut, side="right") / (~good).sum()
    return least_cost(cut, lost, kept, max_loss)


def least_cost(cut: np.ndarray, lost: np.ndarray, kept: np.ndarray, max_loss: float) -> float:
    cost = np.where(lost <= max_loss, lost + kept, np.inf)
    best = np.flatnonzero(cost == cost.min())
    return float(cut[best[len(best) // 2]])


def sample_rows(labelled: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of their id (ties: id, text key), with that hash as ``place``.

    Only rows of spans of the 32-bit hash that begin before the sample is complete are sorted, so tasks don't send ``n``
    rows each. The last span is found in two levels of at most 2 ** 12 counts.
    """
    rows = stored(labelled.select(F.crc32(F.col("doc_id").cast("string")).alias("place"), "doc_id", "tie", "features", "quality"), "labelled-rows")
    inside, end, left = F.lit(True), 1 << 32, n
    for bits in (20, 8):
        span = F.shiftright("place", bits)
        for r in sorted(rows.where(inside).groupBy(span.alias("span")).agg(F.count("*").alias("n")).collect()):
            if r.n >= left:
                inside, end = span == r.span, r.span + 1 << bits
                break
            left -= r.n
        else:  # fewer rows than the sample may hold
            break
    return rows.where(F.col("place") < end).orderBy("place", "doc_id", "tie").limit(n)


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """(tree, features): each of the ``n`` rows in one tree at least, in as many as fill the trees' shares."""
    copies = min(TREES, -(-TREES * SHARE // n))
    h = F.xxhash64("doc_id", "tie", F.lit(5))
    # an odd step: all trees of a row differ
    tree = F.pmod(F.pmod(h, F.lit(TREES)) + F.col("j") * (2 * F.pmod(F.shiftright(h, 20), F.lit(TREES // 2)) + 1), F.lit(TREES))
    return rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint")))).select(tree.alias("tree"), "features")


def grow_forest(rows: DataFrame, n: int) -> Forest:
    """A forest from all ``n`` rows (doc_id, tie, features); a task holds a tree's share, 28 bytes a row."""
    depth, steps = depth_of(min(n, SHARE)), list(FEATURES.values())
    schema = "tree bigint, feature binary, split binary, length binary, norm double"
    out = arrow_schema(rows.sparkSession, schema)

    def grow(share: pa.Table) -> pa.Table:
        tree = share.column(0)[0].as_py()
        x = share.column(1).combine_chunks().flatten().to_numpy().reshape(share.num_rows, -1)
        f = Forest(x, steps, trees=1, sample=len(x), seed=(1, tree), depth=depth)
        return pa.table([[v] for v in (tree, f.feature.tobytes(), f.split.tobytes(), f.length.tobytes(), f.norm)], schema=out)

    trees = sorted(dealt(rows, n).groupBy("tree").applyInArrow(grow, schema).collect())
    flat = lambda name, t: np.frombuffer(b"".join(r[name] for r in trees), t).reshape(len(trees), -1)
    return Forest.joined(flat("feature", np.int16), flat("split", np.float32), flat("length", np.float32), np.array([r.norm for r in trees]))


def find_threshold(scores: DataFrame, n: int, max_loss: float) -> float:
    """``calibrate`` over all ``n`` rows of a stored frame (score, good).

    Beyond ``AT_ONCE`` rows the driver reads only the scores of the good rows that may be lost, a share ``max_loss`` of
    them; the least cost is just above one of those, and one pass over all rows counts what lies between them.
    """
    if n <= AT_ONCE:
        rows = scores.toPandas()
        return calibrate(rows.score.to_numpy(float), rows.good.to_numpy(bool), max_loss)
    good, bad = scores.agg(F.sum(F.col("good").cast("bigint")), F.sum((~F.col("good")).cast("bigint"))).first()
    if not good or not bad:
        return np.inf
    need, at_least, inside = int(max_loss * good) + 3, 0.0, F.lit(True)
    for bits in (12, 24):
        span = F.floor(F.col("score") * (1 << bits))
        for r in sorted(scores.where("good").where(inside).groupBy(span.alias("span")).agg(F.count("*").alias("n")).collect(), reverse=True):
            at_least, last = r.span / (1 << bits), r.span
            if r.n >= need:
                break
            need -= r.n
        inside = span == last
    able = np.array(sorted(r.score for r in scores.where("good").where(F.col("score") >= at_least).select("score").distinct().collect()))
    out = arrow_schema(scores.sparkSession, "place bigint, good bigint, bad bigint, least double")

    def run(batches):
        for batch in batches:
            score, is_good = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            place, at = np.unique(np.searchsorted(able, score), return_inverse=True)  # able scores below
            least = np.full(len(place), np.inf)
            np.minimum.at(least, at, score)
            g = np.bincount(at[is_good], minlength=len(place))
            yield pa.record_batch([pa.array(place), pa.array(g), pa.array(np.bincount(at, minlength=len(place)) - g), pa.array(least)], schema=out)

    places = scores.mapInArrow(run, "place bigint, good bigint, bad bigint, least double").groupBy("place").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("least").alias("least")).toPandas()
    up_to, beyond = np.zeros((2, len(able) + 1)), np.append(able, able[-1])
    up_to[:, places.place] = places.good, places.bad
    beyond[places.place] = places.least  # the least score above the one before
    up_to = up_to.cumsum(1)[:, :-1]
    return least_cost((able + beyond[1:]) / 2, 1 - up_to[0] / good, up_to[1] / bad, max_loss)


def fit_forest(stats: DataFrame, labels: DataFrame, *, fit_rows: int | None = None, max_loss: float = 0.002) -> tuple[Forest, float] | None:
    """Forest and threshold from all labelled rows that pass the base rules, or from ``fit_rows`` of them.

    Trees are grown on one half of the good rows; the threshold is found on rows that no tree has seen, the other half
    of the good ones and all others. With fewer than ``FEW`` good rows both use all of them.
    """
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.where(~base_failed()).join(label, "doc_id")
    if fit_rows is not None:
        rows = sample_rows(rows, fit_rows)
    good, even = F.col("quality") > 0, F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = stored(rows.select("doc_id", "tie", "features", good.alias("good"), (good & even).alias("grown")), "labelled-rows")
    n, n_good, n_grown = rows.agg(F.count("*"), F.sum(F.col("good").cast("bigint")), F.sum(F.col("grown").cast("bigint"))).first()
    if not n_good:
        return None
    apart = n_good >= FEW and 0 < n_grown < n_good
    forest = grow_forest(rows.where("grown" if apart else "good"), n_grown if apart else n_good)
    out = arrow_schema(rows.sparkSession, "score double, good boolean")
    model = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.record_batch([pa.array(model.value.score(x) if len(x) else np.empty(0)), batch.column(1)], schema=out)

    left = rows.where("not grown") if apart else rows
    scores = stored(left.select("features", "good").mapInArrow(run, "score double, good boolean"), "scores")
    return forest, find_threshold(scores, n - n_grown if apart else n, max_loss)


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_rows: int | None = None, max_loss: float = 0.002) -> DataFrame:
    """doc_id, tie (the text's key), the statistics, base_failed, anomaly (double), kept."""
    stats = stored(document_statistics(docs, id_col=id_col, text_col=text_col), "quality-stats")
    fitted = fit_forest(stats, labels, fit_rows=fit_rows, max_loss=max_loss)
    model = docs.sparkSession.sparkContext.broadcast(fitted)  # trees x 512 nodes
    schema = "doc_id bigint, tie bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, anomaly double, kept boolean"
    out = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        for batch in batches:
            n, words = batch.num_rows, batch.column(2).to_numpy()
            failed = (words < 10) | (100 * batch.column(6).to_numpy() > 20 * words)
            score, limit = np.zeros(n), np.inf
            if model.value and n:
                forest, limit = model.value
                score = forest.score(batch.column(7).flatten().to_numpy().reshape(n, -1))
            yield pa.record_batch([*batch.columns[:7], pa.array(failed), pa.array(score), pa.array(~failed & (score <= limit))], schema=out)

    return stats.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep, each judged by its own text; all columns as they were."""
    return anti_join(docs, quality_verdicts(docs, labels, id_col=id_col, text_col=text_col, **how).where("not kept"), id_col, text_col)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("tie")
