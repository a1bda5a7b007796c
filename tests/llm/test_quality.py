"""Operator 10: the contract's statistics against brute force, and held-out behaviour of the forest."""

import random
import re

import numpy as np
from ordolith.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


TEXTS = [None, "", "  \n\n", "a b c\na b c\n a b c\n", "x " * 50, "ä#ö *$% &|<> \x0b word\x1fword " * 3, "one two three four five " * 2 + " ".join(map(str, range(60))), " ".join(map(str, range(30_000)))]


def test_statistics_are_those_of_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    for r in quality.quality_verdicts(df, labels).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(TEXTS[r.doc_id])
        assert r.kept == (not r.base_failed)  # no labels: the base rules alone
    assert quality.quality_verdicts(df.limit(0), labels).count() == 0


def test_junk_is_rejected_and_clean_documents_stay(spark):
    rng = random.Random(0)
    words = [f"{a}{b}" for a in ("ba", "do", "ri", "lum") for b in ("na", "te", "so", "mi", "ker")]
    clean = lambda: " ".join(rng.choices(words, k=rng.randint(60, 300)))
    junk = lambda: " ".join(rng.choice(["$$$", "###", "CLICK", "WIN%", *words]) for _ in range(rng.randint(60, 300)))
    rows = [(i, junk() if i % 5 == 0 else clean()) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 500)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.quality_verdicts(df, labels).collect() if r.doc_id >= 500 and not r.base_failed}
    wrong = [i for i, r in got.items() if r.kept != (i % 5 != 0)]
    assert len(wrong) <= 0.01 * len(got)
    kept = quality.keep_good(df.withColumn("extra", df.doc_id), labels)
    assert kept.columns == ["doc_id", "text", "extra"]


def test_paths_of_outliers_are_short():
    x = np.random.default_rng(0).normal(size=(2000, 3)).astype(np.float32)
    forest = quality.Forest(x, np.ones(3))
    assert forest.score(np.array([[9, 9, 9]])) > forest.score(x).max()
    assert np.array_equal(forest.score(x), quality.Forest(x, np.ones(3)).score(x))


def test_calibration_loses_few_good_rows():
    score, good = np.array([0.1, 0.2, 0.3, 0.8, 0.9]), np.array([True, True, True, False, False])
    assert 0.3 < quality.calibrate(score, good, 0.0) < 0.8
    assert quality.calibrate(score, np.ones(5, bool), 0.0) == np.inf


def test_rows_that_share_an_id_or_have_none_are_judged_by_their_own_text(spark):
    clean, junk = " ".join(map(str, range(40))), "x " * 60
    rows = [(None, clean, 1, 1), (None, junk, 2, 2), (5, clean, 3, 3), (5, junk, 4, 4), (5, clean, 5, 5), (None, None, 6, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tie int, n_words int")
    labels = spark.createDataFrame([(5, 1), (None, 0)], "doc_id bigint, quality int")
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and sorted(r.tie for r in kept.collect()) == [1, 3, 5]
    assert quality.keep_good(df.limit(0), labels).count() == 0


def test_the_threshold_uses_rows_that_no_tree_saw(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "calibrate", lambda score, good, loss: seen.append(good.copy()) or 1.0)
    df = spark.createDataFrame([(i, " ".join(map(str, range(i, i + 40)))) for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id bigint, quality int")
    quality.fit_forest(quality.document_statistics(df), labels)
    assert (~seen[0]).sum() == 50 and 40 < seen[0].sum() < 110


def test_very_long_texts(spark):
    text = " ".join(map(str, range(400_000)))
    df = spark.createDataFrame([(1, text + " " + text), (2, "y" * 3_000_000)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_repeat_words, r.kept) for r in quality.quality_verdicts(df, spark.createDataFrame([], "doc_id bigint, quality int")).collect()}
    assert got == {1: (800_000, 800_000, False), 2: (1, 0, False)}


def test_the_sample_holds_the_smallest_hashes(spark):
    import zlib

    ids = [*range(500), *[7] * 30]  # an id may have several texts
    rows = [(i, t, [0.0], 1) for t, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id bigint, tie bigint, features array<float>, quality int").repartition(7)
    best = sorted((zlib.crc32(str(i).encode()), i, t) for i, t, *_ in rows)
    for n in (0, 1, 40, 529, 530, 10_000):
        got = [(r.place, r.doc_id, r.tie) for r in quality.sample_rows(df, n).collect()]
        assert got == best[:n]
    assert quality.sample_rows(df.limit(0), 5).count() == 0


def test_all_labelled_rows_are_used(spark, monkeypatch):
    """25 000 labelled rows, more than a sample of 20 000 would hold: all grow a tree or count for the threshold."""
    grown, counted = [], []
    deal, calibrate = quality.dealt, quality.calibrate
    monkeypatch.setattr(quality, "AT_ONCE", 1 << 20)
    monkeypatch.setattr(quality, "dealt", lambda rows, n: grown.append((n, rows.count(), deal(rows.select("doc_id", "tie", rows.doc_id.alias("features")), n).select("features").distinct().count())) or deal(rows, n))
    monkeypatch.setattr(quality, "calibrate", lambda score, good, loss: counted.append((len(good), int(good.sum()))) or calibrate(score, good, loss))
    stats = spark.range(25_000).selectExpr("id as doc_id", "id as tie", "50L as n_words", "0L as n_repeat_words", "transform(sequence(1, 7), k -> cast(pmod(xxhash64(id, k), 100) / 100 + if(id % 5 = 0, 9, 0) as float)) as features")
    labels = spark.range(25_000).selectExpr("id as doc_id", "int(id % 5 > 0) as quality")
    forest, limit = quality.fit_forest(stats, labels)
    (n, rows, different), (left, good) = grown[0], counted[0]
    assert n == rows == different and left == 25_000 - n and good == 20_000 - n and 9_000 < n < 11_000
    assert len(forest.feature) == quality.TREES
    x = np.random.default_rng(3).random((100, 7))
    assert (forest.score(x) <= limit).all() and (forest.score(x + 9) > limit).all()


def test_the_threshold_of_large_tables_is_that_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "AT_ONCE", 0)
    rng = np.random.default_rng(5)
    for case, (n, share, digits, loss) in enumerate([(3000, 0.7, 3, 0.01), (3000, 0.7, 9, 0.002), (400, 0.2, 2, 0.1), (300, 0.9, 9, 0.0), (50, 0.5, 1, 0.3), (40, 1.0, 3, 0.1)]):
        good = rng.random(n) < share
        score = np.round(np.clip(rng.normal(np.where(good, 0.4, 0.6), 0.1), 0.01, 1), digits)
        df = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(score, good)], "score double, good boolean").repartition(3)
        assert quality.find_threshold(df, n, loss) == quality.calibrate(score, good, loss), case
