"""Operators 2 and 3: held-out accuracy, brute-force counts, and the lattice against all segmentations."""

import math
import zlib
from collections import Counter

import numpy as np
from conftest import SF
from ordolith.llm import langid, lm
from ordolith.llm.tokenids import tokenizer_path


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_of_held_out_documents(spark):
    rows = {r.doc_id: r for r in langid.op2_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [d for d in docs if remainder(d.doc_id, 3) == 1]
    assert all(rows[d.doc_id].held_out == (remainder(d.doc_id, 3) == 1) for d in docs)
    right = [rows[d.doc_id].lang_pred == d.lang for d in held if (d.text or "").split() and d.lang]
    assert np.mean(right) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_edge_cases(spark):
    train = spark.createDataFrame([("the quick fox and the dog", "en"), ("der schnelle Fuchs und der Hund", "de"), (None, "en"), ("x", None)] * 20, "text string, lang string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the dog and the fox"), (5, "und der Hund"), (6, "the dog and the fox " * 40 + "und der Hund " * 10), (None, "ЖЖ")], "doc_id bigint, text string").withColumn("held_out", langid.held_out("doc_id", 3, 1))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, train).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == got[6][0] == "en" and got[5][0] == "de" and 0.9 < got[4][1] <= 1.0 and 0.6 < got[6][1] < 0.95
    assert {r.lang_pred for r in langid.identify(docs, train.limit(0)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), train).count() == 0


def em(words, model, langs, rounds=12):
    """The mixture of one document's words over ``langs`` (columns of the model), one word and one language at a time."""
    like = []
    for word in words:
        padded = [0, *map(ord, word), 0]
        total = [0.0] * len(langs)
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            bucket = (((a << 42 | b << 21 | c) * 0x9E3779B97F4A7C15) % (1 << 64)) >> (64 - model.bits)
            total = [t + float(model.log_p[bucket, k]) for t, k in zip(total, langs)]
        like.append(total)
    pi = [1 / len(langs)] * len(langs)
    for _ in range(rounds):
        sums = [0.0] * len(langs)
        for row in like:
            joint = [p * math.exp(x - max(row)) for p, x in zip(pi, row)]
            sums = [s + j / sum(joint) for s, j in zip(sums, joint)]
        pi = [s / len(like) for s in sums]
    return pi, sum(max(row) + math.log(sum(p * math.exp(x - max(row)) for p, x in zip(pi, row))) for row in like), [sum(r[k] for r in like) for k in range(len(langs))]


def test_language_is_that_of_brute_force_em(spark):
    train = spark.createDataFrame([("the quick fox and the dog", "en"), ("der schnelle Fuchs und der Hund", "de"), ("le renard et le chien rapide", "fr")], "text string, lang string")
    model = langid.Model(langid.trigram_counts(train, 12).toPandas(), 12)
    rng = np.random.default_rng(3)
    pool = "the quick fox and dog der schnelle fuchs und hund le renard et chien rapide".split()
    texts = [" ".join(rng.choice(pool[lo:hi], n)) for lo, hi, n in [(0, 5, 1), (0, 5, 30), (5, 10, 20), (0, 10, 60), (0, 15, 90), (10, 15, 3), (3, 12, 40)]]
    names, scores = langid.infer(texts, model)
    for text, name, score in zip(texts, names, scores):
        words, k = text.split(), 3
        pi, whole, single = em(words, model, range(k))
        penalty = 0.5 * math.log(len(words) + 1) + 2
        best, value = int(np.argmax(single)), max(single)
        if whole - value > penalty:
            order = sorted(range(k), key=lambda i: -pi[i])
            for m in range(2, min(k, max(2, sum(p > 1e-3 for p in pi))) + 1):
                part, ll, _ = em(words, model, sorted(order[:m]))
                if ll - (m - 1) * penalty > value:
                    value, best = ll - (m - 1) * penalty, sorted(order[:m])[int(np.argmax(part))]
        assert (name, round(score, 6)) == (model.langs[best], round(pi[best], 6)), text


def test_languages_of_odd_tables(spark):
    rows = [(1, "the dog and the fox " * 60_000, "x", "y", 1), (1, "der Hund", "x", "y", 1), (1, "der Hund", "x", "y", 1), (None, "der Hund", "x", "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _text string, lang string, held_out int")
    train = spark.createDataFrame([("the quick fox and the dog", "en", 1), ("der schnelle Fuchs und der Hund", "de", 2)], "text string, lang string, held_out int")
    got = sorted(langid.identify(docs, train, carry=("doc_id", "_text")).select("doc_id", "_text", "lang_pred").collect(), key=str)
    assert [tuple(r) for r in got] == [(1, "x", "de"), (1, "x", "de"), (1, "x", "en"), (None, "x", "de")]


def test_mixture_proportions_follow_the_parts():
    rng = np.random.default_rng(0)
    like = np.log(np.where(rng.random((400, 1)) < 0.7, [[0.9, 0.05, 0.05]], [[0.05, 0.9, 0.05]]))
    pi, ll = langid.proportions(like, np.array([0]), np.array([400]), np.ones((1, 3)), rounds=200)
    assert abs(pi[0, 0] - 0.72) < 0.08 and pi[0, 2] < 0.01
    assert abs(ll[0] - np.log((np.exp(like) * pi).sum(1)).sum()) < 1e-6


def segmentations(s, pieces, byte):
    if not s:
        return 1.0
    total = sum(math.exp(w) * segmentations(s[len(p) :], pieces, byte) for p, w in pieces.items() if s.startswith(p))
    if s[0] not in pieces:
        total += math.exp(byte * len(s[0].encode())) * segmentations(s[1:], pieces, byte)
    return total


def test_lattice_adds_all_segmentations():
    pieces = {p: math.log(q) for p, q in {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.15, "▁a": 0.05, "aba": 0.02, "bab": 0.01}.items()}
    lattice = lm.Lattice(pieces, math.log(1e-4))
    for word in ("a", "ab", "abab", "aébab", "", "bbbab"):
        assert math.isclose(lattice.log_p(word), math.log(segmentations("▁" + word, pieces, math.log(1e-4))), abs_tol=1e-9)
    for word in ("ab" * 4000, "c" * 9000):  # longer than any recursion, smaller than any double
        assert math.isfinite(lattice.log_p(word))
    spelt = lattice.log_p("c" * 9000) - lattice.log_p("")
    assert math.isclose(spelt, 9000 * math.log(1e-4), rel_tol=1e-9)


def marginal(text, lattice):
    """log10 of the sum over all segmentations of each word of a text, by suffixes; then its end."""
    total = lattice.end
    for word in (text or "").encode().lower().split():
        s = "▁" + word.decode()
        tail = {len(s): 1.0}
        for i in reversed(range(len(s))):
            tail[i] = sum(math.exp(w) * tail[i + len(p)] for p, w in lattice.pieces.items() if s.startswith(p, i))
            if s[i] not in lattice.pieces:
                tail[i] += math.exp(lattice.byte * len(s[i].encode())) * tail[i + 1]
        total += math.log(tail[0])
    return total / math.log(10)


def test_scores(spark):
    texts = {1: "The cat sat on the mat", 2: "the dog, the cat\x1fé", 3: None, 4: "", 5: "unseen words here", 6: "the " * 3000, 10: "cat ÉÉ the"}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(10, texts[10], "x")], "doc_id bigint, text string, word string").withColumn("held_out", langid.held_out("doc_id", 7, 2))
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    train = Counter()
    for i, t in [*texts.items(), (10, texts[10])]:
        if remainder(i, 7) != 2:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    lattice = lm.Lattice.existing(tokenizer_path(lm.PIECES_FILE), (train[b""] + 1) / (n + 2))
    assert math.isclose(sum(map(math.exp, lattice.pieces.values())) + 256 * math.exp(lattice.byte) + math.exp(lattice.end), 1.0)
    scores = {i: marginal(t, lattice) for i, t in texts.items() if i != 6}
    rows = lm.score_documents(df, tokenizer_path(lm.PIECES_FILE)).collect()
    assert len(rows) == 8
    for r in rows:
        ts = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(r.doc_id, 7) == 2, len(ts), sum(t in train for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
        want = scores[r.doc_id] if r.doc_id != 6 else 3000 * (marginal("the", lattice) - lattice.end / lm.LOG10) + lattice.end / lm.LOG10
        assert math.isclose(r.score, want, rel_tol=1e-9)
    assert lm.score_documents(df.limit(0), tokenizer_path(lm.PIECES_FILE)).count() == 0


def test_rare_words_meet_by_a_join(spark, monkeypatch):
    """With a share that only very frequent words reach, nearly all words are joined; scores must not change."""
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").withColumn("held_out", langid.held_out("doc_id", 7, 2))
    path = tokenizer_path(lm.PIECES_FILE)
    key = lambda r: (r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))
    whole = sorted(map(key, lm.score_documents(df, path).collect()))
    monkeypatch.setattr(lm, "HOT_BITS", 6)
    assert sorted(map(key, lm.score_documents(df, path).collect())) == whole


def all_segmentations(s, lattice):
    """(probability, pieces) of each; a byte is the empty piece."""
    if not s:
        yield 1.0, []
        return
    for p, w in lattice.pieces.items():
        if s.startswith(p):
            yield from ((math.exp(w) * q, [p, *rest]) for q, rest in all_segmentations(s[len(p) :], lattice))
    if s[0] not in lattice.pieces:
        k = len(s[0].encode())
        yield from ((math.exp(k * lattice.byte) * q, [""] * k + rest) for q, rest in all_segmentations(s[1:], lattice))


def test_expected_pieces_are_means_over_all_segmentations():
    lattice = lm.Lattice({p: math.log(q) for p, q in {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.15, "▁a": 0.05, "aba": 0.02, "bab": 0.01}.items()}, math.log(1e-4), math.log(0.1))
    for word in ("a", "abab", "aébab", "", "bbbab"):
        found, z = Counter(), 0.0
        for q, pieces in all_segmentations("▁" + word, lattice):
            z += q
            for p in pieces:
                found[p] += q
        got = Counter()
        lattice.add_expected(word, got)
        assert set(got) == set(found) and all(math.isclose(got[p], found[p] / z, rel_tol=1e-9) for p in got)
    for word in ("ab" * 4000, "c" * 9000):  # smaller than any double
        got = Counter()
        lattice.add_expected(word, got)
        assert math.isclose(sum(len(p) * n for p, n in got.items()) + got[""], 1 + len(word), rel_tol=1e-7)  # differences of logs near -83 000
    before = lm.Lattice(lattice.pieces, math.log((0.9 - sum(map(math.exp, lattice.pieces.values()))) / 256), lattice.end)
    after = before.learned({"ab": 5.0, "": 1.0})
    assert math.isclose(sum(map(math.exp, after.pieces.values())) + 256 * math.exp(after.byte) + math.exp(after.end), 1.0)
    assert after.pieces["ab"] > before.pieces["ab"] and after.pieces["bab"] < before.pieces["bab"]


def test_learned_scores_of_held_out_rows_come_near_the_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lm.op3_lm_scoring(spark, SF).collect()
    assert len(rows) == docs.count() and all(r.score is not None and math.isfinite(r.score) and r.score < 0 for r in rows)
    known = [r for r in rows if r.held_out and r.n_known > 0.9 * r.n_tokens]
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 1.4 * sum(r.base_score for r in held)
    assert all(r.score > 1.3 * r.base_score for r in known)


def test_learned_scores_are_a_discounted_count_and_a_lattice(spark):
    texts = {1: "The cat sat on the mat", 2: "the dog, the cat\x1fé", 3: None, 4: "", 5: "unseen words here", 6: "ж" * 9000, 10: "cat ÉÉ the"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("held_out", langid.held_out("doc_id", 7, 2))
    path = tokenizer_path(lm.PIECES_FILE)
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    train = Counter(w for i, t in texts.items() if remainder(i, 7) != 2 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    once, twice = (sum(c == k for c in train.values()) for k in (1, 2))
    d = (once + 1) / (once + 2 * twice + 2)
    first = lm.Lattice.existing(path, (train[b""] + 1) / (n + 2))
    expected = Counter()
    for w in train:
        if w:
            first.add_expected(w.decode(), expected)
    lattice = first.learned(expected)

    def log10_p(w):
        log_p = lattice.log_p(w.decode()) if w else lattice.end
        return math.log10((train[w] - d) / n + d * v / n * math.exp(log_p)) if train[w] else math.log10(d * v / n) + log_p / math.log(10)

    for r in lm.score_documents(df, path, learned=True).collect():
        assert math.isclose(r.score, sum(map(log10_p, tokens(texts[r.doc_id]))), rel_tol=1e-9)
    for rows in (df.limit(0), df.where("doc_id = 4").withColumn("held_out", lm.F.lit(True)), df.withColumn("held_out", lm.F.lit(True)), df.where("doc_id = 4").withColumn("held_out", lm.F.lit(False))):
        assert all(math.isfinite(r.score) for r in lm.score_documents(rows, path, learned=True).collect())
