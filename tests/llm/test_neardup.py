"""Operator 7 against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from ordolith.llm import neardup
from ordolith.llm.common import components, stored


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def find(up, i):
    while up[i] != i:
        i = up[i]
    return i


def brute(docs, percent, k=5):
    sets = [shingles(t, k) for _, t in docs]
    up = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(up, i), find(up, j)
                up[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(up, i)].append(docs[i][0])
    least = {i: min(groups[find(up, i)]) for i in range(len(docs))}
    return sorted((docs[i][0], len(sets[i]), least[i], docs[i][0] == least[i]) for i in range(len(docs)))


def result(df, **how):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, **how).collect())


def corpus(seed, n, groups):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    originals = [rng.choices(words, k=rng.randint(40, 200)) for _ in range(groups)]
    docs = []
    for i in range(n):
        if rng.random() < 0.7:
            w = list(rng.choice(originals))
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = rng.choices(words, k=rng.randint(0, 100))
        docs.append((i * 7 + 3, " ".join(w)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("percent", [80, 85])
def test_components_are_those_of_all_pairs(spark, percent):
    docs = corpus(percent, 250, 12)
    assert result(spark.createDataFrame(docs, "doc_id bigint, text string"), percent=percent) == brute(docs, percent)


def test_large_branches_are_split_and_blocks_confirmed(spark, monkeypatch):
    docs = corpus(3, 160, 2)
    small = neardup.candidates
    monkeypatch.setattr(neardup, "candidates", lambda reps, similarity: small(reps, similarity, small=6, pivots=3))
    assert result(spark.createDataFrame(docs, "doc_id bigint, text string"), percent=85, most=3_000) == brute(docs, 85)


def test_branches_that_never_split_are_compared_in_blocks(spark, monkeypatch):
    docs = corpus(4, 60, 1)
    small = neardup.candidates
    monkeypatch.setattr(neardup, "candidates", lambda reps, similarity: small(reps, similarity, small=4, pivots=2, levels=0))
    assert result(spark.createDataFrame(docs, "doc_id bigint, text string"), percent=85) == brute(docs, 85)


def test_edge_cases(spark):
    docs = [(9, None), (8, ""), (7, " \n\t"), (6, "one two"), (5, "ONE  two"), (4, "one two three"), (3, "a b c d e"), (2, "a\x0bb c d e"), (1, "é É"), (0, "É é")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, cls string, n int")
    got = result(df)
    assert got == brute(docs, 80)
    df = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (None, "same text here"), (None, "alone")], "doc_id bigint, text string")
    rows = sorted(((r.doc_id, r.component_id, r.kept, r.stands) for r in neardup.near_duplicates(df).collect()), key=str)
    assert rows == [(1, 1, True, True), (1, 1, True, True), (None, 1, False, False), (None, None, False, True)]
    assert result(df.limit(0)) == []


def test_texts_link_whatever_their_ids(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    near = lambda w, k: " ".join([*w[:-k], *(f"x{k}" for _ in range(k))])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, near(a, 1)), (7, near(b, 1)), (None, near(a, 2)), (None, "c " * 40), (None, "c " * 40), (None, "c " * 41), (2, "alone here")]
    df = spark.createDataFrame([(*r, i, "n") for i, r in enumerate(rows)], "doc_id bigint, text string, tie int, node string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.near_duplicates(df).collect()}
    assert got[5, 56] == got[7, 56] == got[None, 56] == 1 and got[None, 1] is None and got[2, 1] == 2
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = sorted(r.tie for r in kept.collect())
    assert [i for i in ids if i < 5] in ([0, 1], [0], [1]) and 8 in ids and len([i for i in ids if 5 <= i <= 7]) in (1, 2)
    assert {0, 1} <= set(ids)  # two components, each with a text of id 1
    assert not {2, 3, 4} & set(ids)


def test_very_long_texts(spark):
    text = " ".join(map(str, range(300_000)))
    rows = [(3, text), (4, text + " tail"), (5, "z" * 3_000_000), (6, " ".join(map(str, range(150_000))))]
    assert result(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=85) == [(3, 299_996, 3, True), (4, 299_997, 3, False), (5, 1, 5, True), (6, 149_996, 6, True)]


def test_dropping_keeps_one_of_each_component_and_all_columns(spark):
    docs = corpus(5, 80, 4)
    df = spark.createDataFrame([(i, t, "de") for i, t in docs], "doc_id bigint, text string, lang string")
    kept = neardup.drop_near_duplicates(df, percent=80)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, *_, k in brute(docs, 80) if k]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (300, 201), (300, 305), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys([200, 201, 300, 305], 200)}
    assert got == want


def test_linked_and_confirm():
    near = np.zeros((6, 6), bool)
    for i, j in [(0, 3), (3, 5), (1, 2)]:
        near[i, j] = near[j, i] = True
    assert neardup.linked(near).tolist() == [0, 1, 1, 0, 4, 0]


def one_branch(df):
    """Nodes for ``candidates`` of one-word shingles, all in a single branch of a single tree."""
    rows = neardup.sketch(df.selectExpr("doc_id", "0L as tie", "text"), 1, 1).selectExpr("doc_id as id", "n_shingles as n", "sig", "array(7L) as nodes")
    return stored(rows, "one-branch")


def test_subsets_of_a_large_groups_members_keep_their_links(spark):
    base = [f"w{i}" for i in range(1000)]
    docs = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(560)]
    for i in range(3):  # a: 990 words; b: 842 of them, too few for a set of 1000 words, so only a is linked with it
        a = base[: 10 * i] + base[10 * i + 10 :]
        docs += [(1000 + i, " ".join(a)), (2000 + i, " ".join(a[:842] if i else a[148:]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    one = one_branch(df)  # no other tree helps
    assert {(r.id, r.component) for r in components(neardup.candidates(one, 0.85)).collect()} == {(i, 0) for i, _ in docs}
    assert {c for _, _, c, _ in result(df, percent=85, words=1)} == {0}


def test_recall_in_hot_branches(spark, monkeypatch):
    """Documents that share most of a passage, too little to be near a pivot: links between them, at the threshold or a
    little above it, have to survive a recursion of many levels."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(300)]
    docs = []
    for g in range(250):
        own = [f"o{g}-{i}" for i in range(90)]
        base = passage + own
        docs.append((2 * g, " ".join(base)))
        cut = rng.randint(18, 26)  # of 386 shingles; similarity 0.86 to 0.91
        docs.append((2 * g + 1, " ".join(base[: 390 - cut] + [f"e{g}-{i}" for i in range(cut)])))
    depth = []
    whole, meet = neardup.candidates, neardup.meet_all
    monkeypatch.setattr(neardup, "meet_all", lambda *a: depth.append(1) or meet(*a))
    monkeypatch.setattr(neardup, "candidates", lambda reps, similarity: whole(reps, similarity, small=24, blocks=2))
    got = {i: c for i, _, c, _ in result(spark.createDataFrame(docs, "doc_id bigint, text string"), percent=85)}
    assert len(depth) >= 4  # levels
    assert sum(got[2 * g] == got[2 * g + 1] for g in range(250)) >= 0.99 * 250
    assert all(got[2 * g] == 2 * g for g in range(250))  # and groups with one passage stay apart


def test_pairs_stay_together_in_deep_branches(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(6):  # a branch each in every tree; members share tokens 0 of one another, and two of them 0.85 of all tokens
        sig = np.where(rng.random((600, neardup.TOKENS)) < 0.6, 0, rng.integers(1, 256, (600, neardup.TOKENS)))
        apart = rng.permutation(neardup.TOKENS)[:19]
        sig[:2] = 0
        sig[0, apart[:10]], sig[1, apart[10:]] = 1, 2
        rows += [(2000 * g + i, 100, bytes(r.astype(np.uint8)), [100 * g + t for t in range(8)]) for i, r in enumerate(sig)]
    reps = stored(spark.createDataFrame(rows, "id bigint, n bigint, sig binary, nodes array<bigint>"), "reps")
    comp = {r.id: r.component for r in components(neardup.candidates(reps, 0.85, small=4, pivots=2)).collect()}
    assert [comp.get(2000 * g, -1) == comp.get(2000 * g + 1, -2) for g in range(6)] == [True] * 6


def test_members_near_many_groups_span_them_once(spark):
    """Sixteen pivots that share no token, 200 members near all of them: one link a member and one for each group that it
    brings together, not one for each pair of a member and a group."""
    pivots = [(j, 7, 100, bytes([j + 1] * neardup.TOKENS), 1) for j in range(16)]
    members = [(100 + i, 7, 100, bytes(t % 16 + 1 for t in range(neardup.TOKENS)), 1) for i in range(200)]
    schema = "id bigint, node bigint, n bigint, sig binary, k bigint"
    met = neardup.against_pivots(spark.createDataFrame(members, schema), spark.createDataFrame(pivots, schema), 0.05, 0.85)
    links = met.selectExpr("a", "explode(bs) as b")
    assert links.count() == 200 + 15
    assert {(r.id, r.component) for r in components(links).collect()} == {(i, 0) for i in [*range(16), *range(100, 300)]}
