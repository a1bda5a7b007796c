"""Operator 6 against a byte-by-byte brute force."""

import hashlib
import random

import numpy as np
import pytest
from ordolith.llm import repeats

W = 100


def brute(docs, width=W):
    """docs: (id, text) with distinct ids."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, **how).collect()}


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    passages = [" ".join(rng.choices(words, k=40)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(rng.randint(0, 3))] + rng.choices(passages, k=rng.randint(0, 3))
        rng.shuffle(parts)
        docs.append((i * 3, "\n".join(parts)))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_random_documents(spark, seed):
    docs = texts(seed, 60)
    assert result(spark, docs) == brute(docs)


def test_several_shards_and_hot_anchors_meet_by_binary_search(spark):
    docs = texts(7, 80)
    # with shards this small every anchor of a few runs is spread, and the hash splitters are many
    assert result(spark, docs, shard_bytes=4_000) == brute(docs)


def test_edge_cases(spark):
    long_run = "x" * 700
    docs = [(None, "q" * 150), (1, None), (2, ""), (3, "short"), (4, long_run), (5, long_run), (6, "ä" * 120), (7, "ä" * 120), (8, "\0" * 130), (9, "y" * 99), (10, "z" * 100)]
    assert result(spark, docs) == brute(docs)


def test_repeated_rows_are_one_document_and_empty_tables_give_nothing(spark):
    text = " ".join(map(str, range(100)))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_removed) for r in repeats.remove_repeats(df).collect())
    assert got == [(1, 0), (1, 0), (2, len(text))]
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_documents_beyond_a_part_of_a_million_bytes(spark):
    rng = random.Random(4)
    unique = "".join(rng.choices("abcdefghijklmnop ", k=1_200_000))
    edge = (1 << 20) - 4096  # where the first part ends
    again = unique[edge - 150 : edge + 180]
    docs = [(1, unique), (2, "q" * 99 + "-" + again + "-" + "r" * 99), (3, unique[:500] + "ä" + unique[1_100_000:] + unique[1_100_000:1_100_400])]
    assert result(spark, docs) == brute(docs)


def test_clashing_extra_columns(spark):
    df = spark.createDataFrame([(1, "a" * 120, 5, "t")], "doc_id bigint, text string, b int, tie string")
    assert [r.n_removed for r in repeats.remove_repeats(df).collect()] == [brute([(1, "a" * 120)])[1][1]]


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    x = rng.integers(97, 99, 400).astype(np.uint8)
    x[-1] = 0
    raw = x.tobytes()
    sa, _ = repeats.suffix_ranks(x)
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    lcp = repeats.common_prefixes(x, sa, np.array([0]), np.array([len(x)]), 100)

    def shared(a, b):
        n = 0
        while n < 100 and a + n < len(raw) and b + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        return n

    assert lcp.tolist() == [0] + [shared(a, b) for a, b in zip(sa[:-1], sa[1:])]
