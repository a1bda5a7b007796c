"""Operators 4 and 9 against the tokenizers library, and packing plans against exhaustive ones."""

import zlib
from collections import Counter, defaultdict
from functools import cache
from itertools import combinations_with_replacement

import numpy as np
import pytest
from ordolith.llm import packing, tokenids

TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "Plain words, with marks... and (brackets) don't can't WE'LL",
    " leading and trailing \n",
    "two  spaces\tand\ttabs\x0b\x0c\r\nlines\n\n\nmore \n x",
    "ünïcode é é ﬁ ß İ ı ſ K Å ’quoted’ naïve ŉ",
    "数字 と 漢字 🎉🎉 👩‍👩‍👧 ​ zero width wide",
    "<|endoftext|> a<|endoftext|>b <|startoftext|> <| |> </w> x</w>",
    "123 4567,89 3.14 $5 10% a1b2 A1 1st 'tis ' '' ''' \"q\" _x_ __ -- ---",
    "\0 nul \x1f unit \x85 next   sep",
    "x" * 5000,
    "word " * 3000,
    "ab\n" * 1500 + "end",
]


@cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenids.tokenizer_path(name))


def ids_of(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, i, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, shard int, task string")


@pytest.fixture(scope="module")
def real(spark):
    from conftest import SF

    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect()]


def test_encoders_give_the_library_s_ids(real):
    byte, word = packing.byte_encoder(tokenids.tokenizer_path(packing.BYTES_FILE)), tokenids.word_encoder(tokenids.tokenizer_path(tokenids.WORDS_FILE), "H")
    for text in TEXTS + real:
        assert np.frombuffer(byte(text), "<u4").tolist() == ids_of(packing.BYTES_FILE, text), text
        assert np.frombuffer(word(text), "<u2").tolist() == ids_of(tokenids.WORDS_FILE, text), text


def test_token_files_round_trip(spark, tmp_path):
    df = frame(spark, TEXTS).repartition(3)
    folder = "file://" + str(tmp_path / "files")
    manifest = tokenids.write_token_files(df, folder, tokenids.tokenizer_path(tokenids.WORDS_FILE), length=64, shards=3)
    at = 0
    rows = sorted(tokenids.read_token_files(manifest, folder).collect())
    for i, (r, text) in enumerate(zip(rows, TEXTS, strict=True)):
        ids = ids_of(tokenids.WORDS_FILE, text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), crc(ids))
        at += len(ids)
    shard = manifest.orderBy("shard").first()
    f = tokenids.TokenFile(folder, shard.shard)
    flat = np.concatenate([f.sequence(k)[0][f.sequence(k)[1]] for k in range(-(-shard.n_tokens // 64))])
    assert flat.tolist() == f.tokens(0, shard.n_tokens).tolist()
    ids, mask = f.sequence(0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata  # a view of the file


def test_token_files_of_odd_tables(spark, tmp_path):
    path, folder = tokenids.tokenizer_path(tokenids.WORDS_FILE), "file://" + str(tmp_path / "files")
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (2, None)], "doc_id bigint, text string")
    rows = tokenids.read_token_files(tokenids.write_token_files(df, folder, path), folder).collect()
    assert sorted([(r.doc_id, r.start) for r in rows], key=lambda r: r[1]) == [(None, 0), (1, 2), (1, 4), (2, 6)]
    ties = [(i, f"text {k}") for k in range(30) for i in (None, 4)]
    starts = []
    for part, order in (("-a", ties), ("-b", ties[::-1])):
        df2 = spark.createDataFrame(order, "doc_id bigint, text string").repartition(3)
        manifest = tokenids.write_token_files(df2, folder + part, path, shards=5)
        starts.append(sorted(map(str, tokenids.read_token_files(manifest, folder + part).collect())))
    assert starts[0] == starts[1]  # whatever the order of the input
    folder += "-none"
    assert tokenids.read_token_files(tokenids.write_token_files(df.limit(0), folder, path), folder).count() == 0


def check_packing(docs, rows, name, tokens=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text in docs:
        ids, at = ids_of(name, text), 0
        mine = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        for r in mine:
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length])
            assert r.length == tokens or r.piece == 0
            at += r.length
        assert at == len(ids) and (len(mine) == 1 or len(ids) > tokens)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens
    return len(by_sequence)


def test_packing(spark, real):
    docs = list(enumerate(TEXTS + real))
    df = frame(spark, TEXTS + real).repartition(5)
    rows = packing.pack(df, tokenids.tokenizer_path(packing.BYTES_FILE)).collect()
    n = check_packing(docs, rows, packing.BYTES_FILE)
    assert n <= 1.01 * -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack(df.limit(0), tokenids.tokenizer_path(packing.BYTES_FILE)).count() == 0


def test_all_capacities_hold(spark, real):
    cap = packing.Capacity(tokens=256, documents=3, cost=40_000)
    rows = packing.pack(frame(spark, real), tokenids.tokenizer_path(packing.BYTES_FILE), cap, (1.0, 1.0, 1.0), "dot").collect()
    tokens, documents, cost = Counter(), Counter(), Counter()
    for r in rows:
        tokens[r.sequence_id] += r.length
        documents[r.sequence_id] += 1
        cost[r.sequence_id] += r.length**2
    assert max(tokens.values()) <= 256 and max(documents.values()) <= 3 and max(cost.values()) <= 40_000


def test_the_number_of_documents_binds_at_the_defaults(spark):
    df = spark.createDataFrame([(i, None) for i in range(150)], "doc_id bigint, text string")
    rows = packing.pack(df, tokenids.tokenizer_path(packing.BYTES_FILE)).collect()
    assert Counter(Counter(r.sequence_id for r in rows).values()) == {64: 2, 22: 1}


def fewest(lengths, size):
    """The least number of bins, by trying all assignments."""
    best = len(lengths)
    for n in range(1, len(lengths)):
        stack = [((0,) * n, tuple(sorted(lengths, reverse=True)))]
        while stack:
            bins, left = stack.pop()
            if not left:
                return n
            stack += [(tuple(sorted(bins[:i] + (bins[i] + left[0],) + bins[i + 1 :])), left[1:]) for i in range(n) if bins[i] + left[0] <= size]
    return best


def test_plans_are_near_the_fewest_sequences():
    for lengths in combinations_with_replacement((2, 3, 5, 7), 6):
        steps = packing.plan(Counter(lengths), packing.Capacity(10, 10, 100))
        used = {s.bin + b for s in steps for b in range(s.bins)}
        assert fewest(lengths, 10) <= len(used) <= fewest(lengths, 10) + 1
    with pytest.raises(ValueError):
        packing.plan({11: 1}, packing.Capacity(10, 10, 100))
