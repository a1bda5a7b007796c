"""Operator 5 against a brute force over all documents, items and shifts, and planted leaks."""

import random
import re
import string
from collections import Counter, defaultdict
from itertools import product

from ordolith.llm import decontaminate as d

ITEM = "A farmer named Greta sold 14 crates of apples at 3 dollars each to her neighbour Otto and then bought 25 kg of seed for the next spring season how much money was left"


STRIPPED = "".join(c for c in string.punctuation if c not in "+-$%")


def words_of(text):
    """(kind, value) of each word, without the module's hashes."""
    out = []
    for raw in re.findall(r"[^ \t-\r]+", text or ""):
        word = raw.strip(STRIPPED) or raw
        low = word.lower()
        if low.encode() in d.WORDS_OF_NUMBERS or re.fullmatch(r"[+-]?[$]?[0-9][0-9.,:/-]*%?", low):
            kind = "number"
        elif low.encode() in d.UNITS or ((m := re.fullmatch(r"[+-]?[0-9][0-9.,]*([a-z]+)", low)) and m[1].encode() in d.UNITS):
            kind = "unit"
        elif len(word) > 1 and word[0].isupper() and word[1:].islower():
            kind = "name"
        else:
            kind = "plain"
        out.append((kind, low))
    return out


def shape(words):
    return [w if w[0] == "plain" else w[0] for w in words]


def pattern(words):
    return tuple(w if w[0] == "plain" else (w[0], words.index(w)) for w in words)


def brute(docs, items, size=8, coverage=0.7):
    """(doc, item) -> matched words, by comparing every window of every template with every document window."""
    of_template = defaultdict(list)
    for item, text in items:
        if text is not None and words_of(text):
            of_template[pattern(words_of(text))].append((item, text))
    out = {}
    for members in of_template.values():
        item, text = min(members)
        mine, texts = words_of(text), [words_of(t) for _, t in members]
        n = len(mine)
        k = min(size, n)
        enough = [2 * sum(t == "plain" for t, _ in mine[i : i + k]) >= k for i in range(n - k + 1)]
        for doc, body in docs:
            theirs = words_of(body)
            by_shift = defaultdict(list)
            for i in range(n - k + 1):
                for j in range(len(theirs) - k + 1):
                    if shape(mine[i : i + k]) == shape(theirs[j : j + k]):
                        opens = enough[i] or not any(enough) or any(t[i : i + k] == theirs[j : j + k] for t in texts)
                        by_shift[j - i].append((i, opens, [(mine[i + x], theirs[j + x][1]) for x in range(k) if mine[i + x][0] != "plain"]))
            for windows in by_shift.values():
                if not any(opens for _, opens, _ in windows):
                    continue
                counts = defaultdict(Counter)
                for _, _, pairs in windows:
                    for v, dv in pairs:
                        counts[v][dv] += 1
                best = {v: {dv for dv in c if c[dv] == max(c.values())} for v, c in counts.items()}
                # of equally frequent values the module takes any one: either is right here
                found = set()
                for choice in product(*best.values()):
                    one = dict(zip(best, choice))
                    found.add(len({w for i, _, pairs in windows if all(one[v] == dv for v, dv in pairs) for w in range(i, i + k)}))
                if max(found) >= coverage * n:
                    out.setdefault((doc, item), set()).update(x for x in found if x >= coverage * n)
                    if min(found) < coverage * n:
                        out[doc, item].add(None)
    return out


def agree(got, want):
    """Whether every leak is one of brute force's (ties of values leave it several), and none is missing."""
    return all(got[k] in want[k] for k in got if k in want) and set(got) <= set(want) and all(k in got or None in want[k] for k in want)


def result(spark, docs, items, **how):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r.matched_words for r in d.leaked(docs, items, **how).collect()}


def planted():
    rng = random.Random(2)
    noise = lambda n: " ".join(rng.choices(["lorem", "ipsum", "dolor", "amet", "sed", "Nora", "17", "kg"], k=n))
    other = ITEM.replace("14", "96").replace("Greta", "Paula").replace("dollars", "euros").replace("25", "7")
    mixed = " ".join(str(rng.randint(100, 999)) if w.isdigit() else w for w in ITEM.split())
    docs = [(1, noise(30) + " " + ITEM + " " + noise(30)), (2, noise(20) + " " + other + "."), (3, noise(200)), (4, " ".join(ITEM.split()[:12]) + " " + noise(40)), (5, mixed), (6, ITEM.upper()), (7, None), (8, ""), (9, "short item here")]
    items = [(10, ITEM), (11, ITEM), (12, "short item here"), (13, None), (14, ""), (15, "7 8 9 10 11 12 13 14 15")]
    return docs, items


def test_planted_leaks_are_found_and_equal_brute_force(spark):
    docs, items = planted()
    got = result(spark, docs, items)
    assert agree(got, brute(docs, items))
    assert {(1, 10), (2, 10), (5, 10), (9, 12)} <= set(got)
    assert not {3, 4, 7, 8} & {doc for doc, _ in got}


def test_a_slot_must_keep_its_value(spark):
    item = "the bus line 7 leaves at noon and the bus line 7 returns at night while line 7 rests on every other public holiday"
    same, mixed = item.replace("7", "12"), item.replace("7", "12", 1).replace("7", "13", 1).replace("7", "14", 1)
    docs, items = [(1, same), (2, mixed)], [(1, item)]
    got = result(spark, docs, items)
    assert agree(got, brute(docs, items))
    assert got[1, 1] == len(item.split()) and got.get((2, 1), 0) < got[1, 1]


def test_large_benchmarks_join_by_a_shuffle(spark):
    docs, items = planted()
    assert agree(result(spark, docs, items, broadcast_rows=0), brute(docs, items))


def test_random_documents_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "3", "4", "kg", "Otto", "runs.", "the"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 20)))) for i in range(12)]
    docs = []
    for i in range(40):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(items)[1], " ".join(rng.choices(words, k=5))]
        docs.append((i, " ".join(w if rng.random() < 0.95 else rng.choice(words) for p in parts for w in p.split())))
    assert agree(result(spark, docs, items), brute(docs, items))


def test_dropping_keeps_clean_rows_and_columns(spark):
    docs, items = planted()
    df = spark.createDataFrame([(*r, "a", 1) for r in docs] + [(None, "no id", "a", 1)], "doc_id bigint, text string, hash string, at int")
    kept = d.drop_leaked(df, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == df.columns
    assert {3, 4, 7, 8, None} <= {r.doc_id for r in kept.collect()} and not {1, 2, 5, 9} & {r.doc_id for r in kept.collect()}
    assert d.leaked(df.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert d.leaked(df, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_copies_of_slot_heavy_items_are_found_whole(spark):
    item = "Find the mean of the values 3, 5, 7, 9, 11, 13, 15, 17, 19, 21, 23."
    other = item.replace("3, 5, 7", "4, 6, 8")
    tail = " ".join(item.split()[4:])  # the windows that are open by their template are cut off
    docs = [(1, "some words before. " + item + " some words after"), (2, other), (3, "x " + tail), (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18")]
    for how in ({}, {"broadcast_rows": 0}):
        assert result(spark, docs, [(1, item)], **how) == {(1, 1): 17, (2, 1): 17, (3, 1): 13}
    assert result(spark, [(None, item)], [(1, item)]) == {(None, 1): 17}


def test_names_that_begin_sentences_are_slots(spark):
    item = "Tom has 5 apples. Sue has 3 apples. Ann buys 4 more. How many apples do they have now?"
    other = item.replace("Tom", "Ida").replace("Sue", "Max").replace("Ann", "Leo").replace("5", "8")
    got = result(spark, [(1, other), (2, "it reads " + item + " then more")], [(1, item)])
    assert got == {(1, 1): 19, (2, 1): 19}


def test_items_of_one_template_are_one(spark):
    item = "the train leaves station Alpha at 7 and arrives at station Beta at 9 which is late for all of us"
    same = item.replace("7", "8").replace("Alpha", "Gamma")
    merged = item.replace("9", "7")  # its slots repeat otherwise: another template
    docs = [(1, item), (2, same), (3, merged)]
    got = result(spark, docs, [(5, same), (4, item), (6, merged)])
    assert {k for k in got if k[1] == 5} == set() and got[1, 4] == got[2, 4] == len(item.split()) == got[3, 6]
    heavy = "Find 3 5 7 9 11 13 15 17 19 21 23 mean of these values please"
    twin = heavy.replace("3 5 7 9 11 13", "4 6 8 10 12 14")
    assert result(spark, [(1, "x " + " ".join(twin.split()[:12]))], [(1, heavy), (2, twin)]) == {(1, 1): 12}


def test_rows_without_an_id_or_with_a_shared_one_are_judged_apart(spark):
    rows = [(None, ITEM, 1), (None, "a clean text", 2), (None, None, 3), (7, ITEM, 4), (7, "another clean text", 5), (7, "another clean text", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tie int")
    kept = d.drop_leaked(df, spark.createDataFrame([(None, ITEM)], "item_id bigint, text string"))
    assert kept.columns == df.columns and sorted(r.tie for r in kept.collect()) == [2, 3, 5, 6]


def test_very_long_texts(spark):
    text = "filler words that go on " * 60_000
    assert result(spark, [(1, text + ITEM + " " + text), (2, text), (3, "w" * 2_000_000 + " " + ITEM)], [(1, ITEM)]) == {(1, 1): 34, (3, 1): 34}
