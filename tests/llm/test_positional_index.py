"""Contamination and proximity against plain searches of every place."""

import random
import re

import pytest

from tarnwright.llm import positional_index as index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def cut(item, length):
    w = words(item)
    return {tuple(w[i : i + length]) for i in range(max(1, len(w) - length + 1))} if w else set()


def plain(docs, items, length):
    out = []
    for key, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, body in items:
            for x in cut(body, length):
                at = [i for i in range(len(w) - len(x) + 1) if tuple(w[i : i + len(x)]) == x]
                hit |= {i + k for i in at for k in range(len(x))}
                if at and item is not None:
                    ids.add(item)
        out.append((str(key), len(w), sorted(hit), sorted(ids)))
    return sorted(out, key=str)


def got(df):
    return sorted(((str(r.doc_id), r.n_words, [i for s in r.spans for i in range(s.start, s.end)], list(r.items)) for r in df.collect()), key=str)


def made(seed, vocabulary="a b c D e f0 é ß", n=60):
    rng = random.Random(seed)
    some = lambda k: rng.choice([" ", ", ", "\n", "__", "-"]).join(rng.choices(vocabulary.split(), k=k))
    items = [(i, some(rng.choice([1, 2, 3, 5, 8, 30]))) for i in range(12)] + [(3, "a b c d"), (None, "e e e"), (50, None), (51, ""), (52, "!?"), (53, "Zz"), (54, "A,B;c.d")]
    docs = [(i, some(rng.choice([0, 1, 4, 40, 200]))) for i in range(n)] + [(5, items[3][1]), (5, items[3][1]), (None, "a b c d"), (900, None), (901, ""), (902, "ABCD zz"), (903, " ".join(["e"] * 50))]
    docs += [(1000 + i, some(5) + " " + b + " " + some(5)) for i, (_, b) in enumerate(items) if b]
    return docs, items


@pytest.mark.parametrize("length", [1, 4, 10])
def test_contamination_against_a_plain_search(spark, length):
    docs, items = made(length)
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, token string").repartition(3)
    b = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, id int")
    want = plain(docs, items, length)
    assert got(index.contamination(d, b, length=length)) == want
    # blocks of a few words, and items in many parts
    assert got(index.contamination(d, b, length=length, size=50, part=20)) == want


def test_spans_end_with_their_document(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "a b c d e f")], "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([("x", "a b c d"), ("y", "a b c"), ("z", "d e")], "item_id string, text string")
    out = {r.doc_id: ([tuple(s) for s in r.spans], r["items"]) for r in index.contamination(d, b, length=4).collect()}
    assert out == {1: ([(0, 3)], ["y"]), 2: ([(0, 2)], ["z"]), 3: ([(0, 5)], ["x", "y", "z"])}


def test_empty_tables_and_other_keys(spark):
    d = spark.createDataFrame([("k", "a b c"), (None, None)], "`my key` string, body string")
    b = spark.createDataFrame([("x", "a b")], "item_id string, text string")
    out = index.contamination(d.withColumnRenamed("body", "text"), b.filter("false"), key="my key")
    assert sorted((str(r[0]), r.n_words, r.spans, r["items"]) for r in out.collect()) == [("None", 0, [], []), ("k", 3, [], [])]
    assert index.contamination(d.withColumnRenamed("body", "text").filter("false"), b, key="my key").count() == 0
    row = index.digest(index.contamination(d.withColumnRenamed("body", "text"), b, key="my key"), "my key").filter("contaminated").collect()
    assert [(r["my key"], r.n_words, r.n_hit, r.n_items) for r in row] == [("k", 3, 2, 1)]


def test_a_word_of_every_document_and_a_very_long_text(spark):
    rng = random.Random(8)
    long = " ".join(rng.choices(["the"] * 9 + [f"w{i}" for i in range(50)], k=30_000))
    docs = [(i, "the " * 40 + f"w{i % 50} the the") for i in range(300)] + [(7_000, long)]
    items = [(1, "the " * 10), (2, "the the w3 the the"), (3, " ".join(long.split()[15_000:15_030]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(index.contamination(d, b, size=4_000)) == plain(docs, items, 10)


@pytest.mark.parametrize("size", [60, 1_000_000])
def test_proximity_against_every_stretch(spark, size):
    docs, items = made(21, "a b c d e f g h i j k l", 40)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    length, within = 4, 7
    want = []
    for key, text in docs:
        w, best = words(text), {}
        for n, (item, body) in enumerate(items):
            for x in cut(body, length):
                for i in range(len(w)):
                    for size_ in range(1, min(within, len(w) - i) + 1):
                        if set(x) <= set(w[i : i + size_]):
                            best[n] = min(best.get(n, (99, 0, 0)), (size_, i, item))
                            break
        want += [(str(key), str(item), i, size_) for size_, i, item in best.values()]
    out = [(str(r.doc_id), str(r.item_id), r.start, r.length) for r in index.near(d, b, length=length, within=within, size=size).collect()]
    assert sorted(out) == sorted(want)
    assert index.near(d, b.filter("false")).count() == 0
