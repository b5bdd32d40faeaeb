"""Bloom filters, and overlap against a plain search."""

import random

import numpy as np
import pytest

from tarnwright.operators import bloom, overlap


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    rng = np.random.default_rng(1)
    held, other = rng.integers(-(1 << 63), 1 << 63, 20_000), rng.integers(-(1 << 63), 1 << 63, 20_000)
    form = bloom.shape(len(held), 0.01)
    df = spark.createDataFrame([(int(x),) for x in held] + [(None,)], "v long").repartition(5)
    both = bloom.merged(bloom.build(df.filter("v > 0"), "v", form), bloom.build(df.filter("v <= 0 OR v IS NULL"), "v", form))
    f = bloom.Filter(both, form)
    assert f.holds(held.view(np.uint64)).all() and 0 < f.holds(other.view(np.uint64)).mean() < 0.02
    assert (f.bits == bloom.Filter(bloom.build(df, "v", form), form).bits).all()
    assert bloom.shape(10**12) is None and not bloom.Filter(bloom.build(df.filter("false"), "v", form), form).holds(held.view(np.uint64)).any()
    with pytest.raises(ValueError):
        bloom.shape(5, 0.0)


def plain(docs, items, length):
    out = []
    for key, text in docs:
        w = (text or "").lower().split()
        hits = {}
        for item, body in items:
            v = (body or "").lower().split()
            n = min(length, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n and item is not None else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hits.setdefault(item, set()).update(range(i, i + n))
        for item, at in hits.items():
            spans = [[i, i + 1] for i in sorted(at)]
            for a, b in zip(spans[-2::-1], spans[:0:-1], strict=False):
                if a[1] == b[0]:
                    a[1], b[0] = b[1], None
            out.append((key, item, len(w), len(at), len(at) / len(w), [tuple(s) for s in spans if s[0] is not None]))
        if not hits:
            out.append((key, None, len(w), 0, 0.0, []))
    return sorted(out, key=str)


def test_overlap_against_a_plain_search(spark):
    rng = random.Random(2)
    some = lambda k: rng.choice([" ", "\n", " \t"]).join(rng.choices("a b c D é".split(), k=k))
    items = [(i, some(n)) for i, n in enumerate([1, 2, 3, 4, 5, 9, 30])] + [(2, "x y z"), (None, "a b c"), (7, None), (8, " "), (9, "q")]
    docs = [(i, some(rng.choice([0, 1, 3, 8, 60]))) for i in range(50)] + [(5, "x y z x y z"), (5, "x y z x y z"), (None, "b x y z"), (90, None), (91, "")]
    d = spark.createDataFrame([(k, t, "g") for k, t in docs], "doc_id long, text string, gram string").repartition(3)
    b = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, pos int")
    for length, share in ((3, 0.01), (4, 0.9)):  # nearly all n-grams pass the second filter
        out = [(r.doc_id, r.item_id, r.n_words, r.covered, r.share, [tuple(s) for s in r.spans]) for r in overlap.overlap(d, b, length=length, false_share=share).collect()]
        assert sorted(out, key=str) == plain(docs, items, length)
    nothing = overlap.overlap(d, b.filter("false")).collect()
    assert len(nothing) == len(docs) and all(r.item_id is None and r.spans == [] for r in nothing)
    assert overlap.overlap(d.filter("false"), b).count() == 0


def test_what_is_shuffled_has_passed_the_filter(spark):
    d = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 5000}" for k in range(100))) for i in range(200)], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(700, 730)))], "item_id long, text string")
    out = overlap.overlap(d, b).filter("item_id IS NOT NULL")
    assert sorted((r.doc_id, r.covered) for r in out.collect()) == sorted((k, len(at)) for k in range(200) if len(at := [i for i in range(100) if 700 <= k * 7 + i < 730]) >= 8)
