import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tarnwright.llm import quality as op
from tarnwright.llm import words

WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[!-/:-@\[-^`{-~]+")


def plain_grams(text):
    """Words and pairs as bytes, by the rule in words."""
    found = WORD.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    return Counter(found) + Counter(zip(found, found[1:]))


def bucket(gram):
    column = pa.array([(b" ".join(gram) if isinstance(gram, tuple) else gram).decode()])
    return [*op.grams(column)][0][3][-1]


def corpus():
    rng = np.random.default_rng(1)
    good = ["river house stone light water green open table".split()[i] for i in range(8)]
    bad = ["$$$", "!!", "|||", "BUY", "NOW", "cheap"]
    rows = [(i, " ".join(rng.choice(bad if i % 7 == 0 else good, 40 + i % 50)), "s") for i in range(350)]
    labels = [(i, int(i % 7 != 0), 0) for i in range(0, 350, 2)]
    return rows, labels


def test_resample(spark):
    rows, labels = corpus()
    odd = [(900, None, "s"), (901, "", "s"), (3, rows[3][1], "s"), (None, rows[1][1], "s"), (902, "river house " * 30000, "s")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, key string")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (4, None, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    out = op.resample(docs, lab).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out}
    assert sum(by[i].selected for i, *_ in rows if i % 7 and i != 8) >= 298 and by[902].n_grams == 119_999
    assert sum(by[i].selected for i, *_ in rows if i % 7 == 0) < 30 and by[900].log_weight == -math.inf and not by[900].selected
    assert op.selected(docs, lab).columns == docs.columns
    assert op.selected(docs, lab).count() == sum(r.selected for r in out)
    half = op.resample(docs, lab, 178).collect()
    keys = sorted((r.key for r in half), reverse=True)
    assert sum(r.selected for r in half) in (178, 179) and min(r.key for r in half if r.selected) >= keys[178] - 1e-6
    # against plain counts
    ratios = op.log_ratios(docs, lab)
    raw, target = np.zeros(op.BUCKETS), np.zeros(op.BUCKETS)
    good = {i for i, q, _ in labels if q and i not in (8,)}
    for d, t, _ in rows + odd:
        for g, n in plain_grams(t).items():
            raw[bucket(g)] += n
            target[bucket(g)] += n * (d in good)
    want = np.log((target + op.PRIOR) / (raw * target.sum() / raw.sum() + op.PRIOR))
    assert np.allclose(ratios, want)
    for d, t, _ in rows[:20]:
        assert math.isclose(by[d].log_weight, sum(n * want[bucket(g)] for g, n in plain_grams(t).items()), abs_tol=1e-9)


def test_draw_follows_weights(spark):
    """Short texts, whose weights are near each other: two seeds draw differently, and as the weights say."""
    rng = np.random.default_rng(3)
    ratios = np.zeros(op.BUCKETS)
    texts = [("a", 0.0), ("b", 1.0), ("c", 2.0)]
    for t, weight in texts:
        ratios[bucket(t.encode())] = weight
    which = rng.integers(0, 3, 30_000)
    docs = spark.createDataFrame([(i, texts[k][0]) for i, k in enumerate(which.tolist())], "doc_id long, text string")
    drawn = []
    for seed in (1, 2):
        rows = op.weighed(docs, ratios, seed).withColumn("placed", op.placed(F.col("key")))
        drawn.append({r.i for r in rows.filter(F.col("placed") >= op.kth_largest(rows, "placed", 1500)).select(F.col("row.doc_id").alias("i")).collect()})
    assert len(drawn[0]) == len(drawn[1]) == 1500 and len(drawn[0] & drawn[1]) < 400
    # of few drawn from many, each kind's share is that of its weight, 1 : e : e * e
    for one in drawn:
        n = np.bincount([which[i] for i in one], minlength=3) / 1500
        want = np.array([1, math.e, math.e**2]) * np.bincount(which)
        assert np.abs(n - want / want.sum()).max() < 0.04


def test_held_out_labels(spark):
    """Half of the labels are learnt from; of the others good rows stay and most bad ones go."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 2
    found = op.resample(docs, labels.filter(fold == 0)).join(labels.filter(fold == 1).select("doc_id", "quality"), "doc_id")
    by = {(r.quality, r.selected): r.n for r in found.groupBy("quality", "selected").agg(F.count("*").alias("n")).collect()}
    assert by[1, True] >= 0.995 * (by[1, True] + by.get((1, False), 0))
    assert by[0, False] >= 0.8 * (by.get((0, True), 0) + by[0, False])


def test_clashing_names(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 1.0, "x", 2, 3) for r in rows], "doc_id long, text string, log_weight string, key double, `a``b.c` string, row int, placed int")
    lab = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, text int, good int")
    out = op.selected(docs, lab)
    assert out.columns == docs.columns and {r[6] for r in out.collect()} == {3} and out.count() > 290
    assert op.resample(docs, lab).count() == 350


def test_without_labels_all_stay_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert op.selected(docs, none).count() == 2 and op.resample(docs.filter("false"), none).count() == 0


def test_kth_largest(spark):
    values = [int(x) for x in np.random.default_rng(2).integers(0, 1 << 48, 500)] + [7, 7, 7]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 250, 501, 503):
        assert op.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert op.kth_largest(df, "v", 504) == -1


def test_word_hashes(monkeypatch):
    """Chunks and runs of any length give the words that a plain rule gives."""
    monkeypatch.setattr(words, "CHUNK", 37)
    rng = np.random.default_rng(5)
    texts = [None, "", "  ", "a b", "Hello wOrld\t x", "é" * 100 + " y", "z" * 200, "end"]
    texts += ["".join(rng.choice(list("ab C\n\x0bé!"), int(n))) for n in rng.integers(0, 120, 100)]
    names: dict[bytes, int] = {}
    for kinds, cut in ((words.SPACED, bytes.split), (words.WRITTEN, WORD.findall)):
        for most in (10, 300, 10**9):
            found = [w.hashes[a:b].tolist() for w in words.hashed(pa.array(texts).slice(1), kinds, most) for a, b in zip(w.starts, w.starts[1:])]
            assert len(found) == len(texts) - 1
            for hashes, text in zip(found, texts[1:]):
                plain = cut(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), text.encode()))
                assert len(plain) == len(hashes) and all(names.setdefault(w, h) == h for w, h in zip(plain, hashes))
    assert len(set(names.values())) == len(names)
