"""Recall of near-duplicate vectors where a label is dense."""

import numpy as np
import pytest

from tarnwright.llm import embedding_dedup


def dense(n, pairs, seed=5, dims=64, cosine=0.8, at=0.931):
    """Unit vectors, a third of them a hot label with cosines of about 0.8, and pairs of the hot label at a cosine."""
    rng = np.random.default_rng(seed)
    even = embedding_dedup.unit(rng.standard_normal((n - n // 3, dims)))
    center = embedding_dedup.unit(rng.standard_normal((1, dims)))
    hot = embedding_dedup.unit(cosine**0.5 * center + (1 - cosine) ** 0.5 * embedding_dedup.unit(rng.standard_normal((n // 3, dims))))
    a = hot[:pairs]
    w = rng.standard_normal(a.shape)
    w = embedding_dedup.unit(w - (w * a).sum(axis=1, keepdims=True) * a)
    return even, hot, at * a + (1 - at**2) ** 0.5 * w


def test_forest_finds_pairs_of_a_dense_label_at_depth_9():
    even, hot, partner = dense(10_000, 800)
    labels = np.array(["even"] * len(even) + ["hot"] * len(hot))
    sample = np.concatenate([even, hot])
    found = embedding_dedup.forest(sample, labels, 9, 131_072, embedding_dedup.THRESHOLD)
    met = found.together(hot[:800], partner)[-1].any(axis=0).mean()
    before = embedding_dedup.Forest(sample, 9).together(hot[:800], partner)[-1].any(axis=0).mean()
    print(f"depth {found.depth}, {len(found.directions)} trees: {met:.4f}; 8 trees of depth 9: {before:.4f}")
    assert met >= 0.995 > before


def test_pairs_of_a_dense_label_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    even, hot, partner = dense(4_000, 300)
    rows = [(i, "hot", x.tolist()) for i, x in enumerate(np.concatenate([hot, partner]))] + [(10_000 + i, "even", x.tolist()) for i, x in enumerate(even)]
    every = embedding_dedup.unit(np.concatenate([hot, partner]))
    links = (every @ every.T >= embedding_dedup.THRESHOLD).sum(axis=1) - 1
    out = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert len(out) == len(rows) and all(out[i] <= n for i, n in enumerate(links))
    assert sum(out[i] for i in range(len(every))) >= 0.995 * links.sum() > 0


@pytest.mark.parametrize("depth", [5, 7, 9, 12, 16])
def test_recall_by_depth(depth):
    """Trees of each depth, as many as forest() may take; from depth 10 levels lie below those that 10,000 vectors fit."""
    even, hot, partner = dense(10_000, 800)
    sample = np.concatenate([even, hot])
    trees = embedding_dedup.Forest(sample, depth, embedding_dedup.MOST_TREES)
    assert trees.fitted == min(depth, 9)
    met = trees.together(hot[:800], partner)[-1].any(axis=0).mean()
    rows, codes = trees.leaves(hot)
    largest = np.unique(codes, return_counts=True)[1].max()
    print(f"depth {depth}: {met:.4f}, of {len(hot)} the largest leaf has {largest}")
    assert met >= 0.98 and largest < len(hot) * 0.75**depth + 40


def test_depth_follows_the_largest_label():
    even, hot, _ = dense(10_000, 100)
    labels = np.array(["even"] * len(even) + ["hot"] * len(hot))
    found = embedding_dedup.forest(np.concatenate([even, hot]), labels, 20, 256 << 20, embedding_dedup.THRESHOLD)
    print(f"268 million vectors: depth {found.depth}, {len(found.directions)} trees")
    assert found.depth > 9


def test_chosen_forest_end_to_end(spark):
    """The forest that a table of its size gets, with splits, against all cosines: dense labels, pairs just above the threshold, a
    label beside it with few vectors, and columns of clashing names."""
    even, hot, partner = dense(3_000, 400, seed=9)
    small, _, _ = dense(30, 5, seed=4)
    rows = [(i, "hot", x.tolist()) for i, x in enumerate(np.concatenate([hot, partner]))] + [(10_000 + i, "even", x.tolist()) for i, x in enumerate(even)]
    rows += [(20_000 + i, "small", x.tolist()) for i, x in enumerate(np.concatenate([small, small + 0.001]))]
    labels, every = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    every = every / np.linalg.norm(every, axis=1, keepdims=True)
    near = (every @ every.T >= embedding_dedup.THRESHOLD) & (labels[:, None] == labels[None, :])
    want = {r[0]: int(n) - 1 for r, n in zip(rows, near.sum(axis=1), strict=True)}
    known = embedding_dedup.forest(every, labels, 5, int((labels == "even").sum()), embedding_dedup.THRESHOLD)
    assert known.depth >= embedding_dedup.LEVELS
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").selectExpr("*", "1 AS cid", "2 AS k1", "3 AS code", "4 AS block", "5 AS leaves")
    out = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert sum(want.values()) > 800 and out == want
