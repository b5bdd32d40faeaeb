"""Vector search against all cosines."""

import numpy as np
import pytest

from tarnwright.operators import neighbors as nb


def clustered(n, d=16, centers=12, seed=0, spread=0.5):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centers, d))
    hot = np.where(rng.random(n) < 0.33, 0, rng.integers(0, centers, n))  # a third about one centre
    return (c[hot] + spread * rng.normal(size=(n, d))).astype(np.float32)


def exact(x, queries, k):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = np.round(u[queries] @ u.T, nb.DIGITS)
    out = {}
    for q, row in zip(queries, near, strict=True):
        row[q] = -9
        out[int(q)] = [int(i) for i in np.lexsort([np.arange(len(row)), -row])[: min(k, len(row) - 1)]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query, r.place)):
        out.setdefault(r.query, []).append(r.key)
    return out


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)], "vec_id long, embedding array<float>, cell string").repartition(3)


@pytest.mark.parametrize("part,asked,probe", [(20_000, 2_000, 4), (100, 7, 1)])
def test_certain_search_is_exact(spark, part, asked, probe):
    x = clustered(1_500)
    x[700:720] = x[3]  # equal vectors
    at = nb.index(nb.units(frame(spark, x), "vec_id", "embedding"), cells=30, part=part)
    queries = nb.units(frame(spark, x).filter("vec_id % 20 = 0 OR vec_id = 3"), "vec_id", "embedding")
    assert got(nb.search(at, queries, 10, probe=probe, asked=asked)) == exact(x, np.array([i for i in range(1_500) if i % 20 == 0 or i == 3]), 10)


def test_recall_of_the_nearest_cells_alone(spark):
    x = clustered(4_000, seed=2)
    units = nb.units(frame(spark, x), "vec_id", "embedding")
    want = exact(x, np.arange(0, 4_000, 20), 10)
    out = got(nb.search(nb.index(units), units.filter("key % 20 = 0"), 10, probe=12, certain=False))
    assert np.mean([len(set(out[q]) & set(want[q])) / 10 for q in want]) >= 0.95


def test_null_zero_few_and_repeated_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [1e-30, 1e-30]), (8, [-3e38, 3e38])]
    units = nb.units(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert sorted(r.key for r in units.collect()) == [1, 2, 2, 7, 8]
    assert all(abs(sum(v * v for v in r.vector) - 1) < 1e-12 for r in units.collect())
    assert got(nb.search(nb.index(units, cells=2), units, 3)) == {1: [2, 2, 7], 2: [1, 7, 8], 7: [2, 2, 1], 8: [7, 2, 2]}
    none = units.filter("false")
    assert nb.search(nb.index(none), units).count() == 0 and nb.search(nb.index(units), none).count() == 0
