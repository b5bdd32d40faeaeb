import numpy as np
import pytest

from tarnwright.llm import components as united
from tarnwright.llm import embedding_dedup as op
from tarnwright.llm.components import components


def brute(rows, threshold=op.THRESHOLD):
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ok):
        for j in ok[:a]:
            (_, u, x), (_, v, y) = rows[i], rows[j]
            if x == y and len(u) == len(v) and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted((str(d), links[i], str(min((x for x in least[find(i)] if x is not None), default=None))) for i, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("leaf,block", [(256, 1024), (16, 24)])
def test_matches_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(op, "LEAF", leaf)
    monkeypatch.setattr(op, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 24))
    vectors = [(base[i % 60] + rng.standard_normal(24) * 0.12 * (i % 3)).astype(np.float32).tolist() for i in range(400)]
    vectors += [(base[0] + rng.standard_normal(24) * 0.02).astype(np.float32).tolist() for _ in range(80)]
    rows = [(1000 - i, v, i % 60 % 2) for i, v in enumerate(vectors)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [None] * 24, 1), (2004, vectors[0], None), (2005, vectors[0][:5], 0), (2006, [], 0), (5, vectors[3], 1), (5, vectors[3], 1), (None, vectors[4], 0), (2007, [float("inf")] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    out = op.near_duplicates(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)


def test_many_lengths_and_extreme_numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(1000 * d + i, (v + rng.standard_normal(d) * 0.01 * (i % 3)).tolist(), d % 2) for d in range(2, 90) for v in [rng.standard_normal(d)] for i in range(4)]
    rows += [(1, [1e200, 2e200], 0), (2, [1e-200, 2e-200], 0), (3, [1.0, 2.0], 0), (4, [3e307, 1e307], 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, cid int, `k1` string")
    out = {r.vec_id: (r.n_links, r.component_id) for r in op.near_duplicates(df).collect()}
    scaled = [(i, (np.array(v) / np.abs(v).max()).tolist(), lab) for i, v, lab in rows]
    assert sorted((str(i), *map(lambda x: x, (n, str(c)))) for i, (n, c) in out.items()) == brute(scaled)
    assert out[1][0] >= 2 and out[1][1] == 1


def test_empty(spark):
    assert op.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("local", [200_000, 7, 0])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(united, "LOCAL", local)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (103, 103)] + [(200, i) for i in range(201, 220)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for n, r in out.items():
        groups.setdefault(r, set()).add(n)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert sorted(map(sorted, groups.values())) == [[*range(61)], [100, 101, 102], [*range(200, 220)]]
