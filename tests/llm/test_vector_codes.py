"""Codes against plain rounds of Lloyd's in whole numbers."""

import hashlib
import math
import random

import numpy as np

from tarnwright.llm import vector_codes as vc


def plain(rows, parts, entries, rounds):
    kept = [(k, v, g) for k, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1])
    width = -(-length // parts)
    kept = [(k, [max(-vc.LARGEST, min(vc.LARGEST, math.floor(256 * x))) for x in v] + [0] * (parts * width - length), g) for k, v, g in kept if len(v) == length]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, v, _ in kept:
                of.setdefault(nearest(p, cut(v)[p])[1], []).append(cut(v)[p])
            for i, xs in of.items():
                books[p][i] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, total = [], {}
    for k, v, g in kept:
        best = [nearest(p, x) for p, x in enumerate(cut(v))]
        out.append((str(k), "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), g))
        total[g] = total.get(g, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((k, code, error, total[g], sha) for k, code, error, g in out)


def check(spark, rows, parts=4, entries=6, rounds=2):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS code", "2 AS vector", "3 AS `key`").repartition(3)
    rows = [(k, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None, g) for k, v, g in rows]
    out = [tuple([str(r[0]), *r[1:]]) for r in vc.encode(df, parts=parts, entries=entries, rounds=rounds).collect()]
    assert sorted(out) == plain(rows, parts, entries, rounds)


def test_codes_against_plain_rounds(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice([0, 0, 0, 1, None])) for i in range(200)]
    rows += [(300, None, 1), (301, [], 1), (302, [None] * 8, 0), (303, [math.nan] + [0.0] * 7, 0), (304, [math.inf] + [0.0] * 7, None), (305, [0.0] * 8, 2), (306, [1.0] * 5, 2), (None, [0.5] * 8, None), (None, [0.25] * 8, 1)]
    rows += [(2, rows[2][1], 0), (2, rows[9][1], 0), (400, rows[7][1], 1)]
    for rounds in (0, 1, 2, 5):
        check(spark, rows, rounds=rounds)


def test_ties_equal_entries_few_rows_and_other_lengths(spark):
    check(spark, [(i, [float(i % 2)] * 7, None) for i in range(20)], parts=3, entries=5)  # equal entries: the lowest; filled up
    check(spark, [(1, [0.1, -0.1], 4), (2, [0.3, 0.4], 4)], parts=2, entries=64)
    check(spark, [(1, [1e30, -1e30, 3.0, 1e-30], 4), (2, [70_000.0, -0.001, 3.0, 0.0], 4), (3, [9e4, 5.0, -3e38, 1.0], 5)], parts=2, entries=2)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vc.encode(empty).collect() == []


def test_only_changed_parts_are_shuffled(spark):
    """Of the second round's changes every one is taken from its old entry, and rows whose code stayed bring none."""
    import pyarrow as pa

    x = np.arange(12).reshape(3, 4)
    code = lambda *c: bytes(c)
    batch = pa.RecordBatch.from_arrays([vc._binary(x.astype("<i4")), pa.array([code(0, 1), code(1, 1), None]), pa.array([code(0, 1), code(0, 1), code(1, 0)])], ["vector", "before", "code"])
    (out,) = vc._changes(2, 2, 2)(iter([batch]))
    assert out.to_pylist() == [
        {"part": 0, "entry": 0, "n": 1, "sums": [4, 5]}, {"part": 0, "entry": 1, "n": 0, "sums": [4, 4]}, {"part": 1, "entry": 0, "n": 1, "sums": [10, 11]},
    ]
