"""Runs against a search of every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tarnwright.llm import periodic_runs as pr


def plain(w):
    """Every (start, length, period) of a list of words."""
    n, out = len(w), {}
    for q in range(1, n // pr.COPIES + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(pr.LEAST, pr.COPIES * q) and j > i:
                out.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((b, n_, q) for (b, n_), q in out.items())


def sequences():
    rng = random.Random(1)
    for k in (1, 2, 3, 4, 9):
        for n in (0, 1, 5, 6, 7, 30, 120, 400):
            yield [rng.randrange(k) for _ in range(n)]
    for _ in range(150):  # blocks repeated, broken here and there, and within each other
        s = []
        while len(s) < 150:
            piece = [rng.randrange(rng.choice([2, 3, 20])) for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))]
            s += (piece * rng.choice([1, 4, 5, 7, 12]))[: rng.choice([4, 20, 60])] + [rng.randrange(20) for _ in range(rng.choice([0, 0, 1, 6]))]
        s = s * rng.choice([1, 1, 2, 5])
        if rng.random() < 0.5:
            s[rng.randrange(len(s))] = 99
        yield s
    a, b = [0], [0, 1]  # Fibonacci and Thue-Morse words
    while len(b) < 600:
        a, b = b, b + a
    yield b
    yield [bin(i).count("1") % 2 for i in range(512)]
    yield [0] * 700


def test_runs_against_every_period():
    for s in sequences():
        assert [tuple(r) for r in pr.runs(s)] == plain(s), s


def test_factors_are_the_longest_earlier_pieces():
    for s in sequences():
        if len(s) > 160:
            continue
        end = 0
        for a, b, source in pr.factors(s):
            assert a == end
            end = b
            longest = max((k for src in range(a) for k in range(1, len(s) - a + 1) if s[src : src + k] == s[a : a + k]), default=0)
            assert b - a == max(1, longest) and (source == -1) == (longest == 0)
            assert longest == 0 or (source < a and s[source : source + longest] == s[a:b])
        assert end == len(s)


def test_stretches_lose_no_run():
    for s in sequences():
        kept = pr.stretches(np.array(s, np.int64), np.zeros(len(s), np.int64))
        for b, n, _ in plain(s):
            assert any(a <= b and b + n <= e for a, e in kept)
    # nothing of a text without runs goes on
    rng = random.Random(4)
    assert pr.stretches(np.array([rng.randrange(60) for _ in range(50_000)]), np.zeros(50_000, np.int64)) == []


def collapsed(w):
    dropped = {i for b, n, q in plain(w) for i in range(b + q, b + n)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def texts():
    rng = random.Random(2)
    out = [(i, " ".join(rng.choice("a b c A é".split()) for _ in range(rng.choice([0, 3, 6, 50, 200])))) for i in range(40)]
    out += [(100 + i, rng.choice([" ", "\n", "\t \r\n"]).join(["x"] * i + ["y", "z"] * 5)) for i in range(9)]
    return [*out, (200, None), (201, ""), (202, " \n "), (203, "one\x1cone one one " * 5), (204, "a " * 5), (205, "a " * 6), (205, "a " * 6), (None, "b c " * 8)]


def test_documents_against_every_period(spark):
    rows = texts()
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, runs int").repartition(3)
    out = [(str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in pr.periodic_runs(df).collect()]
    want = [(str(k), len(w), plain(w), collapsed(w)) for k, t in rows for w in [[x.decode() for x in (t or "").encode().split()]]]
    assert sorted(out, key=str) == sorted(want, key=str)
    assert pr.periodic_runs(df.filter("false")).count() == 0


def test_digest(spark):
    df = spark.createDataFrame([(1, "p a b a b a b a b q q q q q q q q"), (2, "x"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in pr.digest(pr.periodic_runs(df)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert tuple(out[1])[1:] == (2, 1, 8, 2, 4000, sha("1,8,2\n9,8,1\n"), sha("p a b q"))
    assert tuple(out[2])[1:] == (0, None, None, None, None, sha(""), sha("x"))
    assert tuple(out[3])[1:] == (0, None, None, None, None, sha(""), sha(""))


@pytest.mark.parametrize("words", [0, 1, 2, 30])
def test_planted_tails(spark, words):
    df = spark.createDataFrame([(i, " \n".join(f"w{k}" for k in range(words))) for i in range(300)] + [(None, "a b"), (30_000, None)], "doc_id long, text string")
    out = pr.with_periodic_tails(df).collect()
    assert len(out) == 302
    for r in out:
        if r.doc_id is None or r.text is None:
            assert r.text in ("a b", None)
            continue
        h = zlib.crc32(str(r.doc_id).encode())
        w = [f"w{k}" for k in range(words)]
        if h % 10 == 0 and words:
            g = h // 10
            a = g % words
            p = 1 + (words - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(words)]
        assert r.text.split() == w


def test_long_texts_take_time_in_proportion():
    import time

    took = []
    for n in (20_000, 80_000):
        rng = random.Random(3)
        s = [rng.randrange(5_000) for _ in range(n // 5)] * 5
        start = time.perf_counter()
        assert [tuple(r) for r in pr.runs(s)][-1] == (0, len(s), n // 5)
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0]


def by_numpy(codes):
    found, n = {}, len(codes)
    for q in range(1, n // pr.COPIES + 1):
        same = np.concatenate([[0], codes[:-q] == codes[q:], [0]]).astype(np.int8)
        for i, j in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            if j - i + q >= max(pr.LEAST, pr.COPIES * q):
                found.setdefault((int(i), int(j - i + q)), q)
    return sorted((b, n_, q) for (b, n_), q in found.items())


def test_query_against_every_period(spark):
    from tarnwright.llm import queries

    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf).collect()}
    docs = queries.table(spark, sf, "documents").collect()
    assert len(out) == len(docs) and any(r.n_runs > 1 for r in out.values())
    for d in docs:
        w = [x.decode() for x in d.text.encode().split()]
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = by_numpy(np.unique(w, return_inverse=True)[1]) if w else []
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        dropped = {i for b, k, q in runs for i in range(b + q, b + k)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want = (len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{b},{k},{q}\n" for b, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))
        assert tuple(out[d.doc_id])[1:] == want, d.doc_id
