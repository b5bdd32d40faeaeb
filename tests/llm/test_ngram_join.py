import random
import re

import numpy as np
import pytest

from tarnwright.llm import ngram_join as op


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= percent * (len(a) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted((str(d), len(sets[i]), str(min((x for x in least[find(i)] if x is not None), default=None))) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = [[word() for _ in range(rng.randrange(1, 200))] for _ in range(60)]
    texts += [t[:a] + passage + t[a:] for t in texts[:30] for a in [rng.randrange(len(t))]]
    for t in list(texts):
        for _ in range(rng.randrange(4)):
            t = list(t)
            for _ in range(rng.randrange(1, 2 + len(t) // 60)):
                t[rng.randrange(len(t))] = word()
            texts.append(t)
    hot = [word() for _ in range(150)]
    for _ in range(60):
        t = list(hot)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    rng.shuffle(texts)
    rows = [(i * 3 % 1009 + 5, (" " if rng.random() < 0.8 else "\n").join(t)) for i, t in enumerate(texts)]
    return rows + [(1, None), (2, ""), (3, " \t"), (4, "Ab C"), (4, "ab c"), (None, "aB  c"), (None, "alone in here"), (2000, "ÄB c"), (2001, "äb c"), (2002, "a a a a a a a"), (2003, "a a a a a")]


@pytest.mark.parametrize("words,percent,block,small", [(4, 85, 1024, 32), (5, 80, 16, 4), (1, 50, 1024, 4)])
def test_matches_brute_force(spark, monkeypatch, words, percent, block, small):
    monkeypatch.setattr(op, "SMALL", small)
    monkeypatch.setattr(op, "BLOCK", block)
    rows = corpus(words)
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id int, text string, n int").repartition(5)
    out = op.join(docs, words, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute(rows, words, percent)


def test_token_in_every_document(spark, monkeypatch):
    """A passage that all texts have, in many messages, tasks, salted pairs and blocks."""
    monkeypatch.setattr(op, "RUN", 200)
    monkeypatch.setattr(op, "SALT", 8)
    monkeypatch.setattr(op, "BLOCK", 32)
    monkeypatch.setattr(op, "BROADCAST_ROWS", 20)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(240):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([0, 3, 5, 6, 8, 9, 40]))]
        rows.append((i, " ".join(passage + own)))
    for i in range(60):
        rows.append((1000 + i, rows[i * 3][1] + (" z" * (i % 2))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = op.join(docs, 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute(rows, 4, 85)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(2, "a b c d e f g", 1, 5, 6, 7), (1, "A b c d e f g", 2, 5, 6, 7), (3, "x", 3, 5, 6, 7)], "doc_id long, text string, `gone` int, `__gone` int, `row` int, `a.b``c` int")
    out = op.representatives(docs)
    assert out.columns == docs.columns and sorted(r[2] for r in out.collect()) == [2, 3]


def test_very_long_row(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "z" * 3_000_000), (4, "short text of five words")], "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in op.join(docs).collect()}
    assert out == {1: (299_997, 1), 2: (299_998, 1), 3: (1, 3), 4: (2, 4)}


def test_bounds():
    for percent in (50, 70, 80, 85, 95, 100):
        for n in range(1, 300):
            for m in range(-(-n * percent // 100), n + 1):
                shared = -(-percent * max(n, m) // 100)  # at least so many
                both = min(op.prefix_length(n, percent) - n + shared, op.prefix_length(m, percent) - m + shared)
                assert op.need(n, percent) <= both and op.need(m, percent) <= both


def test_representatives_and_empty(spark):
    docs = spark.createDataFrame([(2, "a b c d e f g", 1), (1, "A b c d e f g", 2), (3, "x", 3), (None, "x", 4)], "doc_id long, text string, keep int")
    assert sorted(r.keep for r in op.representatives(docs).collect()) == [2, 3, 4]
    assert op.join(docs.filter("false")).count() == 0 and op.representatives(docs.filter("false")).count() == 0


def test_shared_values_against_sets(monkeypatch):
    rng = np.random.default_rng(1)
    for n, most, strip in ((1, 5, 100), (7, 30, 100), (40, 60, 64), (40, 400, 4_000_000)):
        monkeypatch.setattr(op, "STRIP", strip)
        sets = [np.unique(rng.integers(0, most, rng.integers(0, 80))) for _ in range(n)]
        out = op._together(np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets]), n)
        for i in range(n):
            for j in range(n):
                if i != j:
                    assert out[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_blocks_hold_every_pair_of_a_list_once(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 8)
    monkeypatch.setattr(op, "ENTRIES", 300)
    rng = random.Random(4)
    lists = {t: rng.sample(range(t * 5, t * 5 + 30), 12) for t in range(40)} | {99: list(range(0, 200, 3)), 100: list(range(1_000, 1_006))}
    rows = [(t, len(c), min(c), i) for t, c in lists.items() for i in c]
    cids = sorted({r[3] for r in rows})
    out = op._dealt(spark.createDataFrame(rows, "token long, m long, least long, cid long"), spark.createDataFrame([(c, rng.randrange(1, 80)) for c in cids], "cid long, n long")).collect()
    met, sizes = {}, {}
    for r in out:
        sizes.setdefault((r.root, r.one, r.two), []).append(r.cid)
        met.setdefault((r.root, r.one, r.two), []).append((r.block, r.cid))
    assert max(map(len, sizes.values())) < 80 < len(cids) and all(len(set(x)) == len(x) for x in sizes.values())
    pairs = [tuple(sorted((a, b))) for (_, one, two), x in met.items() for k, a in x for m, b in x if a < b and (one == two or k != m)]
    assert len(pairs) == len(set(pairs))
    assert {tuple(sorted((a, b))) for c in lists.values() for a in c for b in c if a < b} <= set(pairs)


def test_long_sets_in_blocks_take_bounded_memory():
    """1,000 classes of 8,000 n-grams, of which any two share few: a dense matrix of them would take 25 GB."""
    import resource

    import pyarrow as pa

    rng = np.random.default_rng(3)
    n, size = 1_000, 8_000
    sets = np.sort(rng.integers(0, 1 << 60, (n, size)), axis=1)
    sets[:, :4] = np.arange(4)  # n-grams that all have
    sets[1::2, 4 : size // 2] = sets[::2, 4 : size // 2]
    column = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
    zero = pa.array(np.zeros(n, np.int64))
    table = pa.table({"one": zero, "two": zero, "block": zero, "cid": np.arange(n), "comp": np.arange(n), "n": np.full(n, size), **{c: column(sets[:, :6]) for c in ("first", "second", "third")}, "set": column(sets)})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = op._compare(30)(table)
    assert sorted(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)) == [(i + 1, i) for i in range(0, n, 2)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB
