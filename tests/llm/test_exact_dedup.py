import hashlib
import random
import re

import numpy as np
import pytest

from tarnwright.llm import exact_dedup as op


@pytest.mark.parametrize("n,bits", [(0, 20), (1, 20), (2, 8), (200, 8), (3000, 40), (5, 62)])
def test_rice_round_trip(n, bits):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, 1 << bits, n).astype(np.uint64))
    assert (op.rice_decode(op.rice_encode(values)) == values).all()


def test_messages_hold_thousands_in_few_bits():
    """10**10 rows in partitions of 1,400,000: a message of the last owner, as of the first."""
    total, each = 10**10, 1_400_000
    owners, bits = op.plan_owners(total, -(-total // each), 2_000)
    assert each / owners > 500 and total / owners <= op.PER_OWNER
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 1 << bits, each, np.uint64))
    for owner in (0, owners - 1):
        mine = values[(values * np.uint64(owners)) >> np.uint64(bits) == owner]
        mean_gap = (1 << bits) / each
        assert 8 * len(op.rice_encode(mine)) / len(mine) < 2.3 + np.log2(mean_gap)
    assert op.plan_owners(0, 0, 8)[0] == 1 and op.plan_owners(100_000, 4, 8)[0] == 8


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_groups_match_brute_force(spark):
    random.seed(5)
    texts = [None, "", " ", "a  b", "a\tb", "a b", "a b", "A b", *("w%d  x" % random.randrange(40) for _ in range(300))]
    rows = [(i * 7 % 1000, t, i) for i, t in enumerate(texts)] + [(3, "a b", 1), (3, "a b", 1), (None, "a b", 2), (None, "only", 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, row int").repartition(5)
    out = op.exact_groups(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for d, t, _ in rows:
        by.setdefault(norm(t), []).append(d)
    want = sorted((str(d), str(min((x for x in by[norm(t)] if x is not None), default=None)), len(by[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t, _ in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == want
    assert sorted(r.text_sha256 for r in out if r.kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in by)
    kept = op.exact_dedup(docs).collect()
    assert kept[0].__fields__ == ["doc_id", "text", "row"]
    assert sorted((norm(r.text), str(r.doc_id)) for r in kept) == sorted((t, str(min((x for x in d if x is not None), default=None))) for t, d in by.items())


def test_clashing_names_long_texts_and_many_runs(spark, monkeypatch):
    monkeypatch.setattr(op, "SUSPECTS", 3)
    long = "word  " * 400_000
    rows = [(2, long, 1, 5, "x", 6.0), (1, long.replace("  ", "\t"), 2, 5, "y", 6.0), (3, "z" * 2_000_000, 3, 5, "z", 6.0), (4, "a", 4, 0, None, None), (5, "a ", 5, 0, None, None), (6, "a\n", 6, 0, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `norm` int, `__fp` int, `a``b` string, `row` double").repartition(3)
    out = op.exact_dedup(docs)
    assert out.columns == docs.columns and sorted(r[2] for r in out.collect()) == [2, 3, 4, 5]
    assert sorted((r.doc_id, r.keep_id) for r in op.exact_groups(docs).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.exact_groups(docs).count() == 0 and op.exact_dedup(docs).count() == 0
