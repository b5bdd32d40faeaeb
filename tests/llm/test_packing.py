import random
import zlib

import numpy as np
import pytest

from tarnwright.llm import packing as op

P = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
TEXTS = [None, "", " \n ", "Hello, World!", "\x1cx\x1d y\x85z", "<|endoftext|> a<|startoftext|>b", "ΟΔΟΣ ΟΔΟΣ. é ́", "a b　c\xa0d", "The cat sat. " * 3000, "x" * 3000]


def library_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P)
    t.no_padding()
    t.no_truncation()
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("n", [0, 1, 5, 400])
def test_assign_covers_every_token_once(n):
    rng = random.Random(n)
    lengths = [rng.choice([1, 3, 100, 900, 2047, 2048, 2049, 5000, 1025]) for _ in range(n)]
    found = op.assign(lengths)
    for d, length in enumerate(lengths):
        mine = sorted((s, k) for x, s, k, _, _ in found if x == d)
        assert [s for s, _ in mine] == [sum(k for _, k in mine[:i]) for i in range(len(mine))] and sum(k for _, k in mine) == length
    by = {}
    for _, _, k, seq, off in found:
        by.setdefault(seq, []).append((off, k))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(k for _, k in parts[:i]) for i in range(len(parts))] and sum(k for _, k in parts) <= 2048
    assert len(by) == -(-sum(lengths) // 2048) and sorted(by) == [*range(len(by))]


def test_costs_are_balanced():
    lengths = [1000] * 100 + [10] * 200
    cost = {}
    for _, _, k, seq, _ in op.assign(lengths):
        cost[seq] = cost.get(seq, 0) + op.LINEAR * k + k * k
    assert max(cost.values()) <= 1.05 * min(sorted(cost.values())[1:])


def test_pack_matches_the_library(spark):
    rows = [(i, t, "e") for i, t in enumerate(TEXTS)] + [(3, "Hello, World!", "e"), (None, "again", "e")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, offset string").repartition(3)
    out = op.pack(docs, P, with_ids=True).collect()
    whole, by = {}, {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        assert r.offset == by.get(r.sequence_id, 0) and r.offset + r.length <= 2048
        by[r.sequence_id] = r.offset + r.length
    for d, t, _ in rows:
        ids = np.array(library_ids(t), "<u4").tobytes()
        mine = [r for r in out if r.doc_id == d]
        assert all(r.ids == ids[4 * r.start : 4 * (r.start + r.length)] and r.doc_tokens == len(ids) // 4 for r in mine)
        assert sum(r.length for r in mine) == len(ids) // 4 * sum(x[0] == d for x in rows)
    assert op.pack(docs.filter("false"), P).count() == 0
