import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwright.llm import bpe

P = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
ENCODER = bpe.Encoder(bpe.Vocabulary(open(P, encoding="utf-8").read()))
random.seed(3)
TEXTS = ["", " ", "  a  b\n\n c ", "x\n", "a<|endoftext|>b <|endoftext|> c", "a" * 5001, "日本語 テスト　x", "don't I'LL 's", "😀😀 😀", "\r\n\r\n x", "".join(random.choices("abcdefgh", k=6000)), "The end. " * 5000]


def held(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P)
    for text, ids in zip(texts, ENCODER.encode(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert ENCODER.decode(ids) == t.decode(want, skip_special_tokens=False)


def test_matches_the_library():
    held(TEXTS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=5))
def test_matches_the_library_on_any_text(texts):
    held(texts)


def test_digests_with_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (3, "", "y")]
    out = bpe.digests(spark.createDataFrame(rows, "doc_id int, text string, ids string"), P).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted((str(d), *bpe.brute_force(t or "", P)) for d, t, _ in rows)
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), P).count() == 0
