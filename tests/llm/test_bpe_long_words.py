"""Very long words: the rounds give the library's ids, in time that hardly grows faster than the word."""

import random
import time
from pathlib import Path

import pytest
from tokenizers import Tokenizer

from tarnwright.llm import bpe
from tarnwright.llm.queries import tokenizer


def test_rounds_on_long_words():
    path = tokenizer("byte_bpe_50k.json")
    v, library = bpe.Vocabulary(Path(path).read_text(encoding="utf-8")), Tokenizer.from_file(path)
    rng = random.Random(3)
    words = ["".join(rng.choices(letters, k=n)) for letters in ("abcdeinorst", "ab", "é漢ñ", "-=", "aaab") for n in (1, 2, 50, 127, 128, 129, 300, 2500, 4000)]
    words += ["a" * 3001, "ab" * 1501, "é" * 1500, "aab" * 700 + "a" * 400, "-" * 5000]
    for w, ids in zip(words, v.encode_words([w.encode() for w in words]), strict=True):
        if len(v_words := bpe.regex.findall(bpe.PATTERN, w)) == 1:
            assert ids.tolist() == library.encode(w, add_special_tokens=False).ids, v_words[0][:40]
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    began = time.perf_counter()
    assert v.encode_words([long.encode()])[0].tolist() == library.encode(long, add_special_tokens=False).ids
    assert time.perf_counter() - began < 60


def test_order_of_merges_is_checked():
    source = '{"added_tokens": [], "model": {"vocab": %s, "merges": %s}}'
    chars = list(bpe._byte_chars().values())
    vocab = {c: i for i, c in enumerate([*chars, "ab", "abc"])}
    import json

    assert bpe.Vocabulary(source % (json.dumps(vocab), json.dumps(["a b", "ab c"]))).longest == 3
    with pytest.raises(ValueError, match="later one makes"):
        bpe.Vocabulary(source % (json.dumps(vocab), json.dumps(["ab c", "a b"])))
