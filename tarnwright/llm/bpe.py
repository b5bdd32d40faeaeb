"""Byte-level BPE, encoded in batched rounds of merges over flat arrays.

A text is cut at single spaces between visible characters, where every match of the word pattern begins anew; each
piece is looked up in a bounded cache.  The words of all pieces not seen before are encoded at once: their symbols lie
in one flat array, and each round finds the lowest-ranked pairs by binary search over the sorted pair keys and merges
them, from left to right.  A pair is merged if none of a lower rank stands within as many symbols as the longest token
has bytes: what could take a symbol from it is merged out of these alone.  So a word of any length takes few rounds.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwright.llm.shared import lean

#: Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of the pieces from which a Python worker's cache becomes the older of two, which keeps what is still met.
CACHE = 2_000_000
#: Characters of a piece from which it isn't cached.
LONG_PIECE = 256
#: Symbols that one call of the merge rounds takes, about.
BATCH = 200_000
#: Characters of text that are encoded together, about.
RUN = 2_000_000

_LOOSE = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte: itself if it is visible in Latin-1, else the next code point from 256."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """A tokenizer file of byte-level BPE; it is read where the path is a local file, on the driver."""

    def __init__(self, source: str):
        data = json.loads(source)
        model, to_char = data["model"], _byte_chars()
        to_byte = {c: b for b, c in to_char.items()}
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.bytes_of[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.of_byte = np.array([vocab[to_char[b]] for b in range(256)], np.int64)
        self.size = np.int64(size)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        made, used = np.full(size, -1), np.full(size, len(pairs))
        np.maximum.at(made, self.merged, np.arange(len(pairs)))
        for side in (0, 1):
            np.minimum.at(used, [vocab[x[side]] for x in pairs], np.arange(len(pairs)))
        if (made >= used).any():
            raise ValueError("a merge uses a token that a later one makes")
        self.longest = max((len(self.bytes_of[i]) for i in self.merged), default=1)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; one past the last for a pair that never merges."""
        if not len(self.keys):
            return np.zeros(len(left), np.int64)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.ranks))

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, in rounds over batches of bounded size."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        batch, total = [], 0
        for i, w in enumerate(words):
            batch.append(i)
            total += len(w)
            if total >= BATCH:
                self._rounds(words, batch, out)
                batch, total = [], 0
        if batch:
            self._rounds(words, batch, out)
        return out

    def _rounds(self, words: list[bytes], which: list[int], out: list[np.ndarray]) -> None:
        lengths = np.array([len(words[i]) for i in which], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words[i] for i in which), np.uint8)]
        owner = np.repeat(np.arange(len(which)), lengths)
        last = len(self.ranks)
        rank = np.full(len(symbols), last, np.int64)
        rank[:-1] = np.where(owner[:-1] == owner[1:], self.rank(symbols[:-1], symbols[1:]), last)
        while len(symbols):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            done = least == last
            sizes = np.diff(starts, append=len(symbols))
            for a, n, w in zip(starts[done], sizes[done], owner[starts[done]], strict=True):
                out[which[w]] = symbols[a : a + n]
            live = np.repeat(~done, sizes)
            if not live.any():
                return
            least = np.repeat(least, sizes)
            wide = np.repeat(sizes > self.longest, sizes) & live
            if wide.any():
                least = np.where(wide, _least_near(np.where(wide, rank, last), self.longest), least)
            hit = (rank == least) & (rank < last)
            # pairs that overlap are of one symbol, repeated: such a run goes as a whole, or waits
            new_run = np.flatnonzero(np.diff(rank, prepend=-1))
            hit &= np.repeat(np.logical_and.reduceat(hit, new_run), np.diff(new_run, append=len(rank)))
            # every second of them counts, from the left of each run
            at = np.flatnonzero(hit)
            new_run = np.diff(at, prepend=-2) != 1
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = self.merged[rank[at]]
            keep = live
            keep[at + 1] = False
            # only the pairs of merged symbols, and those before them, have new ranks
            changed = (np.cumsum(keep) - 1)[at]
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            changed = np.concatenate([changed, changed[changed > 0] - 1])
            changed = changed[changed + 1 < len(symbols)]
            same = owner[changed] == owner[changed + 1]
            rank[changed] = np.where(same, self.rank(symbols[changed], symbols[changed + 1]), last)
            if len(rank):
                rank[-1] = last


def _least_near(x: np.ndarray, width: int) -> np.ndarray:
    """The least value within `width` places of each."""
    fill = np.full(width, x.max(initial=0))
    y, span, window = np.concatenate([fill, x, fill]), 1, 2 * width + 1
    while 2 * span <= window:
        y = np.minimum(y[:-span], y[span:])
        span *= 2
    rest = window - span
    return np.minimum(y[: len(y) - rest], y[rest:]) if rest else y


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(source: str) -> Encoder:
    """This Python worker's encoder for a tokenizer file's content; it and its cache outlive a task."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(source))
    return _ENCODERS[key]


def pieces(text: str) -> list[str]:
    """The text cut before each single space that stands between visible characters; the pieces' concatenation is the text."""
    parts = _CUT.split(text) if _LOOSE.search(text) or text[:1].isspace() or text[-1:].isspace() else text.split(" ")
    return [parts[0], *[" " + x for x in parts[1:]]]


class Encoder:
    """Encodes texts with one vocabulary; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.words = vocabulary, regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of each of some distinct pieces."""
        # a space and letters of ASCII are one word of the pattern
        plain = [p for p in new if p[:1] == " " and p.isascii() and p[1:].isalpha()]
        cut = {p: self.words.findall(p) for p in {*new}.difference(plain)}
        words = [*{*plain}.union(*cut.values())]
        ids = dict(zip(words, [x.astype("<u4").tobytes() for x in self.v.encode_words([w.encode() for w in words])], strict=True))
        return {p: ids[p] for p in plain} | {p: b"".join([ids[w] for w in c]) for p, c in cut.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.v.split.split(t) if self.v.split and any(s in t for s in self.v.special) else [t] for t in texts]
        cut = [[x if i % 2 else pieces(x) for i, x in enumerate(s)] for s in split]
        if self.size > CACHE:
            self.cache, self.older, self.size = {}, self.cache, 0
        cache, older = self.cache, self.older
        new = {p for parts in cut for part in parts[::2] for p in part}.difference(cache)
        met = {p: older[p] for p in new if p in older} if older else {}
        learnt = self._learn([*new.difference(met)])
        met.update((p, x) for p, x in learnt.items() if len(p) < LONG_PIECE)
        self.size += sum(map(len, met))
        cache.update(met)
        rest = {p: x for p, x in learnt.items() if len(p) >= LONG_PIECE}
        get = (lambda p: cache[p] if p in cache else rest[p]) if rest else cache.__getitem__
        special = {s: int(i).to_bytes(4, "little") for s, i in self.v.special.items()}
        return [b"".join([x for i, part in enumerate(parts) for x in ([special[part]] if i % 2 else map(get, part))]) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def batched(batch: pa.RecordBatch, column: str, most: int = RUN) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch (null: empty) in runs of bounded length, each with its first row's number."""
    start, run, size = 0, [], 0
    for i, text in enumerate(batch.column(column)):
        run.append(text.as_py() or "")
        size += len(run[-1])
        if size >= most:
            yield start, run
            start, run, size = i + 1, [], 0
    if run:
        yield start, run


def encode(docs: DataFrame, tokenizer: str, *, decode: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens and, if asked for, the decoded text; a row for each row.

    A null or empty text has no ids; special tokens' strings in a text become their ids.  tokenizer is the path of a
    tokenizer file on the driver, whose content travels with the plan.  Rows keep their order and repeat if docs repeats.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(source.value)
        for batch in batches:
            for start, texts in batched(batch, "text"):
                ids = encoder.encode(texts)
                columns = [batch.column("doc_id").slice(start, len(texts)), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                names = ["doc_id", "ids", "n_tokens"]
                if decode:
                    columns.append(pa.array([encoder.decode(x) for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(lean(run), "doc_id long, ids binary, n_tokens long" + ", decoded string" * decode)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encode() with decoding, its results digested in place."""
    encoded = encode(docs, tokenizer, decode=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def brute_force(text: str, tokenizer: str) -> tuple[int, str, str]:
    """n_tokens and both digests by the tokenizers library, for tests."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.no_padding()
    t.no_truncation()
    ids = t.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
