"""Packing into fixed-length sequences with balanced cost.

A sequence's cost is linear in its tokens plus quadratic in each piece, for attention within a piece.  Documents longer
than a sequence first fill whole ones.  The remainders are assigned in falling order of length, each to the cheapest
sequence that has room; the sequences are as few as can hold them, and a remainder that fits nowhere is cut over the
gaps.  So each group of a few million tokens has at most one sequence with padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwright.llm.bpe import batched
from tarnwright.llm.shared import lean

LENGTH = 2048
#: Tokens that are packed together; a task holds no more ids at a time, but for one document.
GROUP = 2_000_000
#: Cost of a piece of n tokens: LINEAR * n + n * n, the ratio of a model's width to attention's share.
LINEAR = 4096.0
#: Sequence ids of a partition start at its number times this.
STRIDE = 1 << 36
#: Words whose ids one Python worker keeps before it starts anew, about 200 bytes each.
CACHE = 200_000
#: Distinct words that the library encodes at once.
RUN = 1_000
END = (1).to_bytes(4, "little")

def assign(lengths: list[int], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths; sequences count from 0."""
    out, rest, sequence = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    if not rest:
        return out
    n_bins = -(-sum(r[0] for r in rest) // capacity)
    cost, used = np.zeros(n_bins), np.zeros(n_bins, np.int64)

    def put(b: int, d: int, start: int, n: int) -> None:
        out.append((d, start, n, sequence + b, int(used[b])))
        used[b] += n
        cost[b] += LINEAR * n + float(n) * n

    loose = []
    for n, d, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        b = int(np.argmin(np.where(used + n <= capacity, cost, np.inf)))
        if used[b] + n <= capacity:
            put(b, d, start, n)
        else:
            loose.append((n, d, start))
    for n, d, start in loose:  # cut over the widest gaps, of the cheapest sequences first
        while n:
            b = int(np.lexsort((cost, used))[0])
            part = min(n, capacity - int(used[b]))
            put(b, d, start, part)
            start, n = start + part, n - part
    return out


class Words:
    """Ids of texts as the library gives them, little-endian; the library sees each distinct word once.

    For tokenizers that drop white space and never join what it parts, a text's ids are those of its words in turn.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_padding()
        self.library.no_truncation()
        self.known: dict[bytes, bytes] = {}

    def ids(self, texts: list[str], most: int = CACHE) -> list[bytes]:
        # words part at ASCII white space, the library sees any other; it makes A-Z lower too, but after it looks for special tokens
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        cut = [(x if b"<|" in x else x.lower()).split() for x in raw]
        if len(self.known) > most:
            self.known.clear()
        new = list(set().union(*cut).difference(self.known))
        for a in range(0, len(new), RUN):
            _learn(self.library, new[a : a + RUN], self.known)
        return [b"".join(map(self.known.__getitem__, words)) + END for words in cut]


_WORDS: dict[str, Words] = {}


def words_of(source: str) -> Words:
    """This Python worker's Words for a tokenizer file's content; they outlive a task."""
    if source not in _WORDS:
        _WORDS.clear()
        _WORDS[source] = Words(source)
    return _WORDS[source]


def _learn(library, words: list[bytes], cache: dict[bytes, bytes]) -> None:
    """The ids of some words, encoded as one text; each id belongs to the word in which it starts."""
    plain = [w.decode("utf-8", "replace") for w in words]
    encoded = library.encode(" ".join(plain), add_special_tokens=False)
    ids = np.array(encoded.ids, "<u4").tobytes()
    starts = np.fromiter((x[0] for x in encoded.offsets), np.int64, len(ids) // 4)
    ends = np.cumsum([len(w) + 1 for w in plain])
    cuts = (4 * np.searchsorted(starts, ends)).tolist()
    cache.update(zip(words, [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = LENGTH, *, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds ids (binary).

    A document's ids are the tokenizer's and then id 1; a null or empty text has that one alone.  Each partition packs
    its own documents and moves none; its sequence ids follow from its number.  Repeated rows are packed each on its
    own, other columns are ignored, an empty table has no pieces.  tokenizer is a file's path on the driver; cache is how
    many words' ids a Python worker keeps.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sequence = words_of(source.value), TaskContext.get().partitionId() * STRIDE
        ids, held, size = [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal sequence
            found = assign([len(x) // 4 for x in held], capacity)
            parts = [held[d][4 * start : 4 * (start + n)] for d, start, n, _, _ in found]
            columns = [
                pa.array([ids[p[0]] for p in found], pa.int64()),
                *[pa.array([p[i] for p in found], pa.int64()) for i in (1, 2)],
                pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                pa.array([len(held[p[0]]) // 4 for p in found], pa.int64()),
                pa.array([sequence + p[3] for p in found], pa.int64()),
                pa.array([p[4] for p in found], pa.int64()),
            ]
            sequence += max(p[3] for p in found) + 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())] if with_ids else columns, [*names, "ids"] if with_ids else names)

        for batch in batches:
            for first, texts in batched(batch, "text"):
                for i, x in enumerate(words.ids(texts, cache), first):
                    ids.append(batch.column("doc_id")[i].as_py())
                    held.append(x)
                    size += len(x) // 4
                    if size >= GROUP:
                        yield packed()
                        ids, held, size = [], [], 0
        if held:
            yield packed()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(lean(run), SCHEMA + ", ids binary" * with_ids)
