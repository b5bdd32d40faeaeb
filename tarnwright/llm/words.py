"""Hashes of the words of many texts at once, in numpy on the bytes of Arrow columns: no Python object for a word.

A word is a run of bytes of one class, within one text.  Its hash is a polynomial in a number for each byte, modulo
2**64, so it is made from running sums over fixed chunks of the bytes, and a word across chunks from its parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed together; a longer text is a run of its own.
RUN = 4_000_000
#: Bytes that one step of the hashing takes.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C17
_U64 = (1 << 64) - 1


def classes(*groups: bytes) -> np.ndarray:
    """The class of each byte: that of the first group that holds it, counted from 1; else 0, which parts words."""
    out = np.zeros(256, np.uint8)
    for i, group in reversed([*enumerate(groups, 1)]):
        out[[*group]] = i
    return out


#: ASCII white space parts words, any other byte is in them.
SPACED = classes(bytes(b for b in range(256) if b != 32 and not 9 <= b <= 13))
#: Letters, digits and all beyond ASCII; other visible characters.
WRITTEN = classes(bytes(b for b in range(256) if b >= 128 or b == 95 or chr(b).isalnum()), bytes(range(33, 127)))


def _byte_values() -> np.ndarray:
    """A number for each byte, the same for A-Z as for a-z."""
    out = np.random.default_rng(64).integers(0, 1 << 64, 256, np.uint64)
    out[65:91] = out[97:123]
    return out


_VALUES = _byte_values()
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK, np.uint64(_BASE))]), dtype=np.uint64)
_INVERSES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK, np.uint64(pow(_BASE, -1, 1 << 64)))]), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


class Words(NamedTuple):
    """The words of a run of texts, in order: the first row of the run, its texts' ends, each word's hash, and where each text's words begin."""

    first: int
    sizes: np.ndarray  # bytes of each text
    hashes: np.ndarray
    starts: np.ndarray  # of each text's words, and one past the last


def _hashed(data: np.ndarray, texts: np.ndarray, kinds: np.ndarray) -> Words:
    """data: bytes; texts: where each text starts, and the end."""
    places, lengths, hashes, borders, count = [], [], [], [], 0
    edge_of_text = np.zeros(len(data) + 1, bool)
    edge_of_text[texts] = True
    for a in range(0, len(data), CHUNK):
        part = data[a : a + CHUNK]
        kind = kinds[part]
        edge = edge_of_text[a : a + len(part) + 1].copy()
        edge[1:-1] |= kind[1:] != kind[:-1]
        edge[0] = edge[-1] = True
        bounds = np.flatnonzero(edge)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUES[part] * _POWERS[: len(part)], dtype=np.uint64)])
        word = kind[bounds[:-1]] != 0
        first, last = bounds[:-1][word], bounds[1:][word]
        if a and len(first) and first[0] == 0 and not edge_of_text[a] and kinds[data[a - 1]] == kind[0]:
            borders.append(count)
        places.append(first + a)
        lengths.append(last - first)
        hashes.append((sums[last] - sums[first]) * _INVERSES[first])
        count += len(first)
    place, length, h = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.int64, places), (np.int64, lengths), (np.uint64, hashes)))
    for j in reversed(borders):  # the rest of a word that began in an earlier chunk
        h[j - 1] = int(h[j - 1]) + pow(_BASE, int(length[j - 1]), 1 << 64) * int(h[j]) & _U64
        length[j - 1] += length[j]
    if borders:
        place, length, h = (np.delete(x, borders) for x in (place, length, h))
    return Words(0, np.diff(texts), mixed(h + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(place, texts))


def runs(column: pa.Array, most: int = RUN) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes, and starts and end of the texts of each run of a string column; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def hashed(column: pa.Array, kinds: np.ndarray = SPACED, most: int = RUN) -> Iterator[Words]:
    """The words of a string column, run by run."""
    for first, data, texts in runs(column, most):
        yield _hashed(data, texts, kinds)._replace(first=first)
