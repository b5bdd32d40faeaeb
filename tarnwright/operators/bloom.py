"""Bloom filters of 64-bit hashes: bitmaps that tasks fill, Spark merges, and tasks ask."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap of Spark's bitmap functions.
BITMAP = 32_768
#: Bits of a filter at most (64 MB): what a task may be sent.
MOST = 1 << 29


class Shape(NamedTuple):
    bits: int  # a whole number of bitmaps
    hashes: int

    def places(self, values: np.ndarray) -> Iterator[np.ndarray]:
        """The bits of each value, one hash after another: a first one of its mixed bits, and an odd step from there."""
        x = values.astype(np.uint64)
        first = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        first ^= first >> np.uint64(33)
        step = (x ^ x >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53) | np.uint64(1)
        for _ in range(self.hashes):
            yield ((first >> np.uint64(1)) % np.uint64(self.bits)).astype(np.int64)
            first = first + step


def shape(values: int, false_share: float = 0.01) -> Shape | None:
    """The filter for so many values that takes about that share of others for its own; None where it would pass MOST."""
    if not 0 < false_share < 1:
        raise ValueError("the share must lie between 0 and 1")
    bits = math.ceil(max(1, values) * -math.log(false_share) / math.log(2) ** 2 / BITMAP) * BITMAP
    return Shape(bits, max(1, round(-math.log2(false_share)))) if bits <= MOST else None


def build(values: DataFrame, column: str, form: Shape) -> DataFrame:
    """bucket, bitmap: the filter of a column of longs (nulls don't count).  A task sends one bitmap for each bucket it sets bits
    in, and bitmaps of a bucket are merged before and after the shuffle."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(form.bits // 8, np.uint8)
        for batch in batches:
            x = batch.column(0).drop_null().to_numpy()
            for at in form.places(x):
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        rows = bits.reshape(-1, BITMAP // 8)
        used = np.flatnonzero(rows.any(axis=1))
        for i in range(0, len(used), 256):
            some = used[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([rows[j].tobytes() for j in some], pa.binary())], ["bucket", "bitmap"])

    return merged(values.select(F.col(column).cast("long")).mapInArrow(fill, "bucket long, bitmap binary"))


def merged(*filters: DataFrame) -> DataFrame:
    """One filter of several of the same form."""
    every = filters[0]
    for f in filters[1:]:
        every = every.unionByName(f)
    return every.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


class Filter:
    """A filter that tasks ask: of MOST bits at most, so it may travel with them."""

    def __init__(self, table: DataFrame, form: Shape):
        rows = table.toArrow()
        self.form, self.bits = form, np.zeros((form.bits // BITMAP, BITMAP // 8), np.uint8)
        for bucket, bitmap in zip(rows["bucket"].to_pylist(), rows["bitmap"], strict=True):
            self.bits[bucket] = np.frombuffer(bitmap.as_buffer(), np.uint8)
        self.bits = self.bits.ravel()

    def holds(self, values: np.ndarray) -> np.ndarray:
        """Whether each value may be in the filter; false is certain."""
        out = np.arange(len(values))
        for k in range(self.form.hashes):  # what is left after each hash goes on to the next
            *_, at = Shape(self.form.bits, k + 1).places(values[out])
            out = out[self.bits[at >> 3] >> (at & 7) & 1 == 1]
        found = np.zeros(len(values), bool)
        found[out] = True
        return found
