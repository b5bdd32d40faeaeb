"""Product codes of vectors by Lloyd's rounds whose sums are maintained by changes.

Vectors become whole numbers, so that sums and distances are exact whatever their order.  A vector's parts each have a
codebook of a few entries; all codebooks together are a constant size, so they travel with the tasks.

A round assigns every part to its nearest entry and writes the assignments beside the previous ones.  Of parts whose
assignment changed, and of no others, a task adds up what they bring to their new entry and take from their old one: a
row for each part and entry at most, which is what is shuffled.  The running sums, persisted from round to round, take
these changes in, and entries become sum / count.  The first round's parts have no old entry, so they all change; later
ones change few.  A label that a third of the vectors have meets only in such partial sums too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwright.llm.shared import hinted, lean, quoted, written

#: Components are multiplied by this and rounded down.
SCALE = 256
#: Whole components are held to this size, beyond which squares of differences wouldn't fit 64 bits.
LARGEST = 1 << 26
#: Components up to which distances are exact in double precision too, where products of matrices are fast.
EXACT = 1 << 21
#: Vectors that are assigned together.
RUN = 4_096
SUMS = "part int, entry int, n long, sums array<long>"


class Codebooks(NamedTuple):
    """entries[part, entry, component]; in each part the same number of entries, at least one."""

    entries: np.ndarray

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector and part the entry (ties: the lowest) and the squared distance; vectors[row, component]."""
        parts, _, width = self.entries.shape
        small = max(np.abs(vectors).max(initial=0), np.abs(self.entries).max(initial=0)) < EXACT
        code, error = np.zeros((len(vectors), parts), np.int64), np.zeros((len(vectors), parts), np.int64)
        for a in range(0, len(vectors), RUN):
            some = vectors[a : a + RUN].reshape(-1, parts, width)
            for p in range(parts):
                x, c = some[:, p], self.entries[p]
                if small:
                    x, c = x.astype(np.float64), c.astype(np.float64)
                    far = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
                else:
                    far = ((x[:, None] - c) ** 2).sum(2)
                code[a : a + RUN, p] = far.argmin(1)
                error[a : a + RUN, p] = far.min(1)
        return code, error

    def moved(self, n: np.ndarray, sums: np.ndarray) -> Codebooks:
        """Entries that are the mean of their parts, rounded down; those without parts stay."""
        return Codebooks(np.where(n[:, :, None] > 0, sums // np.maximum(n, 1)[:, :, None], self.entries))

    def sha256(self) -> str:
        """Of all components by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _whole(column: pa.Array, length: int, width: int) -> np.ndarray:
    """Rows of whole components, filled up with zeros to `width`."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)
    x = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64)
    return np.pad(x, ((0, 0), (0, width - length)))


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    n, size = len(rows), rows[:1].nbytes
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _scaled(length: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _binary(_whole(batch.column("vector"), length, width).astype("<i4"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), vectors], ["key", "label", "vector"])

    return scale


def _assigned(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The assignment of every vector, beside its previous one."""
    parts, _, width = books.entries.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = books.nearest(_vectors(batch.column("vector"), parts * width))
            columns = [*(batch.column(c) for c in ("key", "label", "vector", "code")), _binary(code.astype(np.uint8)), pa.array(error.sum(1))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "label", "vector", "before", "code", "error"])

    return assign


def _changes(parts: int, entries: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the parts whose assignment changed add to and take from each entry, one row for a part and entry of a task."""

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(parts * entries, np.int64)
        sums = np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            x = _vectors(batch.column("vector"), parts * width).reshape(-1, parts, width)
            now = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            fresh = batch.column("before").is_null().to_numpy(zero_copy_only=False)
            before = np.frombuffer(b"".join(b if b is not None else bytes(parts) for b in batch.column("before").to_pylist()), np.uint8).reshape(-1, parts)
            changed = fresh[:, None] | (now != before)
            for which, code, sign in ((changed, now, 1), (changed & ~fresh[:, None], before, -1)):
                row, part = np.nonzero(which)
                place = part * entries + code[row, part]
                n += sign * np.bincount(place, minlength=len(n))
                np.add.at(sums, place, sign * x[row, part])
        used = np.flatnonzero((n != 0) | (sums != 0).any(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array((used // entries).astype(np.int32)), pa.array((used % entries).astype(np.int32)), pa.array(n[used]), lists], ["part", "entry", "n", "sums"])

    return change


def _summed(rows: DataFrame, width: int) -> DataFrame:
    """Counts and sums by part and entry."""
    each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).select("part", "entry", "n", F.array(*[f"s{i}" for i in range(width)]).alias("sums"))


def _round(state: DataFrame, books: Codebooks, kinds: tuple[str, str]) -> DataFrame:
    ddl = f"key {kinds[0]}, label {kinds[1]}, vector binary, before binary, code binary, error long"
    return state.select("key", "label", "vector", "code").mapInArrow(lean(_assigned(books)), ddl)


def encode(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """One row for each vector kept: its key, code (parts bytes), error (squared distances summed over its parts),
    label_error (error summed over equal labels, nulls together) and codebooks_sha256.

    Vectors that are null or empty, or hold null or non-finite components, are dropped.  Components become
    floor(256 * x), held to 2**26 either way.  The codebooks start as the parts of the vectors with the smallest keys (nulls
    last; of equal keys the smaller vector first, and each counts); with fewer vectors there are fewer entries.  All vectors
    kept have the length of the very first of these: others are dropped.  Where it doesn't divide by `parts`, parts are filled
    up with zeros at the end of the vector.  Rows that repeat give a row each, other columns are ignored; an empty table gives an
    empty result.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a code is a byte: 1 to 256 entries")
    x = F.col(quoted(vector)).cast("array<double>")
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kinds = rows.schema[key].dataType.simpleString(), rows.schema[label].dataType.simpleString()
    kept = rows.filter(F.coalesce(sound, F.lit(False))).select(F.col(quoted(key)).alias("key"), F.col(quoted(label)).alias("label"), x.alias("vector"))
    in_order = [F.col("key").asc_nulls_last(), F.col("vector")]
    very_first = kept.orderBy(*in_order).limit(1).select(F.size("vector")).collect()
    if not very_first:
        return rows.sparkSession.createDataFrame([], f"{quoted(key)} {kinds[0]}, code string, error long, label_error long, codebooks_sha256 string")
    length = very_first[0][0]
    width = -(-length // parts)
    kept = kept.filter(F.size("vector") == length)
    start = kept.orderBy(*in_order).limit(entries).select("vector").toArrow()["vector"].combine_chunks()  # as many rows as a codebook has entries
    books = Codebooks(np.ascontiguousarray(_whole(start, length, parts * width).reshape(-1, parts, width).transpose(1, 0, 2)))
    whole = kept.mapInArrow(lean(_scaled(length, parts * width)), f"key {kinds[0]}, label {kinds[1]}, vector binary")
    state, sums = written(whole.withColumn("code", F.lit(None).cast("binary")), "vectors"), None
    for step in range(rounds):
        state = written(_round(state, books, kinds), f"assigned-{step}")
        changed = state.filter("before IS NULL OR before <> code").select("vector", "before", "code")
        delta = changed.mapInArrow(lean(_changes(parts, books.entries.shape[1], width)), SUMS)
        sums = written(_summed(delta if sums is None else sums.unionByName(delta), width), f"sums-{step}")
        n, total = np.zeros(books.entries.shape[:2], np.int64), np.zeros(books.entries.shape, np.int64)
        for r in sums.collect():  # as many rows as all codebooks have entries
            n[r.part, r.entry], total[r.part, r.entry] = r.n, r["sums"]
        books = books.moved(n, total)
    final = written(_round(state, books, kinds).select("key", "label", "code", "error"), "codes")
    by_label = final.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = final.alias("v").join(hinted(by_label, by_label.count()).alias("l"), F.col("v.label").eqNullSafe(F.col("l.label")))
    return joined.select(F.col("v.key").alias(key), F.lower(F.hex("v.code")).alias("code"), "v.error", "l.label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
