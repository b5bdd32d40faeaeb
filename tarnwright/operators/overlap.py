"""Which documents share passages with which items, by n-grams of words: a Bloom filter first, then an exact join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwright.operators import bloom
from tarnwright.operators.joins import named

#: Rows of a table of n-grams up to which it is broadcast; counted before.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text between ASCII white space, in lower case; of a null text none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")


def _each(column: str) -> Column:
    """The hashes of the words of a column."""
    return F.transform(column, lambda x: F.xxhash64(x))


def gram_hashes(hashes: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first places of all n-grams of texts that follow one another, and the n-grams' hashes, from those of the words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[k : k + n]
        out ^= out >> np.uint64(31)
    at = np.flatnonzero(owner[:n] == owner[length - 1 :])
    return at, out[at]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of a column of lists, whose they are, and where each list begins."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    return column.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes


def _hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_, owner, _ = _flat(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(gram_hashes(words_, owner, length)[1].view(np.int64))], ["hash"])

    return run


def _places(length: int, asked):
    """For each text the places of n-grams that the filter lets through; asked: a broadcast filter, or None to let all through."""

    @F.arrow_udf("array<int>")
    def places(column: pa.Array) -> pa.Array:
        words_, owner, begin = _flat(column)
        at, hashes = gram_hashes(words_, owner, length)
        at = at[asked.value.holds(hashes)] if asked is not None else at
        ends = np.searchsorted(owner[at], np.arange(len(column) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((at - begin[owner[at]]).astype(np.int32)))

    return places


def overlap(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", length: int = 8, false_share: float = 0.01) -> DataFrame:
    """One row for each document and item that share an n-gram, and one, without an item, for each document that shares none:
    doc, item, n_words, covered (words of the document that shared n-grams cover), share (of its words), and spans (start and
    end, end exclusive, in order and apart).

    An item of fewer than `length` words, but not none, is one n-gram.  Items with a null id are left out; ids that
    repeat count as one item.  A null text has no words, and a share of 0.  Rows of docs that repeat give their rows again.
    Empty tables give no rows, or rows without items.  All other columns are ignored.

    The items' n-grams make a Bloom filter; documents' n-grams that it rejects go no further than the scan, and what it
    lets through meets the items' n-grams word by word, so that its false positives are removed.  Where the filter would be
    too large all n-grams are joined.
    """
    asked = items.filter(named(item).isNotNull()).select(named(item).alias("item"), words(named(text)).alias("words")).filter("size(words) > 0")
    least = F.least(F.size("words"), F.lit(length))
    lengths = asked.agg(F.sort_array(F.collect_set(least))).first()[0]  # `length` of them at most
    # a row of docs is known by its key and text, so that no numbering of rows need be repeated in the same order
    mine = docs.select(named(doc).alias("doc"), F.xxhash64(named(text)).alias("h"), words(named(text)).alias("words"))
    found = wanted = None
    for n in lengths:
        some = asked.filter(least == n)
        size = some.agg(F.sum(F.size("words") - (n - 1))).first()[0]
        form = bloom.shape(size, false_share)
        held = None
        if form:
            held = bloom.build(some.select(_each("words")).mapInArrow(_hashes(n), "hash long"), "hash", form)
            held = docs.sparkSession.sparkContext.broadcast(bloom.Filter(held, form))
        there = F.transform(_places(n, held)(_each("words")), lambda p: F.struct(p.alias("pos"), F.slice("words", p + 1, n).alias("gram")))  # noqa: B023
        hits = mine.select("doc", "h", F.inline(there))
        every = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda p: F.slice("words", p + 1, n))  # noqa: B023
        grams = some.select("item", F.explode(every).alias("gram"))
        found, wanted = (hits, grams) if found is None else (found.unionByName(hits), wanted.unionByName(grams))
    none = F.array().cast("array<struct<start: int, end: int>>")
    counted = mine.select("doc", "h", F.size("words").alias("n_words"))
    if found is None:
        return counted.select(F.col("doc").alias(doc), F.lit(None).cast(items.schema[item].dataType).alias(item), "n_words", F.lit(0).alias("covered"), F.lit(0.0).alias("share"), none.alias("spans"))
    wanted = wanted.distinct()
    right = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    hits = found.join(right, "gram").select("doc", "h", "item", "pos", F.size("gram").alias("n")).distinct()
    # all of an item's n-grams have one length, so places further apart than that begin a new span
    of = Window.partitionBy("doc", "h", "item")
    fresh = F.coalesce((F.col("pos") > F.lag("pos").over(of.orderBy("pos")) + F.col("n")).cast("int"), F.lit(1))
    islands = hits.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(of.orderBy("pos")))
    spans = islands.groupBy("doc", "h", "item", "island").agg(F.min("pos").alias("start"), (F.max("pos") + F.first("n")).alias("end"))
    by_item = spans.groupBy("doc", "h", "item").agg(F.sum(F.col("end") - F.col("start")).cast("int").alias("covered"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    l, r = counted.alias("l"), by_item.alias("r")  # noqa: E741
    out = l.join(r, F.col("l.doc").eqNullSafe(F.col("r.doc")) & F.col("l.h").eqNullSafe(F.col("r.h")), "left")
    covered = F.coalesce("covered", F.lit(0))
    return out.select(F.col("l.doc").alias(doc), F.col("item").alias(item), "n_words", covered.alias("covered"), F.coalesce(F.try_divide(covered, F.col("n_words")), F.lit(0.0)).alias("share"), F.coalesce("spans", none).alias("spans"))
