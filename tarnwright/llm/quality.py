"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k draw.

The target is the text of labelled good documents, the raw text is that of all documents.  Both are generative models
over hashed words and word pairs.  A document's weight is the ratio of its likelihoods under the two: its log weight is
the sum, over its n-grams, of the log ratio of their probabilities.  Adding Gumbel noise to the log weights and taking
the k largest draws k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwright.llm.shared import hinted, lean, whole, written
from tarnwright.llm.words import WRITTEN, hashed, mixed

#: Buckets that words and word pairs are hashed to; the models' size, whatever the corpus.
BUCKETS = 1 << 16
#: Labelled good documents that the target model is learnt from, about; chosen by a hash of doc_id.
TARGET_SAMPLE = 100_000
#: Occurrences, as expected from the raw text, that a bucket's ratio starts from: one that is rare says little either way.
PRIOR = 100.0
#: Standard errors that are added to the labels' share of good.
MARGIN = 3.0
SEED = 20


def grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, rows, and each n-gram's row and bucket, in runs of a column's texts.

    The n-grams are words (runs of letters, digits and bytes beyond ASCII, or of other visible characters; A-Z in lower
    case) and pairs of words that follow each other.
    """
    for w in hashed(column, WRITTEN):
        row = np.repeat(np.arange(len(w.sizes)), np.diff(w.starts))
        pairs = row[:-1] == row[1:]
        two = mixed(w.hashes[:-1] * np.uint64(3) + w.hashes[1:])[pairs]
        yield w.first, len(w.sizes), np.concatenate([row, row[:-1][pairs]]), (np.concatenate([w.hashes, two]) % np.uint64(BUCKETS)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column("good").to_numpy(zero_copy_only=False)
        for first, n, row, bucket in grams(batch.column("text")):
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[first : first + n][row]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    for a in range(0, len(at), 8192):
        i = at[a : a + 8192]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(raw[i]), pa.array(target[i])], ["bucket", "raw", "target"])


def _by_document(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def good_ids(labels: DataFrame, sample: int = TARGET_SAMPLE) -> tuple[DataFrame, int]:
    """About `sample` documents labelled good (quality 1 in each of their labels), and how many at most."""
    by = _by_document(labels).filter(F.col("quality") == 1)
    good = by.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("target")), F.lit(1_000_000)) / 1e6
    return by.filter(draw < F.lit(sample / max(good, 1))).select("doc_id", F.lit(True).alias("good")), min(good, 2 * sample)


def expected_good(labels: DataFrame, rows: int, margin: float = MARGIN) -> int:
    """How many of some rows are good if they are as the labelled documents: their share of good and `margin` standard
    errors more, so that a good document isn't drawn against others.  All, if no document is labelled good."""
    labelled, good = _by_document(labels).agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 1)).first()
    if not good:
        return rows
    share = good / labelled
    return math.ceil(rows * min(1.0, share + margin * math.sqrt(share * (1 - share) / labelled)))


def log_ratios(docs: DataFrame, labels: DataFrame, prior: float = PRIOR) -> np.ndarray:
    """The log ratio of target to raw of each bucket; zeros if there is no target.

    `prior` occurrences, as expected and as found, are added to those of each bucket: the mean of a gamma posterior.
    """
    ids, n_ids = good_ids(labels)
    marked = docs.select("doc_id", "text").join(hinted(ids, n_ids), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    sums = marked.mapInArrow(lean(_tally), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in sums:  # at most BUCKETS rows
        raw[bucket], target[bucket] = r, t
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + prior) / (raw * (target.sum() / raw.sum()) + prior))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise, fixed by doc_id and seed."""
    uniform = (F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return -F.log(-F.log(uniform))


def weighed(docs: DataFrame, ratios: np.ndarray, seed: int = SEED) -> DataFrame:
    """row (a struct of the columns of docs), n_grams, log_weight and key (the log weight with noise) of each row.

    A text without n-grams has the log weight minus infinity.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, rows, row, bucket in grams(batch.column("row").field(at)):
                n[first : first + rows] = np.bincount(row, minlength=rows)
                weight[first : first + rows] = np.bincount(row, weights=sent.value[bucket], minlength=rows)
            weight[n == 0] = -np.inf
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n), pa.array(weight)], ["row", "n_grams", "log_weight"])

    rows = whole(docs)
    schema = T.StructType([*rows.schema.fields, T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())])
    return rows.mapInArrow(lean(run), schema).withColumn("key", F.col("log_weight") + gumbel(F.col("row.doc_id"), seed))


def placed(key: Column) -> Column:
    """A key in millionths as a long from 0 to 2**48, in the same order."""
    return (F.greatest(F.least(key, F.lit(1e8)), F.lit(-1e8)) * 1e6 + 1e14).cast("long")


def kth_largest(df: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a column of longs below 2**48, exactly: found by counts of 16 of its bits at a time."""
    value = F.col(column)
    prefix, rest = 0, df.select(value)
    for shift in (32, 16, 0):
        counts = rest.groupBy(F.shiftright(value, shift).alias("b")).count().collect()  # at most 2**16 rows
        for b, n in sorted(counts, reverse=True):
            if n >= k:
                prefix = b
                break
            k -= n
        else:
            return -1  # fewer than k rows: all of them
        rest = rest.filter(F.shiftright(value, shift) == prefix)
    return prefix


def _drawn(docs: DataFrame, labels: DataFrame, k: int | None, seed: int, *columns: Column | str) -> tuple[DataFrame, Column]:
    """Some columns of the weighed rows, written once, and whether each is among the k with the largest keys."""
    ratios = log_ratios(docs, labels)
    rows = written(weighed(docs, ratios, seed).select(*columns, placed(F.col("key")).alias("placed")), "weighed")
    if k is None:
        k = expected_good(labels, rows.count())
    return rows, F.col("placed") >= (kth_largest(rows, "placed", k) if k else 1 << 48)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, n_grams, log_weight, key, selected.

    The k rows with the largest keys are selected; by default k is expected_good(), the number of good rows that the
    labels let expect.  Rows whose key ties with the k-th (to a millionth) are selected too, so repeated rows stay or go
    together.  A null or empty text has no n-grams, the log weight minus infinity and is never selected before another.
    Labels with nulls are ignored; with no good label every document weighs alike and all stay.  Very long texts are
    read whole.  Other columns are ignored; an empty table gives an empty result.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, chosen = _drawn(narrow, labels, k, seed, F.col("row.doc_id").alias("doc_id"), "n_grams", "log_weight", "key")
    return rows.select("doc_id", "n_grams", "log_weight", "key", chosen.alias("selected"))


def selected(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs that resample() selects, with all their columns, whatever these are named."""
    rows, chosen = _drawn(docs, labels, k, seed, "row")
    return rows.filter(chosen).select("row.*")
