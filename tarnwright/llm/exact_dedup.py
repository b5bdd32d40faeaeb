"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. One scan normalises each text and writes a narrow table: row id, doc_id, 64-bit fingerprint, SHA-256.
2. Each partition of that table sorts its distinct fingerprints, cut to a range of about 256 values a row, and sends the
   gaps to the owner of each slice of the range, Rice-coded: one message a partition and owner, of thousands of values.
3. An owner finds the values that more than one message holds, and answers each message with a bitmap.
4. Values whose bit is set, or that repeat within their partition, are suspects.  Only suspects' texts are shuffled,
   grouped by the whole normalised text: that comparison of bytes decides, a fingerprint never does.  (Up to
   SUSPECTS values are sent to all tasks to find these texts; beyond it, texts meet the values by a shuffle.)

A group's rows meet only as partial aggregates (one row for each text and task), so a text that makes up a third of
all rows costs no more than any other.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwright.llm.shared import hinted, lean, whole, written

SPACE = "[\\x20\\x09-\\x0D]+"
#: Fingerprints that one owner holds at most, about, and that a message should have.
PER_OWNER, PER_MESSAGE = 4_000_000, 2_000
#: Fingerprints of a partition that are sorted together.
RUN = 2_000_000
#: Values of the fingerprint range for each row, as bits: one in 2**8 unique rows is a suspect by chance.
SPARE_BITS = 8
#: Suspect values, of eight bytes, up to which they are broadcast; counted before.
SUSPECTS = 2_000_000
#: run: the sending partition and its part; values that repeat within the run are set in `twice`.
MESSAGE = "run long, owner int, body binary, twice binary"


def normalised(text: Column) -> Column:
    """Runs of white space (ASCII only) as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def rice_encode(values: np.ndarray) -> bytes:
    """Ascending distinct values below 2**63: count, k, first value, and the Rice-coded gaps (unary quotients, k-bit remainders)."""
    n = len(values)
    if not n:
        return struct.pack("<IB", 0, 0)
    values = values.astype(np.uint64)
    gaps = np.diff(values)
    k = max(0, int((values[-1] - values[0]) // np.uint64(max(1, n - 1))).bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n - 1, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(k, dtype=np.uint64)
    remainders = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return struct.pack("<IBQI", n, k, int(values[0]), len(unary)) + np.packbits(unary).tobytes() + np.packbits(remainders.ravel()).tobytes()


def rice_decode(body: bytes) -> np.ndarray:
    n, k = struct.unpack_from("<IB", body)
    if not n:
        return np.zeros(0, np.uint64)
    least, length = struct.unpack_from("<QI", body, 5)
    end = 17 + (length + 7) // 8
    unary = np.unpackbits(np.frombuffer(body, np.uint8, end - 17, 17))[:length]
    quotients = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    gaps = quotients.astype(np.uint64) << np.uint64(k)
    if k:
        remainders = np.unpackbits(np.frombuffer(body, np.uint8, offset=end))[: (n - 1) * k].reshape(n - 1, k).astype(np.uint64)
        gaps += (remainders << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(np.concatenate([[np.uint64(least)], gaps]), dtype=np.uint64)


def _messages(bits: int, owners: int):
    """For each partition its sorted distinct fingerprints, as a message to each owner."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        size = 0

        def sent() -> pd.DataFrame:
            distinct, counts = np.unique(np.concatenate(held), return_counts=True)
            owner = ((distinct * np.uint64(owners)) >> np.uint64(bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            out = [(number, int(owner[a]), rice_encode(distinct[a:b]), np.packbits(counts[a:b] > 1).tobytes()) for a, b in zip(cuts, [*cuts[1:], len(distinct)], strict=True)]
            return pd.DataFrame(out, columns=["run", "owner", "body", "twice"])

        for batch in batches:
            held.append(batch["fingerprint"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits))
            size += len(batch)
            if size >= RUN:
                yield sent()
                held, size, number = [], 0, number + 1
        if size:
            yield sent()

    return send


def _answer(key: tuple[Any, ...], messages: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: for each value of a message, whether another message holds it too."""
    decoded = [rice_decode(x) for x in messages["body"]]
    values, counts = np.unique(np.concatenate(decoded), return_counts=True)
    again = values[counts > 1]
    return pd.DataFrame({"run": messages["run"], "owner": messages["owner"], "bitmap": [np.packbits(np.isin(x, again)).tobytes() for x in decoded]})


def _suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for body, twice, bitmap in zip(batch["body"], batch["twice"], batch["bitmap"], strict=True):
            values = rice_decode(body)
            marked = np.unpackbits(np.frombuffer(bitmap, np.uint8) | np.frombuffer(twice, np.uint8))[: len(values)].astype(bool)
            yield pd.DataFrame({"short": values[marked].view(np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """The narrow table: row, doc_id, fingerprint, text_sha256 (written to the shared folder)."""
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    narrow = norm.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("norm").alias("fingerprint"), F.sha2("norm", 256).alias("text_sha256"))
    return written(narrow, "fingerprints")


def plan_owners(total: int, partitions: int, parallel: int) -> tuple[int, int]:
    """Owners, and bits of the fingerprint range, for so many rows: as many owners as run in parallel, unless messages
    would be small, and more only where an owner would hold too much."""
    owners = max(1, -(-total // PER_OWNER), min(parallel, total // (PER_MESSAGE * max(1, partitions))))
    return owners, min(62 - owners.bit_length(), total.bit_length() + SPARE_BITS)


def suspects(narrow: DataFrame) -> tuple[DataFrame, int, int]:
    """Distinct cut fingerprints (column short) of the rows that may equal another, all that do and a few by chance; how
    many; and the bits by which fingerprints are cut."""
    sizes = narrow.groupBy(F.spark_partition_id().alias("p")).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    owners, bits = plan_owners(*sizes, int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    messages = written(narrow.select("fingerprint").mapInPandas(lean(_messages(bits, owners)), MESSAGE), "messages")
    answers = messages.select("owner", "run", "body").groupBy("owner").applyInPandas(_answer, "run long, owner int, bitmap binary")
    found = messages.join(answers, ["run", "owner"]).select("body", "twice", "bitmap").mapInPandas(_suspects, "short long")
    found = written(found.distinct(), "suspects")
    return found, found.count(), bits


def _split(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The narrow table, the suspects, and the rows of docs as `row` with their normalised text and cut fingerprint."""
    narrow = fingerprints(docs)
    found, n, bits = suspects(narrow)
    keyed = whole(docs, normalised(F.col("text")).alias("norm")).withColumn("short", F.shiftrightunsigned(F.xxhash64("norm"), 64 - bits))
    return narrow, F.broadcast(found) if n <= SUSPECTS else found, keyed


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after runs of white space become one space; a null text counts as empty.  Of equal
    texts the smallest doc_id stays; if rows repeat that doc_id too, one of them stays.  A null doc_id sorts last and is
    kept only where no other row has its text.  Other columns are ignored; an empty table gives an empty result.
    """
    narrow, found, keyed = _split(docs.select("doc_id", "text"))
    groups = keyed.join(found, "short", "left_semi").groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.filter("group_size > 1").select(F.sha2("norm", 256).alias("text_sha256"), "group_size"), "groups")
    n = groups.count()
    marked = narrow.join(hinted(groups, n), "text_sha256")
    first = marked.groupBy("text_sha256").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.first("group_size").alias("group_size"))
    first = first.select("text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")
    return narrow.join(hinted(first, n), "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are named: one for each normalised text.

    As in exact_groups(), a null text counts as empty, of equal texts the row with the smallest doc_id stays (a null one
    last; of rows that repeat it, one), and an empty table gives an empty result.
    """
    _, found, keyed = _split(docs)
    alone = keyed.join(found, "short", "left_anti").select("row")
    # the whole row travels with the smallest doc_id of each text; partial aggregation leaves one a task
    first = F.min_by("row", F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id")))
    groups = keyed.join(found, "short", "left_semi").groupBy("norm").agg(first.alias("row"))
    return alone.unionByName(groups.select("row")).select("row.*")
