"""Jaccard self-join of documents' word n-grams, by prefixes under several global orders.

With slack(n) = n - ceil(t * n), two sets of similarity t or more share at least `need` tokens among the first
L(n) = 2 * slack + 1 of each, under any order of all tokens.  So:

1. One scan makes each document's set of hashed n-grams.  The first L of them, in the order of the hashes, go to the
   owners of slices of the hash range, packed in one binary message a task and owner.  Equal sets are one class from here
   on.  A token that several classes of a message have goes into it once; else an owner finds the tokens that another class has
   too.  A class with fewer than `need` of either can't be similar to any other and is dropped.  That takes nearly all of a
   corpus, documents that only share a passage with others too.
2. For the classes left each token's number of classes is counted, over their whole sets.  Now a similar class shares
   ceil(t * n) tokens.  A class's shared tokens are put in several orders: rarest first, and by two more hashes.  Under each order similar classes share one of the first (shared tokens -
   ceil(t * n) + 1), so a class with many tokens of its own has few left to meet others at.
3. Only components are wanted, so classes of one component need no comparison.  Two rounds compare each class with one
   drawn member of each token's list, so near copies become a component in a number of comparisons linear in theirs.
4. Where a token's list (first order) still has more than one component, all candidates are compared: in short lists by
   a join, in long ones in blocks of bounded bytes, those that share a list two by two, each two once; only a spanning
   forest of the links is passed on.
   Candidates share a token under the other orders too; then their sets are compared.

Hash collisions of whole n-grams (64 bits) aside the result is exact: shortened hashes serve in filters only.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwright.llm.components import components
from tarnwright.llm.shared import BROADCAST_ROWS, hinted, lean, whole, written
from tarnwright.llm.words import SPACED, hashed, mixed

#: Tokens that an owner holds, about.
PER_OWNER = 250_000
#: Tokens of first prefixes that a message covers, about; a task with fewer sends one.
RUN = 1_000_000
STARS = 2
#: Pairs with one drawn class that are verified together.
SALT = 4096
#: Classes in a token's list up to which its pairs are made by a join.
SMALL = 4
#: Classes, and n-grams of their sets (8 MB), in a block, about; longer lists are compared as pairs of blocks.
BLOCK, ENTRIES = 512, 1_000_000
#: Parts of a block, at least, that classes with one longest list come in, so that blocks become of about one size.
PARTS = 8
#: Rows that have an n-gram up to which its pairs of rows are listed; beyond that it is a column of a matrix.
FEW = 16
#: Pairs, or elements of a matrix, that are counted at once.
STRIP = 1_000_000


def shingles(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams: A-Z in lower case, words parted by ASCII white space.

    Fewer words than n make one n-gram of them all; no words, none.
    """
    for w in hashed(texts, SPACED):
        count = len(w.hashes)
        grams = np.full(max(0, count - words + 1), words, np.uint64)
        for i in range(words):
            grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + w.hashes[i : count - words + 1 + i])
        for a, b in zip(w.starts[:-1].tolist(), w.starts[1:].tolist(), strict=True):
            if b - a >= words:
                x = np.sort(grams[a : b - words + 1])
                keep = np.ones(len(x), bool)
                keep[1:] = x[1:] != x[:-1]
                yield x[keep]
            else:
                x = np.full(min(1, b - a), b - a, np.uint64)
                for h in w.hashes[a:b]:
                    x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + h)
                yield x


def prefix_length(n: int, percent: int) -> int:
    """L: tokens of the first prefix."""
    return min(n, 2 * (n * (100 - percent) // 100) + 1)


def need(n: int, percent: int) -> int:
    """A lower bound of the tokens that a set shares with any similar one within both prefixes, whatever the other's size.

    The other has m >= t * n tokens.  A prefix exceeds the slack s(m) by L(m) - s(m): by s(m) + 1, or where L(m) = m
    by at least t * m.  The smaller size bounds it, as s grows with m.
    """
    least = -(-n * percent // 100)
    slack = least * (100 - percent) // 100
    return max(1, min(slack + 1, -(-least * percent // 100)))


def key_of(tokens: np.ndarray) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())


#: Rows of documents (doc_id, n, k1, k2); of messages to owners (message, owner, body); and of tokens that several
#: classes of a message share, by class (message, k1, n).
ROWS = "doc_id long, n long, k1 long, k2 long, message long, owner int, body binary"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("message", pa.int64()), ("owner", pa.int32()), ("body", pa.binary())])


def _messages(held: dict[int, np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For each class the number of its tokens that another of `held` has; owners and bodies.

    A body tells an owner the tokens of its slice, by 32 bits of their hashes: those of one class, with it, and those of
    several, each once.  So a token that a third of all documents have costs its owner one entry a message.
    """
    refs = np.array([*held], np.int64)
    tokens = np.concatenate([*held.values()])
    doc = np.repeat(np.arange(len(refs)), [len(x) for x in held.values()])
    # the low end of the hash range is spread over all owners before its high bits name one
    spread = tokens * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(spread, kind="stable")
    spread, doc = spread[order], doc[order]
    first = np.ones(len(spread), bool)
    first[1:] = spread[1:] != spread[:-1]
    of = np.diff(np.flatnonzero(first), append=len(spread))
    several = np.repeat(of > 1, of)
    shared = np.bincount(doc[several], minlength=len(refs))
    spread, doc, several = spread[first], doc[first], several[first]
    owner = (spread >> np.uint64(64 - bits)).astype(np.int32)
    short = (spread >> np.uint64(32 - bits)).astype(np.uint32)
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    bodies = []
    for a, b in zip(cuts, [*cuts[1:], len(owner)], strict=True):
        alone = ~several[a:b]
        own, at = np.unique(doc[a:b][alone], return_inverse=True)
        parts = (refs[own].astype("<i8"), short[a:b][alone].astype("<u4"), short[a:b][~alone].astype("<u4"), at.astype("<u4" if len(own) > 65_536 else "<u2"))
        bodies.append(struct.pack("<III", len(own), alone.sum(), (~alone).sum()) + b"".join(x.tobytes() for x in parts))
    return shared, owner[cuts], bodies


def _read(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a body the tokens of one class and these classes, and the tokens of several."""
    own, alone, several = struct.unpack_from("<III", body)
    end = 12 + 8 * own + 4 * (alone + several)
    short = np.frombuffer(body, "<u4", alone + several, 12 + 8 * own)
    at = np.frombuffer(body, "<u4" if own > 65_536 else "<u2", alone, end)
    return short[:alone], np.frombuffer(body, "<i8", own, 12)[at], short[alone:]


def _scan(words: int, percent: int, bits: int):
    """ROWS of documents; see there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, np.ndarray] = {}
        size = 0

        def made(rows: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in SCHEMA], schema=SCHEMA)

        def sent() -> Iterator[pa.RecordBatch]:
            shared, owners, bodies = _messages(held, bits)
            yield made(len(owners), message=np.full(len(owners), number), owner=owners, body=bodies)
            some = np.flatnonzero(shared)
            yield made(len(some), message=np.full(len(some), number), k1=np.array([*held], np.int64)[some], n=shared[some])

        for batch in batches:
            n, k1, k2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, tokens in enumerate(shingles(batch.column("text"), words)):
                n[i], (k1[i], k2[i]) = len(tokens), key_of(tokens)
                if len(tokens) and k1[i] not in held:
                    held[int(k1[i])] = tokens[: prefix_length(len(tokens), percent)].copy()
                    size += len(held[int(k1[i])])
                    if size >= RUN:
                        yield from sent()
                        held, size, number = {}, 0, number + 1
            yield made(batch.num_rows, doc_id=batch.column("doc_id"), n=n, k1=k1, k2=k2)
        if held:
            yield from sent()

    return run


def _count(key: tuple[Any, ...], messages: pd.DataFrame) -> pd.DataFrame:
    """Of an owner's messages by class the tokens alone in their message that another class of any message has."""
    read = [_read(x) for x in messages["body"]]
    token, ref = np.concatenate([x[0] for x in read]), np.concatenate([x[1] for x in read])
    number = np.repeat(messages["message"].to_numpy(np.int64), [len(x[0]) for x in read])
    order = np.lexsort((ref, token))
    token, ref, number = token[order], ref[order], number[order]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    at = np.flatnonzero(first)
    other = np.add.reduceat(ref != np.repeat(ref[at], np.diff(at, append=len(token))), at) > 0 if len(at) else np.zeros(0, bool)
    shared = np.repeat(other, np.diff(at, append=len(token))) | np.isin(token, np.concatenate([x[2] for x in read]))
    counts = pd.DataFrame({"k1": ref[shared], "message": number[shared]}).groupby(["k1", "message"]).size().reset_index(name="shared")
    return counts.astype("int64")


def _need(n: Column, percent: int) -> Column:
    least = F.ceil(n * percent / 100)
    return F.greatest(F.lit(1), F.least(F.floor(least * (100 - percent) / 100) + 1, F.ceil(least * percent / 100)))


def _bits(tokens: float) -> int:
    """Owners as a power of two, for so many tokens."""
    return min(30, max(4, int(tokens / PER_OWNER).bit_length()))


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [*shingles(batch.column("text"), words)]
            keys = [key_of(x) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["k1", "k2", "tokens"])

    return run


def _pairs(one: DataFrame, two: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b, salt) of classes of one and two that meet at a token, lie in different components, and have
    sizes that allow a link.  salt deals out the pairs of a class b that has very many (two's column salts)."""
    left, right = one.alias("x"), two.alias("y")
    sizes = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    met = left.join(right, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & sizes)
    salt = F.pmod(F.xxhash64("x.cid"), F.col("y.salts")).cast("int")
    return met.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), salt.alias("salt")).distinct()


def _verified(pairs: DataFrame, live: DataFrame, salts: DataFrame | None, percent: int) -> DataFrame:
    """The pairs that link: first the prefixes of the further orders must meet, then the whole sets are compared.

    salts (cid, salts) names the classes b whose pairs are dealt out: they stand once for each salt.
    """
    pairs = written(pairs, "pairs")
    one = live.select(*[F.col(c).alias(f"{c}_a") for c in live.columns])
    two = live.withColumn("salts", F.lit(1)) if salts is None else live.join(hinted(salts, salts.count()), "cid", "left")
    two = two.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    two = two.select(F.col("salt"), *[F.col(c).alias("b" if c == "cid" else f"{c}_b") for c in live.columns])
    both = one.join(hinted(pairs, pairs.count()), F.col("a") == F.col("cid_a")).join(two, ["b", "salt"])
    shared = F.size(F.array_intersect("set_a", "set_b"))
    links = shared * 100 >= (F.col("n_a") + F.col("n_b") - shared) * percent
    filtered = F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")
    return both.filter(F.when(filtered, links).otherwise(F.lit(False))).select("a", "b")


def _together(flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n rows share; a row's values are distinct, owner tells whose they are.

    Values that one row has count nothing; those of a few rows are counted pair by pair, others as products of strips of a
    matrix, so what is held at once is bounded whatever the rows' lengths.
    """
    order = np.argsort(flat, kind="stable")
    owner, sorted_ = owner[order], flat[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(flat) else np.zeros(0, np.int64)
    sizes = np.diff(starts, append=len(flat))
    out = np.zeros(n * n, np.int32)
    for size in range(2, FEW + 1):
        groups = starts[sizes == size]
        one, two = np.triu_indices(size, 1)
        step = max(1, STRIP // len(one))
        for i in range(0, len(groups), step):
            rows = owner[groups[i : i + step, None] + np.arange(size)]
            out += np.bincount((rows[:, one].astype(np.int64) * n + rows[:, two]).ravel(), minlength=n * n).astype(np.int32)
    out = out.reshape(n, n)
    out = out + out.T
    wide = np.flatnonzero(sizes > FEW)
    step = max(1, STRIP // n)
    for i in range(0, len(wide), step):
        some = wide[i : i + step]
        strip = np.zeros((n, len(some)), np.float32)
        at = np.repeat(starts[some], sizes[some]) + np.arange(sizes[some].sum()) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
        strip[owner[at], np.repeat(np.arange(len(some)), sizes[some])] = 1
        out += (strip @ strip.T).astype(np.int32)
    return out


def _compare(percent: int):
    """Links between components within a block of classes, or across two blocks, as a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        one, two = table["one"][0].as_py(), table["two"][0].as_py()
        n, cid, block = (table[c].to_numpy() for c in ("n", "cid", "block"))
        _, comp = np.unique(table["comp"].to_numpy(), return_inverse=True)

        def lists(column: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
            some = table[column].combine_chunks().take(pa.array(rows))
            return some.flatten().to_numpy(), np.repeat(np.arange(len(rows)), pc.list_value_length(some).to_numpy()), len(rows)

        rows = np.arange(len(n))
        may = (comp[:, None] != comp[None, :]) & (100 * n[:, None] >= percent * n[None, :]) & (100 * n[None, :] >= percent * n[:, None])
        if one != two:
            may &= block[:, None] != block[None, :]
        for order in ("first", "second", "third", None):
            touched = np.flatnonzero(may.any(axis=1))
            if not len(touched):
                return none
            rows, may = rows[touched], may[np.ix_(touched, touched)]
            if order:
                may &= _together(*lists(order, rows)) > 0
        n, cid = n[rows], cid[rows]
        shared = _together(*lists("set", rows))
        linked = may & (100 * shared >= percent * (n[:, None] + n[None, :] - shared))
        label = np.arange(len(n))
        while True:
            least = np.minimum(label, np.where(linked, label[None, :], len(n)).min(axis=1))
            least = least[least]
            if (least == label).all():
                break
            label = least
        moved = label != np.arange(len(n))
        return pa.table({"a": cid[moved], "b": cid[label[moved]]})

    return run


def _dealt(lists: DataFrame, sizes: DataFrame) -> DataFrame:
    """root, one, two, block, cid: the classes of long lists (token, m, least, cid) in pairs of blocks, one row for each pair that
    a class's block is in.  sizes: cid and n.

    Lists that share classes have one root, and those of a root that is small enough are one block.  Else a class goes to a
    block by its longest list, so that lists have few blocks, and only blocks that a list has both of are a pair.
    """
    many = written(components(lists.select(F.col("cid").alias("a"), F.col("least").alias("b"))), "many")
    homes = lists.groupBy("cid").agg(F.max(F.struct("m", "token")).alias("home")).select("cid", "home.token")
    placed = many.select("root", F.col("node").alias("cid")).join(homes, "cid").join(sizes, "cid").withColumnRenamed("token", "home")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) * PARTS / BLOCK), F.ceil(F.sum("n") * PARTS / ENTRIES)).cast("int")
    homes = placed.groupBy("root", "home").agg(blocks.alias("spread"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    roots = homes.groupBy("root").agg(F.greatest(F.ceil(F.sum("c") / BLOCK), F.ceil(F.sum("s") / ENTRIES)).cast("int").alias("blocks"))
    at = F.pmod(F.shiftright(F.xxhash64("home"), 1) + F.pmod(F.xxhash64("cid"), F.col("spread")), F.col("blocks")).cast("int")
    placed = written(placed.join(homes.select("root", "home", "spread"), ["root", "home"]).join(roots, "root").select("root", "cid", at.alias("block")), "blocks")
    of = written(lists.select("token", "cid").join(placed, "cid").select("token", "root", "block").distinct(), "lists")
    one, two = of.select("token", "root", F.col("block").alias("one")), of.select("token", F.col("block").alias("two"))
    pairs = one.join(two, "token").filter("one <= two").select("root", "one", "two").distinct()
    sides = pairs.select("root", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    return placed.join(sides, ["root", "block"])


def _merged(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (cid, comp) of classes after more links (a, b): those of the components that the links touch, united."""
    if parts is None:
        return written(components(links).select(F.col("node").alias("cid"), F.col("root").alias("comp")), "parts")
    one, two = (parts.select(F.col("cid").alias(c), F.col("comp").alias(f"comp_{c}")) for c in "ab")
    between = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    united = components(between).select(F.col("node").alias("old"), F.col("root").alias("new"))
    known = parts.join(united, parts["comp"] == united["old"], "left").select("cid", F.coalesce("new", "comp").alias("comp"))
    fresh = united.join(parts, united["old"] == parts["cid"], "left_anti").select(F.col("old").alias("cid"), F.col("new").alias("comp"))
    return written(known.unionByName(fresh), "parts")


def _with_counts(sets: DataFrame, tokens: int) -> DataFrame:
    """cid and found, an array of (classes, token): the tokens of each class that another class has too.

    Counts are summed in each task first.  The most frequent tokens, at most BROADCAST_ROWS as each has at least that
    part of all, are joined by broadcast, so no key of the shuffled join has more rows.
    """
    flat = sets.select("cid", F.explode("set").alias("token"))
    counts = written(flat.groupBy("token").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1"), "counts")
    few = counts.count() <= BROADCAST_ROWS
    hot = F.broadcast(counts if few else counts.filter(F.col("classes") > tokens // BROADCAST_ROWS + 1))
    found = flat.join(hot, "token")
    if not few:
        found = found.unionByName(flat.join(hot, "token", "left_anti").join(counts, "token").select(*found.columns))
    return found.groupBy("cid").agg(F.collect_list(F.struct("classes", "token")).alias("found"))


def candidates(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' rows with their class (doc_id, n, cid: null without n-grams); the classes that may link (cid, n, set and three orders); their first tokens (cid, n, token)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = narrow.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = _bits(chars / 6 * min(1, 2 * (100 - percent) / 100))
    scanned = written(narrow.mapInArrow(lean(_scan(words, percent, bits)), ROWS), "shingles")
    rows = scanned.filter("message IS NULL").select("doc_id", "n", "k1", "k2")
    counts = scanned.filter("owner IS NOT NULL").select("owner", "message", "body").groupBy("owner").applyInPandas(_count, "k1 long, message long, shared long")
    within = scanned.filter("message IS NOT NULL AND owner IS NULL").select("k1", "message", F.col("n").alias("shared"))
    # a class that several messages tell of has the same sum in each
    counts = counts.unionByName(within).groupBy("k1", "message").agg(F.sum("shared").alias("shared")).groupBy("k1").agg(F.max("shared").alias("shared"))
    classes = rows.filter("n > 0").groupBy("k1", "k2").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "n", "doc_id"), "classes")
    left = written(classes.join(counts, "k1").filter(F.col("shared") >= _need(F.col("n"), percent)).drop("shared"), "left")
    n_left, tokens = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    ids = left.select(F.col("doc_id").alias("id")).distinct()
    texts = narrow.join(hinted(ids, n_left), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    sets = texts.mapInArrow(lean(_sets(words)), "k1 long, k2 long, tokens array<long>")
    sets = written(sets.join(hinted(left.select("cid", "k1", "k2", "n"), n_left), ["k1", "k2"]).select("cid", "n", F.col("tokens").alias("set")), "sets")
    if sets.count() > n_left:  # rows that repeat a doc_id and its text
        sets = written(sets.dropDuplicates(["cid"]), "sets")
    shared = _with_counts(sets, tokens)
    size = F.size("found") - F.ceil(F.col("n") * percent / 100) + 1
    shared = shared.join(hinted(left.select("cid", "n"), n_left), "cid").withColumn("size", size.cast("int")).filter("size > 0")

    def first(key) -> Column:
        return F.transform(F.slice(F.array_sort(F.transform("found", key)), F.lit(1), F.col("size")), lambda x: x["token"])

    orders = written(
        shared.select(
            "cid",
            "n",
            first(lambda x: F.struct(x["classes"].alias("o"), x["token"].alias("token"))).alias("first"),
            first(lambda x: F.struct(F.xxhash64(x["token"], F.lit(2)).alias("o"), x["token"].alias("token"))).alias("second"),
            first(lambda x: F.struct(F.xxhash64(x["token"], F.lit(3)).alias("o"), x["token"].alias("token"))).alias("third"),
        ),
        "orders",
    )
    live = sets.join(orders.select("cid", "first", "second", "third"), "cid")
    postings = orders.select("cid", "n", F.explode("first").alias("token"))
    lists = postings.groupBy("token").count().filter("count > 1").select("token")
    return rows.join(classes.select("k1", "k2", "cid"), ["k1", "k2"], "left").select("doc_id", "n", "cid"), written(live, "live"), written(postings.join(lists, "token"), "postings")


def classes_and_links(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The documents' rows with their class (doc_id, n, cid; null without n-grams), and each linked class's component (cid, comp)."""
    rows, live, postings = candidates(docs, words, percent)
    parts = None

    def placed() -> DataFrame:
        return postings.withColumn("comp", F.col("cid")) if parts is None else postings.join(parts, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))

    for star in range(STARS):
        now = placed()
        drawn = F.min(F.struct(F.xxhash64("cid", F.lit(star)).alias("h"), "cid", "n", "comp")).alias("drawn")
        drawn = now.groupBy("token").agg(drawn, F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m")).filter("low < high")
        drawn = written(drawn.select("token", "drawn.cid", "drawn.n", "drawn.comp", F.ceil(F.col("m") / SALT).cast("int").alias("salts")), "drawn")
        salts = written(drawn.filter("salts > 1").groupBy("cid").agg(F.max("salts").alias("salts")), "salts")
        dealt = drawn.drop("salts").join(hinted(salts, salts.count()), "cid", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        parts = _merged(parts, written(_verified(_pairs(now, dealt, percent), live, salts, percent), "links"))

    now = placed()
    sizes = now.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m"), F.min("cid").alias("least")).filter("low < high")
    still = written(now.join(sizes.select("token", "m", "least"), "token"), "open")
    few = still.filter(F.col("m") <= SMALL)
    pairs = _pairs(few, few.withColumn("salts", F.lit(1)), percent).filter("a < b")
    found = _verified(pairs, live, None, percent)
    dealt = _dealt(still.filter(F.col("m") > SMALL), live.select("cid", "n"))
    comps = live.select("cid").withColumn("comp", F.col("cid")) if parts is None else live.select("cid").join(parts, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    dealt = dealt.join(comps, "cid").join(live, "cid")
    found = found.union(dealt.groupBy("root", "one", "two").applyInArrow(_compare(percent), "a long, b long"))
    return rows, _merged(parts, written(found.distinct(), "links"))


def join(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    Documents link when 100 * shared >= percent * (distinct n-grams of both); a text that is null or has no words has
    no n-grams and no links.  Repeated rows are documents each and link if they have n-grams.  component_id is the
    smallest doc_id that links reach; a null doc_id counts only where there is no other.  Other columns are ignored; an
    empty table gives an empty result.
    """
    rows, parts = classes_and_links(docs, words, percent)
    placed = written(rows.join(parts, "cid", "left").select("doc_id", "n", F.coalesce("comp", "cid").alias("comp")), "placed")
    # one row for each component with n-grams; a hot one is one partial minimum for each task
    least = placed.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("of")).filter("of > 1").select("comp", "component_id")
    least = written(least, "least")
    return placed.join(hinted(least, least.count()), "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, whatever these are named, that stay: of each component the document with
    the smallest doc_id.

    Rows that repeat that doc_id all stay, as does a row with a null doc_id.
    """
    at = join(docs.select("doc_id", "text"), words, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    gone = written(at, "gone")
    return whole(docs).join(hinted(gone, gone.count()), F.col("row.doc_id") == F.col("gone"), "left_anti").select("row.*")
