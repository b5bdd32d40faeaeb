"""Benchmark decontamination by a distributed positional inverted index.

1. build(): one scan hashes the words of all documents and writes their postings.  The index is dealt by document: a block
   of about BLOCK words has, for each of its words, one row with the places where it stands, as gaps, and one row
   that says which documents it holds.  So no posting list grows with the corpus, and a word that a third of all documents
   have is no longer in one block than in another.
2. The items are cut to windows, of which equal ones are asked for once.  A query part of at most PART words is sent to
   all tasks; more words make more parts, each asked of the whole index.
3. A block takes the rows of the parts' words only.  The list of a window's rarest word gives the places where it could
   begin; the lists of its other words, shifted by their place in the window, are intersected with these, the next rarest
   first, by binary search over the block's sorted (word, place) pairs.  What is left are exact phrases.
4. near() starts from the rarest word in the same way and asks for all words of a window within a stretch, in any order.

A word's 64-bit hash stands for it; a phrase is found by the hashes of all its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tarnwright.llm.shared import hinted, lean, quoted, written
from tarnwright.llm.words import classes, hashed

#: Digits, letters (A-Z counts as a-z) and all beyond ASCII; any other character parts words.
TERMS = classes(bytes(b for b in range(256) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
#: Words of a block, about; a longer document is a block of its own.
BLOCK = 1_000_000
#: Words of the items that are sent to all tasks at once.
PART = 1_000_000
#: Candidates that are intersected together.
RUN = 1_000_000
_WORD, _PLACE = np.int64(32), np.int64((1 << 32) - 1)



def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


# --- the index


def _rows(block: int, hashes: np.ndarray, keys: pa.Array, starts: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a block: its documents, and each word's places as gaps."""
    one = lambda x, kind: pa.array([x], kind)
    held = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
    yield pa.RecordBatch.from_arrays([one(block, pa.int64()), one(None, pa.int64()), one(starts.astype("<i4").tobytes(), pa.binary()), held], schema=schema)
    if not len(hashes):
        return
    order = np.argsort(hashes, kind="stable")
    of = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    gaps = np.diff(order, prepend=0)
    gaps[first] = order[first]
    offsets = np.append(first, len(of)).astype(np.int32) * np.int32(4)
    places = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(gaps.astype("<i4"))])
    n = len(first)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(of[first].view(np.int64)), places, pa.nulls(n, held.type)], schema=schema)


def _indexed(schema: pa.Schema, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        keys: list[pa.Array] = []
        total = 0

        def rows() -> Iterator[pa.RecordBatch]:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            yield from _rows(block, np.concatenate(hashes), pa.concat_arrays(keys), starts, schema)

        for batch in batches:
            for run in hashed(batch.column("text"), TERMS, size):
                hashes.append(run.hashes)
                counts.append(np.diff(run.starts))
                keys.append(batch.column("key").slice(run.first, len(run.sizes)))
                total += len(run.hashes)
                if total >= size:
                    yield from rows()
                    hashes, counts, keys, total, block = [], [], [], 0, block + 1
        if keys:
            yield from rows()

    return index


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """The index of the words of docs, in the shared folder: block, token, places, keys.

    token is a word's hash and places its places in the block, in four-byte gaps; where token is null, keys are the keys
    of the block's documents and places where each begins, and the block's end.  A null text has no words; keys may be
    null or repeat, as each row of docs is a document of its own.
    """
    kind = docs.schema[key].dataType
    narrow = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string").alias("text"))
    ddl = f"block long, token long, places binary, keys array<{kind.simpleString()}>"
    return written(narrow.mapInArrow(lean(_indexed(_schema(ddl), size)), ddl), "index")


class Block:
    """A block of the index, as a task reads it."""

    def __init__(self, table: pa.Table):
        """Of the rows of a block, those of words that were asked for; the row of its documents is among them."""
        docs = table.filter(pc.is_null(table["token"]))
        words = table.filter(pc.is_valid(table["token"])).select(["token", "places"]).combine_chunks()
        self.number: int = docs["block"][0].as_py()
        self.keys: pa.Array = docs["keys"].chunk(0)[:1].flatten()
        self.starts = np.frombuffer(docs["places"][0].as_py(), "<i4").astype(np.int64)
        tokens = words["token"].to_numpy().view(np.uint64)
        order = np.argsort(tokens)
        self.tokens = tokens[order]
        places = [np.frombuffer(x.as_buffer(), "<i4") for x in words["places"]]
        lists = [np.cumsum(places[i], dtype=np.int64) for i in order]
        self.counts = np.array([len(x) for x in lists], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])
        flat = np.concatenate([np.zeros(0, np.int64), *lists])
        #: Every (word, place), sorted: the word's number in tokens, above its place.
        self.pairs = np.repeat(np.arange(len(lists), dtype=np.int64), self.counts) << _WORD | flat

    def number_of(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where the block hasn't got it."""
        if not len(self.tokens):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
        return np.where(self.tokens[at] == hashes, at, -1)

    def has(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        pair = word << _WORD | place
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return self.pairs[at] == pair

    def following(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of each word at or after another; beyond the block if there is none."""
        at = np.searchsorted(self.pairs, word << _WORD | np.maximum(place, 0))
        found = self.pairs[np.minimum(at, len(self.pairs) - 1)]
        return np.where((at < len(self.pairs)) & (found >> _WORD == word), found & _PLACE, self.starts[-1] + _PLACE)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1


# --- the windows asked for


class Windows(NamedTuple):
    """Distinct windows of a part's items."""

    terms: np.ndarray  # hashes of the items' words, one after another
    first: np.ndarray  # where each window begins in terms
    length: np.ndarray
    ends: np.ndarray  # of each window's items, in `items`, from 0
    items: np.ndarray
    ids: pa.Array  # each item's id


def windows(ids: pa.Array, words: list[np.ndarray], length: int) -> Windows:
    """The windows of `length` words of each item, or the whole item if it has fewer words, but not none."""
    sizes = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(sizes) - sizes
    each = np.where(sizes == 0, 0, np.maximum(1, sizes - length + 1))
    item = np.repeat(np.arange(len(words)), each)
    first = np.repeat(begin, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    size = np.minimum(sizes, length)[item]
    terms = np.concatenate([np.zeros(0, np.uint64), *words])
    # equal windows stand together when sorted by their words
    padded = np.concatenate([terms, np.zeros(length, np.uint64)])
    columns = [np.where(k < size, padded[first + k], 0) for k in range(length)]
    order = np.lexsort([item, *columns, size])
    same = np.ones(len(order), bool)
    for x in [*columns, size]:
        same[1:] &= x[order][1:] == x[order][:-1]
    same[:1] = False
    heads = np.flatnonzero(~same)
    return Windows(terms, first[order][heads], size[order][heads], np.append(heads, len(order)), item[order], ids)


# --- search


def _candidates(block: Block, w: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of candidates: the window and the place of its rarest word, and of all windows the numbers and the order of their words."""
    of_term = block.number_of(w.terms)
    count = np.append(block.counts, 0)[of_term]
    for length in np.unique(w.length):
        which = np.flatnonzero(w.length == length)
        for a in range(0, len(which), RUN // 16):
            window = which[a : a + RUN // 16]
            at = w.first[window][:, None] + np.arange(length)
            full = (count[at] > 0).all(axis=1)
            window, at = window[full], at[full]
            if not len(window):
                continue
            order = np.argsort(count[at], axis=1, kind="stable")
            word = np.take_along_axis(of_term[at], order, axis=1)
            n = block.counts[word[:, 0]]
            ends = np.cumsum(n)
            total = int(ends[-1])
            for lo in range(0, total, RUN):
                i = np.arange(lo, min(total, lo + RUN))
                row = np.searchsorted(ends, i, "right")
                place = block.pairs[block.begin[word[row, 0]] + i - (ends - n)[row]] & _PLACE
                yield window[row], place, word[row], order[row]


def _phrases(block: Block, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Window and first place of every exact occurrence."""
    windows_, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for window, place, word, order in _candidates(block, w):
        start = place - order[:, 0]
        live = np.flatnonzero(start >= 0)
        for k in range(1, order.shape[1]):
            live = live[block.has(word[live, k], start[live] + order[live, k])]
        start, window = start[live], window[live]
        inside = block.document(start) == block.document(start + w.length[window] - 1)
        windows_.append(window[inside])
        places.append(start[inside])
    return np.concatenate(windows_), np.concatenate(places)


def _stretches(block: Block, w: Windows, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, first place and length of the shortest stretches that hold all words of a window, about each place of its rarest."""
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    for window, place, word, _ in _candidates(block, w):
        doc = block.document(place)
        low, high = np.maximum(block.starts[doc], place - within + 1), np.minimum(block.starts[doc + 1] - 1, place + within - 1)
        live = np.arange(len(place))
        for k in range(1, word.shape[1]):
            live = live[block.following(word[live, k], low[live]) <= high[live]]
        for a in range(0, len(live), max(1, RUN // within)):
            some = live[a : a + max(1, RUN // within)]
            start = low[some][:, None] + np.arange(within)
            end = np.zeros(start.shape, np.int64)
            for k in range(word.shape[1]):
                end = np.maximum(end, block.following(np.broadcast_to(word[some, k][:, None], start.shape), start))
            size = np.where((end <= high[some][:, None]) & (start <= place[some][:, None]), end - start + 1, within + 1)
            best = size.argmin(axis=1)
            size = size[np.arange(len(some)), best]
            fits = size <= within
            out.append((window[some][fits], start[np.arange(len(some)), best][fits], size[fits]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _items(w: Windows, doc: np.ndarray, window: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (document, item) of the windows found, in order of documents, in runs of whole documents."""
    doc, window = np.unique(np.stack([doc, window]), axis=1)
    n = w.ends[window + 1] - w.ends[window]
    before = np.cumsum(n) - n
    run = (before // (4 * RUN))[np.searchsorted(doc, doc)]  # that of the document's first window
    cuts = np.flatnonzero(np.diff(run, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=False):
        of = np.repeat(np.arange(a, b), n[a:b])
        item = w.items[w.ends[window[of]] + np.arange(len(of)) - (before[of] - before[a])]
        yield tuple(np.unique(np.stack([doc[of], item]), axis=1))


def _lists(values: pa.Array, owner: np.ndarray, rows: int) -> pa.ListArray:
    """A list for each row, of the values whose owner it is; owners ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), values)


def _found(block: Block, w: Windows, schema: pa.Schema) -> pa.Table:
    """One row for each document of a block: how many words, the spans that are hit, and the items found."""
    window, place = _phrases(block, w)
    rows, size = len(block.keys), int(block.starts[-1])
    depth = np.bincount(place, minlength=size + 1) - np.bincount(place + w.length[window], minlength=size + 1)
    hit = np.cumsum(depth)[:size] > 0
    edge = np.zeros(size + 1, bool)
    edge[block.starts] = True  # a span ends with its document
    begins = np.flatnonzero(hit & (edge[:size] | ~np.concatenate([[False], hit[:-1]]))) if size else np.zeros(0, np.int64)
    ends = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1 if size else begins
    doc = block.document(begins)
    spans = pa.StructArray.from_arrays([pa.array((x - block.starts[doc]).astype(np.int32)) for x in (begins, ends)], ["start", "end"])
    pairs = [*_items(w, block.document(place), window)]
    owner, item = (np.concatenate([np.zeros(0, np.int64), *[p[i] for p in pairs]]) for i in (0, 1))
    known = w.ids.is_valid().to_numpy(zero_copy_only=False)[item] if len(item) else np.zeros(0, bool)
    owner, item = owner[known], item[known]
    columns = [
        pa.array(np.full(rows, block.number)), pa.array(np.arange(rows)), block.keys, pa.array(np.diff(block.starts)), _lists(spans, doc, rows), _lists(w.ids.take(pa.array(item)), owner, rows),
    ]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _near(block: Block, w: Windows, within: int, schema: pa.Schema) -> pa.Table:
    """One row for each document and item of a block whose words stand within a stretch: the shortest, then the first."""
    window, place, size = _stretches(block, w, within)
    n = w.ends[window + 1] - w.ends[window]
    of = np.repeat(np.arange(len(window)), n)
    item = w.items[w.ends[window[of]] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]
    doc = block.document(place[of])
    order = np.lexsort([place[of], size[of], item, doc])
    first = order[np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0)])] if len(order) else order
    columns = [block.keys.take(pa.array(doc[first])), w.ids.take(pa.array(item[first])), pa.array((place[of] - block.starts[doc])[first]), pa.array(size[of][first])]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in hashed(batch.column("text"), TERMS):
            words = pa.ListArray.from_arrays(pa.array(run.starts, pa.int32()), pa.array(run.hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(run.first, len(run.sizes)), words, pa.array(np.diff(run.starts))], ["id", "words", "n"])


def _parts(items: DataFrame, key: str, text: str, part: int) -> list[DataFrame]:
    """The items' ids and words, in parts of about `part` words at most."""
    kind = items.schema[key].dataType.simpleString()
    narrow = items.select(F.col(quoted(key)).alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    words = written(narrow.mapInArrow(_hashes, f"id {kind}, words array<long>, n long").filter("n > 0").withColumn("deal", F.xxhash64("words", F.monotonically_increasing_id())), "items")
    count = -(-(words.agg(F.sum("n")).first()[0] or 0) // part)
    if count <= 1:
        return [words]
    # twice as many parts as would do if all were full; copies of an item are dealt out too
    return [words.filter(F.pmod("deal", F.lit(2 * count)) == i) for i in range(2 * count)]


def _asked(index: DataFrame, part: DataFrame, length: int, search: Callable[[Block, Windows], pa.Table], schema: str) -> DataFrame | None:
    """The rows that `search` finds in each block for the items of one part; None where that has none."""
    table = part.select("id", "words").toArrow()
    if not table.num_rows:
        return None
    ids, words = table["id"].combine_chunks(), table["words"].combine_chunks()
    flat, ends = words.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(pc.list_value_length(words).to_numpy()))
    asked = index.sparkSession.sparkContext.broadcast(windows(ids, [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], length))
    terms = part.select(F.explode("words").alias("token")).distinct()
    needed = index.join(hinted(terms, len(np.unique(flat))), "token", "left_semi").select(*index.columns)
    rows = index.filter("token IS NULL").unionByName(needed)

    def run(rows: pa.Table) -> pa.Table:
        return search(Block(rows), asked.value)

    return rows.groupBy("block").applyInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", length: int = 10, size: int = BLOCK, part: int = PART) -> DataFrame:
    """One row for each row of docs: its key, n_words, spans (words start to end, from 0, end exclusive, that stand in an
    occurrence of a window of an item, in order and apart) and items (the ids with occurring windows, sorted).

    Words are runs of ASCII letters, of which A-Z counts as a-z, digits, and all characters beyond ASCII.  A window is
    `length` consecutive words of an item, or all of an item with fewer; items without words have none.  Null texts have
    no words.  Rows of docs that repeat give a row each; an id that items repeat counts once, a null one hits words and
    isn't listed.  Other columns are ignored; of an empty table there are no rows, and of no items no hits.
    """
    index = build(docs, key, text, size)
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    ddl = f"block long, row long, {quoted(key)} {kinds[0]}, n_words long, spans array<struct<start: int, end: int>>, items array<{kinds[1]}>"
    schema = _schema(ddl)
    found = [x for p in _parts(items, item, text, part) if (x := _asked(index, p, length, lambda b, w: _found(b, w, schema), ddl)) is not None]
    if not found:
        nothing = windows(pa.array([], schema.field("items").type.value_type), [], length)
        return index.filter("token IS NULL").groupBy("block").applyInArrow(lambda t: _found(Block(t), nothing, schema), ddl).drop("block", "row")
    if len(found) == 1:
        return found[0].select(quoted(key), "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    together = every.groupBy("block", "row").agg(F.first(quoted(key)).alias("key"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return together.select(F.col("key").alias(key), "n_words", _merged("spans").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def _merged(spans: str):
    """Spans in order, with those that meet made one."""
    none = F.array().cast("array<struct<start: int, end: int>>")

    def add(held, x):
        last = F.try_element_at(held, F.lit(-1))
        meets = x["start"] <= last["end"]
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(meets, F.concat(F.slice(held, 1, F.size(held) - 1), F.array(wider))).otherwise(F.concat(held, F.array(x)))

    return F.aggregate(F.array_sort(spans), none, add)


def near(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", length: int = 10, within: int = 20, size: int = BLOCK, part: int = PART) -> DataFrame:
    """Proximity matches: one row for each row of docs and item of which a window's words all stand within `within`
    consecutive words, in any order: the key, the item, and start and length of the shortest such stretch (the first of
    equally short ones).  A word that a window has twice need stand there once.  Nulls and repeats are as in contamination().
    """
    if within < 1:
        raise ValueError("within must be positive")
    index = build(docs, key, text, size)
    ddl = f"{quoted(key)} {docs.schema[key].dataType.simpleString()}, {quoted(item)} {items.schema[item].dataType.simpleString()}, start long, length long"
    schema = _schema(ddl)
    found = [x for p in _parts(items, item, text, part) if (x := _asked(index, p, length, lambda b, w: _near(b, w, within, schema), ddl)) is not None]
    if not found:
        return index.sparkSession.createDataFrame([], ddl)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key, n_words, n_hit, n_items, items_sha256 (of the ids, sorted as strings, joined by commas) and contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    out = found.select(quoted(key), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
