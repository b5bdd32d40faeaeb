"""Runs of repeated words: maximal stretches of a text that repeat a period at least COPIES times.

Documents stay where they are: one scan, no shuffle.  In each Arrow batch

1. numpy tells which stretches of words can hold a run at all: in a run every three words in a row stand there COPIES - 1
   times, so stretches are cut where three words in a row are rarer within them, until none is.  What a cut parts
   no run can span, so runs and their ends stay as they are in the whole text.
2. Each stretch goes through Kolpakov and Kucherov's algorithm.  A suffix automaton gives its Lempel-Ziv factors: the
   longest piece that began before, or a new word.  Main's algorithm finds the runs that cross the start of a factor or
   begin there, by Z functions of the factor and of the words before it.  All other runs lie within a factor, so they are
   copied from where its words stood before, in order of their starts, so that a factor that overlaps its own source is
   copied right.

How far Main's algorithm must look back: let a run of period q end in the factor u and begin before it, and v be the factor
before u.  If v began q or more words after the run did, v's words up to the run's end would have stood q words earlier,
and v would not have ended before u.  So the run begins less than len(v) + q words before u, which, as it has COPIES
periods, is less than (COPIES * len(v) + len(u)) / (COPIES - 1).
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwright.llm.shared import lean, quoted
from tarnwright.llm.words import mixed

#: A run has at least so many periods, and at least so many words.
COPIES, LEAST = 4, 6
#: Bytes of texts that are cut into words together, about.
RUN = 2_000_000


class Run(NamedTuple):
    start: int
    length: int
    period: int


# --- which stretches can hold a run


def stretches(codes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the stretches of words that can hold a run; codes: each word's number, other in each document."""
    often = np.bincount(codes)[codes] >= COPIES if len(codes) else np.zeros(0, bool)
    at = np.flatnonzero(often[:-2] & often[1:-1] & often[2:] & (doc[:-2] == doc[2:])) if len(codes) > 2 else np.zeros(0, np.int64)
    c = codes.astype(np.uint64)
    three = mixed(mixed(mixed(c[at]) + c[at + 1]) + c[at + 2])  # a clash can only keep more than is needed
    stretch = np.zeros(len(at), np.uint64)
    while len(at):
        _, inverse, n = np.unique(three + mixed(stretch), return_inverse=True, return_counts=True)
        good = n[inverse] >= COPIES - 1
        kept = at[good]
        number = np.cumsum(np.diff(kept, prepend=kept[:1] - 2) != 1) - 1 if len(kept) else np.zeros(0, np.int64)
        long = (np.bincount(number)[number] >= LEAST - 2) if len(kept) else np.zeros(0, bool)
        number = number[long]
        _, now = np.unique(number, return_inverse=True)
        same = len(now) == len(at) and len(np.unique(stretch)) == (now[-1] + 1 if len(now) else 0)
        at, three, stretch = kept[long], three[good][long], now.astype(np.uint64)
        if same:
            break
    first = np.flatnonzero(np.diff(stretch.astype(np.int64), prepend=-1))
    return [(int(at[a]), int(at[b - 1]) + 3) for a, b in zip(first, [*first[1:], len(at)], strict=False)] if len(at) else []


# --- factors


class Automaton:
    """The suffix automaton of a sequence.  Most states have one edge, which stands in two arrays; further ones in a dict."""

    def __init__(self, s: list[int]):
        self.symbol, self.target, self.more = array("q", [-1]), array("i", [-1]), {}
        #: For each state: its longest string, its suffix link, and where its strings end first.
        self.length, self.link, self.end = array("i", [0]), array("i", [-1]), array("i", [-1])
        symbol, target, more, length, link, end = self.symbol, self.target, self.more, self.length, self.link, self.end
        last = 0
        for i, c in enumerate(s):
            new = len(length)
            symbol.append(-1), target.append(-1), length.append(i + 1), link.append(0), end.append(i)
            p = last
            last = new
            q = -1
            while p >= 0:
                if symbol[p] < 0:
                    symbol[p], target[p] = c, new
                elif symbol[p] == c:
                    q = target[p]
                    break
                else:
                    edges = more.get(p)
                    if edges is None:
                        more[p] = {c: new}
                    elif c in edges:
                        q = edges[c]
                        break
                    else:
                        edges[c] = new
                p = link[p]
            if q < 0:
                continue
            if length[q] == length[p] + 1:
                link[new] = q
                continue
            twin = len(length)
            symbol.append(symbol[q]), target.append(target[q]), length.append(length[p] + 1), link.append(link[q]), end.append(end[q])
            if q in more:
                more[twin] = dict(more[q])
            link[q] = link[new] = twin
            while p >= 0:
                if symbol[p] == c:
                    if target[p] != q:
                        break
                    target[p] = twin
                elif (edges := more.get(p)) is not None and edges.get(c) == q:
                    edges[c] = twin
                else:
                    break
                p = link[p]

    def follow(self, state: int, c: int) -> int:
        return self.target[state] if self.symbol[state] == c else self.more.get(state, {}).get(c, -1)


def factors(s: list[int]) -> Iterator[tuple[int, int, int]]:
    """Start, end and earlier start (-1 for a new symbol) of each factor: the longest piece that began before, overlaps allowed."""
    a = Automaton(s)
    symbol, target, more, end = a.symbol, a.target, a.more, a.end
    i, n = 0, len(s)
    while i < n:
        state, j, before = 0, i, -1
        while j < n:
            c = s[j]
            state = target[state] if symbol[state] == c else more[state].get(c, -1) if state in more else -1
            if state < 0 or end[state] >= j:  # its first occurrence is this one
                break
            before = end[state]
            j += 1
        if j == i:
            yield i, i + 1, -1
            i += 1
        else:
            yield i, j, before - (j - i) + 1
            i = j


# --- runs


def z(s: list[int]) -> list[int]:
    """For each place, how many symbols from there on equal those from the start."""
    n = len(s)
    out = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = out[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        left, right = i, i + k
    return out


def _crossing(s: list[int], c: int, d: int, back: int) -> dict[tuple[int, int], int]:
    """The runs that hold the word at c, begin at most `back` words before it and end by d: (start, end) to the least period."""
    u, t = s[c:d], s[c - back : c]
    found: list[tuple[int, int, int]] = []
    # half of the periods or more at or after c: q words on, the factor equals itself
    half = len(u) * 2 // COPIES
    if half:
        ahead = z(u)
        fit = [q for q in range(1, half + 1) if q < len(u) and ahead[q] >= (COPIES // 2 - 1) * q]
        if fit:
            m = fit[-1]
            behind = z([*reversed(t), -1, *reversed(u[:m]), *reversed(t)])
            found += [(c - behind[len(t) + 1 + m - q], c + q + ahead[q], q) for q in fit]
    # more than half of them before c: q words back, the words before c equal themselves
    half = len(t) * 2 // COPIES
    if half:
        behind = z(t[::-1])
        fit = [q for q in range(1, half + 1) if q < len(t) and behind[q] >= (COPIES // 2 - 1) * q]
        if fit:
            m = fit[-1]
            ahead = z([*u, -1, *t[-m:], *u])
            found += [(c - q - behind[q], c + k, q) for q in fit if (k := ahead[len(u) + 1 + m - q]) > 0]
    out: dict[tuple[int, int], int] = {}
    for b, e, q in found:
        if e - b >= max(LEAST, COPIES * q) and (b == 0 or s[b - 1] != s[b - 1 + q]) and (e >= len(s) or s[e] != s[e - q]):
            out[b, e] = min(q, out.get((b, e), q))
    return out


def runs(s: list[int]) -> list[Run]:
    """All runs of a sequence of whole numbers from 0, in order of start, then period."""
    at: dict[int, list[tuple[int, int]]] = {}  # start to end and period
    n, before = len(s), 0
    for c, d, source in factors(s):
        back = min(c, (COPIES * before + d - c) // (COPIES - 1) + 1)
        before = d - c
        if source < 0:
            continue
        if back + d - c >= LEAST:
            for (b, e), q in _crossing(s, c, d, back).items():
                at.setdefault(b, []).append((e, q))
        shift = c - source
        if d - c > LEAST:
            for x in range(source + 1, source + d - c):
                for e, q in at.get(x, ()):
                    e = min(e + shift, d)
                    if e - x - shift >= max(LEAST, COPIES * q) and (e < d or d == n or s[d] != s[d - q]):
                        at.setdefault(x + shift, []).append((e, q))
    return sorted((Run(b, e - b, q) for b, ends in at.items() for e, q in ends), key=lambda r: (r.start, r.period))


# --- documents


def _documents(texts: list[bytes]) -> Iterator[tuple[list[Run], bytes, int]]:
    """The runs of each text, its words without repeats of a period, and how many words it had."""
    words = [t.split() for t in texts]  # of bytes: at ASCII white space, which is what parts words here
    sizes = np.array([len(w) for w in words], np.int64)
    fresh = count()
    codes = np.zeros(int(sizes.sum()), np.int64)
    begin = np.cumsum(sizes) - sizes
    for w, a in zip(words, begin, strict=True):
        if len(w) >= LEAST:
            number: defaultdict[bytes, int] = defaultdict(fresh.__next__)
            codes[a : a + len(w)] = [number[x] for x in w]
        else:
            codes[a : a + len(w)] = [next(fresh) for _ in w]
    doc = np.repeat(np.arange(len(words)), sizes)
    found: dict[int, list[Run]] = {}
    for a, b in stretches(codes, doc):
        i = int(doc[a])
        offset = a - int(begin[i])
        _, s = np.unique(codes[a:b], return_inverse=True)
        found.setdefault(i, []).extend(Run(r.start + offset, r.length, r.period) for r in runs(s.tolist()))
    for i, w in enumerate(words):
        mine = sorted(found.get(i, ()), key=lambda r: (r.start, r.period))
        if mine:
            change = np.zeros(len(w) + 1, np.int64)
            np.add.at(change, [r.start + r.period for r in mine], 1)
            np.add.at(change, [r.start + r.length for r in mine], -1)
            kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
            yield mine, b" ".join([w[k] for k in kept.tolist()]), len(w)
        else:
            yield mine, b" ".join(w), len(w)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a = 0
        texts = batch.column("text").cast(pa.large_binary())
        while a < batch.num_rows:
            b, size, some = a, 0, []
            while b < batch.num_rows and (b == a or size < RUN):
                some.append(texts[b].as_py() or b"")
                size += len(some[-1])
                b += 1
            mine, collapsed, n = zip(*_documents(some), strict=True)
            flat = [r for x in mine for r in x]
            spans = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], ["start", "length", "period"])
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in mine])]), pa.int32())
            columns = [batch.column("key").slice(a, b - a), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, spans), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "runs", "collapsed"])
            a = b


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: its key, n_words, runs (start, length, period; by start, then period) and collapsed.

    Words are what ASCII white space parts, and equal only if all their bytes are.  A run is a stretch whose words `period`
    apart are equal, for its least period, at least COPIES periods and LEAST words long, that no neighbouring word
    extends.  collapsed has the words that no run holds after its first period, joined by one space.  A null or empty
    text has no words, no runs and collapses to an empty one.  Rows that repeat give a row each, nulls are a key like any
    other, other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string").alias("text"))
    out = narrow.mapInArrow(lean(_rows), f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("key", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key, n_runs, the longest run (ties: the first, then the least period; nulls if there is none), and digests of
    all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(F.col(quoted(key)), F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        F.col(quoted(key)),
        "n_runs",
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("(1000 * longest.length) div (-longest.period)").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def with_periodic_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and text of docs, where the words of some texts repeat, for tests and measurements.

    Let h be the crc32 of a key in decimal and g = h div 10.  If h divides by 10 and the text has n > 0 words, each word from
    number a = g % n on becomes word a + (i - a) % p of the text, where p = 1 + (n - a) div (3 + g % 8), and the words are
    joined by spaces.  All other texts stay as they are.
    """
    rows = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text")).withColumn("h", F.crc32(F.col("key").cast("string").cast("binary")))
    chosen = F.col("h") % 10 == 0
    words = F.when(chosen, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != ""))
    rows = rows.select("key", "text", chosen.alias("chosen"), F.expr("h div 10").alias("g"), words.alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    # the words up to a, and then words a to a + p over and over
    whole = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), CAST(1 + (n - a) div p AS INT))), 1, n - a))")
    return rows.select(F.col("key").alias(key), F.when(F.col("chosen") & (F.col("n") > 0), F.array_join(whole, " ")).otherwise(F.col("text")).alias(text))
