"""Redaction of personal data and fixed strings.

Fixed strings, however many, are found by one Aho-Corasick automaton a task; personal data by patterns whose finds must pass
a check: octets of an address, the Luhn sum of a card number, the remainder by 97 of an account number.  Of finds that
overlap the longest is taken (ties: the first, then the kind that comes first), until none is left.

Texts stay where they are: one scan, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwright.operators.joins import named

#: Characters of fixed strings that one automaton takes, and so one task at a time; more make more automata, one after another.
AUTOMATON = 20_000_000
#: The kind of a fixed string.
FIXED = "FIXED"


class Detector(NamedTuple):
    kind: str
    pattern: str  # finds don't overlap: the first, and the longest that the pattern's order gives
    length: Callable[[str], int]  # how many of the find's first characters are one of the kind, 0 if none are


def luhn(digits: str) -> bool:
    """Whether the last digit is right: every second digit from it on counts double, and a doubled one over 9 less 9."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def mod97(account: str) -> bool:
    """Whether the account number's first four characters, moved to the end, and letters as 10 to 35, leave 1 by 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _card(found: str) -> int:
    digits = re.sub("[ -]", "", found)
    return len(found) if 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits) else 0


def _account(found: str) -> int:
    for end in range(len(found), 14, -1):  # what follows may be a word of capitals
        bare = found[:end].replace(" ", "")
        if found[end - 1] != " " and (end == len(found) or found[end] == " ") and 15 <= len(bare) <= 34 and mod97(bare):
            return end
    return 0


def _address(found: str) -> int:
    parts = found.split(".")
    return len(found) if len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) else 0


def _secret(found: str) -> int:
    return len(found) if re.search("[0-9]", found) and re.search("[A-Fa-f]", found) else 0


#: What is looked for by default, in the order in which ties are broken.
DETECTORS = (
    Detector("EMAIL", r"[0-9A-Za-z._%+-]+@[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*\.[A-Za-z]{2,}", len),
    Detector("IBAN", r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z])+", _account),
    Detector("CARD", r"[0-9](?:[ -]?[0-9])*", _card),
    Detector("PHONE", r"(?:\+[0-9]+ )?\([0-9]{3}\) [0-9]{3}-[0-9]{4}", len),
    Detector("IP", r"[0-9]+(?:\.[0-9]+)+", _address),
    Detector("SECRET", r"[0-9A-Fa-f]{32,}", _secret),
)


def automaton(strings: list[str]):
    """The automaton of some strings, empty ones left out; None if there are none."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for s in strings:
        if s:
            out.add_word(s, len(s))
    if not len(out):
        return None
    out.make_automaton()
    return out


def finds(text: str, detectors: tuple[Detector, ...], fixed=None) -> list[tuple[int, int, str]]:
    """All finds (start, end, kind), overlaps and all."""
    out = []
    for d in detectors:
        for m in re.finditer(d.pattern, text):
            n = d.length(m[0])
            if n:
                out.append((m.start(), m.start() + n, d.kind))
    if fixed is not None:
        out += [(end - n + 1, end + 1, FIXED) for end, n in fixed.iter(text)]
    return out


def resolved(found: list[tuple[int, int, str]], order: dict[str, int]) -> list[tuple[int, int, str]]:
    """The longest finds that don't overlap, in order of place: a sweep by length over the starts and ends that are taken."""
    from bisect import bisect_left, insort

    taken: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(set(found), key=lambda f: (f[0] - f[1], f[0], order[f[2]])):
        i = bisect_left(taken, (a, b))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
            insort(taken, (a, b, kind))
    return taken


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def redact(docs: DataFrame, fixed: DataFrame | None = None, text: str = "text", spans: str = "spans", redacted: str = "redacted", detectors: tuple[Detector, ...] = DETECTORS, most: int = AUTOMATON) -> DataFrame:
    """docs with spans (start, end, kind, in order, apart; in code points) and the text with [KIND] in their place.

    fixed: its first column's strings are looked for too, as they are written; nulls and empty ones are left out, and repeats
    count once.  A null text has no spans and stays null.  All columns and rows of docs stay; spans and redacted name the new
    columns, and must not be among the old.
    """
    if {spans, redacted} & {*docs.columns} or spans == redacted:
        raise ValueError(f"{spans} and {redacted} need names of their own")
    kinds = [*(d.kind for d in detectors), FIXED]
    order = {k: i for i, k in enumerate(kinds)}
    asked: list = [None]
    if fixed is not None:
        strings = fixed.select(F.col(f"`{fixed.columns[0].replace('`', '``')}`").cast("string").alias("s")).filter("s <> ''").distinct()
        size = strings.agg(F.sum(F.length("s"))).first()[0] or 0
        deals = -(-size // most)
        parts = [strings.filter(F.pmod(F.xxhash64("s"), F.lit(2 * deals)) == i) for i in range(2 * deals)] if deals > 1 else [strings]
        asked = [docs.sparkSession.sparkContext.broadcast([r.s for r in p.collect()]) for p in parts] if size else [None]
    out = docs.select("*", F.array().cast("array<struct<start: long, end: long, kind: string>>").alias(spans))
    for i, part in enumerate(asked):
        # finds of one automaton after another are gathered; the last step, which alone looks for personal data, resolves them
        out = out.withColumn(spans, _gather(part, detectors if i == len(asked) - 1 else (), order, i == len(asked) - 1)(named(text), named(spans)))
    return out.withColumn(redacted, _replaced(named(text), named(spans)))


def _gather(part, detectors: tuple[Detector, ...], order: dict[str, int], last: bool):
    @F.arrow_udf("array<struct<start: long, end: long, kind: string>>")
    def gather(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        words = automaton(part.value) if part is not None else None
        for texts, before in batches:
            rows = []
            for t, held in zip(texts, before, strict=True):
                found = finds(t.as_py(), detectors, words) if t.is_valid else []
                found += [(x["start"], x["end"], x["kind"]) for x in held.as_py() or ()]
                rows.append([{"start": a, "end": b, "kind": k} for a, b, k in (resolved(found, order) if last else set(found))])
            yield pa.array(rows, _SPANS)

    return gather


def _replaced(text, spans):
    """The text between the spans, joined by their kinds."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: x["end"]))
    before = F.transform(spans, lambda x, i: F.concat(F.substr(text, (ends[i] + 1).cast("int"), (x["start"] - ends[i]).cast("int")), F.lit("["), x["kind"], F.lit("]")))
    return F.concat(F.array_join(before, ""), F.substr(text, (F.element_at(ends, -1) + 1).cast("int")))
