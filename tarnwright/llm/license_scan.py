"""Licences in documents, by sentence rules.

A text is cut into sentences; each is normalised and mapped to the identifier of a known licence sentence, or to none.
The runs of identifiers are then matched against ordered licence rules: the first rule whose sequence stands at a place
wins there.  Known sentences that no rule takes are reported as unknown licences.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The work that a notice of the GNU licences is about, and the parts of such notices.
_WORK = r"\w+(?: \w+)*?"
_FREE = rf"{_WORK} is free software you can redistribute it and or modify it under the terms of the"
_LATER = r"(?:of the license )?or at your option any later version"
_FSF = r"as published by the free software foundation"
_LATER_OR_NOT = [("", "(?: only)?"), ("-or-later", rf" (?:{_LATER}|or (?:any )?later(?: version)?)")]
#: Variants of the Creative Commons licences: a key, the licence, and how its parts and version read.
_CC = [
    (f"cc{name}{version}".lower(), f"CC-BY{name}{version}", parts, "".join(f" {x}" for x in version[1:].split(".")) if version else "(?: international| licen[cs]e)?")
    for name, parts in (
        ("-NC-SA", " (?:nc|non ?commercial) (?:sa|share ?alike)"),
        ("-NC-ND", " (?:nc|non ?commercial) (?:nd|no ?deriv(?:ative)?s?(?: works)?)"),
        ("-NC", " (?:nc|non ?commercial)"),
        ("-SA", " (?:sa|share ?alike)"),
        ("-ND", " (?:nd|no ?deriv(?:ative)?s?(?: works)?)"),
        ("", ""),
    )
    for version in ("-1.0", "-2.0", "-2.5", "-3.0", "-4.0", "")
]
_VERB = r"(?:licensed|released|distributed|made available|available|provided|published) under"
_UNDER = rf"(?:this (?:work|software|project|code|file|document|library|program) is )?{_VERB}(?: the terms of)?"

#: The GNU licences: a key, the name, and versions.
_GNU = (("gpl", "gnu general public license", ("2", "3")), ("lgpl", "gnu (?:lesser|library) general public license", ("2", "2 1", "3")), ("agpl", "gnu affero general public license", ("3",)))
#: Licences by their names in statements: a key and how the name reads.
_NAMES: list[tuple[str, str]] = [
    ("mit", r"(?:the )?(?:mit(?: x11)?|x11) licen[cs]e(?: mit)?"),
    ("apache", r"(?:the )?apache (?:software )?(?:licen[cs]e )?(?:version )?(?:v ?)?2(?: 0)?(?: licen[cs]e)?"),
    *[(f"lgpl{v}{n}".replace(" ", ""), rf"(?:the )?(?:gnu (?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl) (?:version |v ?)?{v}{'' if ' ' in v else '(?: 0)?'}{tail}") for v in ("2 1", "2", "3") for n, tail in _LATER_OR_NOT],
    *[(f"agpl3{n}", rf"(?:the )?(?:gnu affero general public licen[cs]e|gnu agpl|agpl) (?:version |v ?)?3(?: 0)?{tail}") for n, tail in _LATER_OR_NOT],
    *[(f"gpl{v}{n}", rf"(?:the )?(?:gnu general public licen[cs]e|gnu gpl|gpl) (?:version |v ?)?{v}(?: 0)?{tail}") for v in ("2", "3") for n, tail in _LATER_OR_NOT],
    *[(f"bsd{n}", rf"(?:the |a )?(?:{n} clause bsd|bsd {n} clause|{word} clause bsd|bsd {word} clause)(?: licen[cs]e)?") for n, word in (("2", "two"), ("3", "three"), ("4", "four"))],
    ("bsd", r"(?:the |a )?bsd licen[cs]e"),
    ("mpl", r"(?:the )?(?:mozilla public licen[cs]e|mpl) (?:version |v ?)?2 0"),
    ("isc", r"(?:the )?isc licen[cs]e"),
    ("zlib", r"(?:the )?zlib(?: libpng)? licen[cs]e"),
    ("boost", r"(?:the )?boost software licen[cs]e (?:version |v ?)?1 0"),
    *[(f"epl{v[0]}", rf"(?:the )?(?:eclipse public licen[cs]e|epl) (?:version |v ?)?{v}(?: which .*)?") for v in ("1 0", "2 0")],
    ("wtfpl", r"(?:the )?(?:do what the fuck you want to public licen[cs]e|wtfpl)(?: (?:version |v ?)?2(?: 0)?)?"),
    *[(key, rf"(?:a |the )?(?:cc|creative commons) (?:by|attribution){parts}{version}(?: (?!nc |nd |sa |\d).*)?") for key, _, parts, version in _CC],
    ("cc0", r"(?:the )?(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: .*)?"),
]
#: Names that stand as headings, alone in a sentence or line: a key of _NAMES, and how the heading reads.
_HEADINGS: list[tuple[str, str]] = [
    ("mit", r"(?:the )?mit licen[cs]e(?: mit)?"),
    ("apache", r"apache licen[cs]e version 2 0(?: january 2004)?"),
    *[(f"bsd{n}", rf"(?:the )?(?:bsd {n} clause|{n} clause bsd) licen[cs]e") for n in "234"],
    ("isc", r"(?:the )?isc licen[cs]e(?: isc)?"),
    ("mpl", r"mozilla public licen[cs]e version 2 0"),
    ("boost", r"boost software licen[cs]e version 1 0(?: (?:august 17th|17 august) 2003)?"),
    *[(f"epl{v[0]}", rf"eclipse public licen[cs]e (?:v |version )?{v}") for v in ("1 0", "2 0")],
    ("wtfpl", r"do what the fuck you want to public licen[cs]e(?: version 2 december 2004)?"),
    ("zlib", r"(?:the )?zlib(?: libpng)? licen[cs]e"),
    ("unlicense", r"the unlicense"),
]

# Sentences of well-known licence texts, normalised (lower case, letters and digits only, one space), as
# patterns that a whole sentence must match; the first that matches names it.
SENTENCES: list[tuple[str, str]] = [
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction .* subject to the following conditions"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability .*"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-head", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", r"(?:\d+ )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", r"(?:\d+ )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-advert", r"(?:\d+ )?all advertising materials mentioning features or use of this software must display the following acknowledge?ments?"),
    ("bsd-credit", r"this product includes software developed by .*"),
    ("bsd-names", r"(?:\d+ )?neither the name of .* nor the names of (?:its|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-as-is", r"this software is provided by the copyright holders? and contributors as is and any express or implied warranties .* are disclaimed"),
    ("bsd-liability", r"in no event shall the copyright (?:holder|owner)s? or contributors be liable for any .* damages? .*"),
    ("apache-terms", r"licensed under the apache license version 2 0 the license"),
    ("apache-compliance", r"you may not use this file except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0"),
    ("apache-as-is", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-see", r"see the license for the specific language governing permissions and limitations under the license"),
    *[(f"{key}{v}-or-later".replace(" ", ""), rf"{_FREE} {name} {_FSF}(?: either)? version {v}(?: 0)? {_LATER}") for key, name, versions in _GNU for v in versions],
    # without later versions: the version stands before or after the publisher
    *[(f"{key}{v}".replace(" ", ""), rf"{_FREE} {name} (?:version {v}(?: 0)?(?: only)? {_FSF}|{_FSF} version {v}(?: 0)?(?: of the license)?(?: only)?)") for key, name, versions in _GNU for v in versions],
    *[(f"{key}{v}-title".replace(" ", ""), rf"(?:the )?{name} version {v}(?: \d+)? (?:january|february|march|april|may|june|july|august|september|october|november|december) (?:\d+ )?\d{{4}}") for key, name, versions in _GNU for v in versions],
    ("gpl2-first", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl3-first", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl3-first", r"the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("gpl-hope", rf"{_WORK} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", r"see the gnu (?:lesser |library |affero )?general public license for more details"),
    ("gpl-copy", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with .*"),
    *[(f"under-{key}", rf"{_UNDER} {name}") for key, name in _NAMES],
    *[(f"head-{key}", name) for key, name in _HEADINGS],
    ("epl2-terms", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:version |v ?)?2 0(?: which .*)?"),
    ("epl1-terms", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:version |v ?)?1 0(?: which .*)?"),
    ("zlib-as-is", r"this software is provided as is without any express or implied warranty"),
    ("zlib-liability", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost-grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software .* all subject to the following"),
    ("boost-see", r"see accompanying file license 1 0 txt or copy at (?:https? )?www boost org license 1 0 txt"),
    ("wtfpl-copies", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("wtfpl-want", r"(?:0 )?you just do what the fuck you want to"),
    ("mpl-terms", r"this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)?(?: 2 0)?"),
    ("mpl-copy", r"if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("unlicense-free", r"this is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("all-rights", r"(?:(?:copyright|c \d{4}|\d{4})(?: (?:(?!licen[cs]|permi[st]|redistrib|free software).)*)? )?all rights reserved"),
    ("terms-of-license", r"(?:see|refer to) the licen[cs]e file for (?:details|more information|terms)"),
]

_GNU_NAMES = [("GPL-2.0", "gpl2"), ("GPL-3.0", "gpl3"), ("LGPL-2.0", "lgpl2"), ("LGPL-2.1", "lgpl21"), ("LGPL-3.0", "lgpl3"), ("AGPL-3.0", "agpl3")]
#: The licence of each key of _NAMES and _HEADINGS.
_NAME_OF: dict[str, str] = {
    "mit": "MIT", "apache": "Apache-2.0", "bsd2": "BSD-2-Clause", "bsd3": "BSD-3-Clause", "bsd4": "BSD-4-Clause", "bsd": "BSD", "mpl": "MPL-2.0", "isc": "ISC", "zlib": "Zlib", "boost": "BSL-1.0",
    "epl1": "EPL-1.0", "epl2": "EPL-2.0", "wtfpl": "WTFPL", "unlicense": "Unlicense", "cc0": "CC0-1.0",
} | {key: name for key, name, _, _ in _CC} | {f"{key}{n}": f"{name}{n}" for name, key in _GNU_NAMES for n in ("", "-or-later")}

#: Ordered rules: licence, its sentences in turn.  Whole texts come before single statements.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("ISC", ("isc-grant",)),
    *[("BSD-4-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-advert", *credit, "bsd-names", *more)) for credit in (("bsd-credit",), ()) for more in (("bsd-as-is", "bsd-liability"), ())],
    ("BSD-3-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-head", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-terms", "apache-compliance", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-terms", "apache-compliance", "apache-copy")),
    ("Apache-2.0", ("apache-terms",)),
    *[(f"{name}{n}", (f"{key}{n}", *more)) for name, key in _GNU_NAMES for n in ("-or-later", "") for more in (("gpl-hope", "gpl-see", "gpl-copy"), ())],
    *[(name, (f"{key}-title", *more)) for name, key in _GNU_NAMES for more in ((f"{key}-first",), ())],
    *[(name, (f"{key}-first",)) for name, key in _GNU_NAMES],
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("under-boost", "boost-see")),
    ("BSL-1.0", ("boost-grant",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("EPL-1.0", ("epl1-terms",)),
    ("WTFPL", ("head-wtfpl", "wtfpl-copies", "head-wtfpl", "wtfpl-want")),
    ("WTFPL", ("wtfpl-copies",)),
    ("WTFPL", ("wtfpl-want",)),
    *[(_NAME_OF[key], (f"under-{key}",)) for key, _ in _NAMES],
    *[(_NAME_OF[key], (f"head-{key}",)) for key, _ in _HEADINGS],
    ("MPL-2.0", ("mpl-terms", "mpl-copy")),
    ("MPL-2.0", ("mpl-copy",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("All-Rights-Reserved", ("all-rights",)),
]
UNKNOWN = "unknown"
#: Words of which every known sentence has some; texts without any are read no further.
HINT = r"(?i)licen[sc]e|creativecommons|lgpl|what[^0-9a-z]+the[^0-9a-z]+fuck|advertising|product[^0-9a-z]+includes|unencumbered|anyone[^0-9a-z]+is[^0-9a-z]+free|mozilla|permission|redistribut|warrant|liable|gnu general|rights[^0-9a-z]+reserved|(?:released|distributed|available|provided|published)[^0-9a-z]+under"
_COMPILED = [(i, re.compile(p)) for i, p in SENTENCES]
#: An identifier, or an expression of some, in a line of its own or at the end of a sentence.
_ID = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.:-]*[A-Za-z0-9])?\+?\)*"
_SPDX = re.compile(rf"[^0-9A-Za-z]*SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)(?=[^0-9A-Za-z\n]*(?:\n|\Z)|[.,;][ \t])", re.I)
#: Identifiers that are a word without a version or variant; others have a digit or a hyphen.
_SPDX_WORDS = {x.lower(): x for x in ("MIT", "ISC", "Zlib", "Unlicense", "WTFPL", "NCSA", "PostgreSQL", "OpenSSL", "Ruby", "Vim", "curl", "NTP", "Beerware", "Info-ZIP", "libtiff", "Libpng", "TCL", "OLDAP", "NONE", "NOASSERTION")}
#: Sentences that run on over a colon, a semicolon or a blank line.
_RUN_ON = {f"{key}{n}" for _, key in _GNU_NAMES for n in ("", "-or-later")} | {"gpl-hope", "apache-copy", "boost-see"}
#: First words of the other known sentences.
_HEADS = re.compile(r"(?:permission|the|in|all|if|anyone|everyone|copyright|c|redistributions?|neither|this|licensed|released|distributed|made|available|provided|published|you|unless|see|refer|mit|apache|bsd|isc|mozilla|boost|eclipse|do|zlib|gnu|\d+)\b")
#: A Creative Commons licence by its address.
_CC_URL = re.compile(r"creativecommons\.org/(?:licenses/(by(?:-nc)?(?:-sa|-nd)?)/([1-4]\.[05])|publicdomain/(zero)/1\.0)", re.I)
_ATOM = re.compile(r"[^.!?;:\n]*(?:[.:](?=[^\s.!?;:])[^.!?;:\n]*)*")
_DROP = re.compile(r"[^0-9a-z]+")
def normalised(sentence: str) -> str:
    return _DROP.sub(" ", sentence.lower()).strip()


def identify(sentence: str, known: list[tuple[str, re.Pattern]] = _COMPILED) -> str | None:
    """The identifier of a normalised sentence."""
    return next((name for name, pattern in known if pattern.fullmatch(sentence)), None)


def _identifier(text: str, at: int) -> tuple[str, int] | None:
    """The SPDX identifier or expression that a tag at a place gives, and its end."""
    m = _SPDX.match(text, at)
    if not m:
        return None
    words = re.split(r"([ \t()+]+)", m[1])
    if not all(re.search(r"[0-9-]", w) or w.lower() in _SPDX_WORDS or w.lower() in ("and", "or", "with") for w in words[::2] if w):
        return None
    return "".join(w.upper() if w.lower() in ("and", "or", "with") else _SPDX_WORDS.get(w.lower(), w) for w in words), m.end(1)


class _Pattern:
    """A sentence's pattern, split at its first gap of any words, so that one search of a text finds the tails for all heads."""

    def __init__(self, order: int, name: str, pattern: str):
        self.order, self.name = order, name
        gap, self.banned = " .* ", None
        if name == "all-rights" and pattern.startswith("(?:"):  # the gap is optional, and must not hold these words
            self.banned = re.compile(r"licen[cs]|permi[st]|redistrib|free[ \n]software")
            pattern = r"(?:copyright|c \d{4}|\d{4}) .* all rights reserved"
        elif pattern.startswith(_WORK):
            pattern = r"\w+ .* " + pattern[len(_WORK) + 1 :]
        head, self.gap, tail = pattern.partition(gap)
        self.least = 1 if self.banned or pattern.startswith(r"\w+ ") else 2  # words may be missing from the gap of these
        self.head = self._compiled(head, not self.gap)
        self.tail = self._compiled(tail, True) if self.gap else None

    @staticmethod
    def _compiled(pattern: str, end: bool) -> re.Pattern:
        """Words may be parted by the end of an atom, a newline here; a sentence ends with an atom."""
        return re.compile(pattern.replace(" ", "[ \n]") + (r"(?=\n|\Z)" if end else r"(?=[ \n]|\Z)"), re.S)


class _Stretch:
    """Atoms between two ends of sentences, normalised, with a newline between two of them."""

    def __init__(self, text: str, atoms: list[tuple[int, int]], first: int, last: int):
        parts = [normalised(text[a:b]) for a, b in atoms[first : last + 1]]
        self.first, self.starts, self.ends, at = first, [], [], 0
        for p in parts:  # an atom without words has no place of its own
            self.starts.append(at)
            self.ends.append(at + len(p))
            at += len(p) + (1 if p else 0)
        self.text = "\n".join(p for p in parts if p)
        self.empty = [not p for p in parts]
        #: Where statements may begin within a sentence.
        self.within = [m.start() for m in _WITHIN.finditer(self.text)]
        self._tails: dict[str, tuple[list[int], list[int], list[int]]] = {}

    def atom(self, end: int) -> int:
        """The number of the atom that ends at a place."""
        i = bisect_left(self.ends, end)
        while self.empty[i]:
            i += 1
        return self.first + i

    def match(self, p: _Pattern, at: int) -> int:
        """The furthest end of a sentence that begins at a place, or -1."""
        m = p.head.match(self.text, at)
        if not m or not p.gap:
            return m.end() if m else -1
        starts, ends, banned = self._tails.get(p.name) or self._tails.setdefault(p.name, self._found(p))
        high = len(starts)
        if banned and (k := bisect_left(banned, m.end())) < len(banned):
            high = bisect_left(starts, banned[k])
        return ends[high - 1] if high and starts[high - 1] >= m.end() + p.least else -1

    def _found(self, p: _Pattern) -> tuple[list[int], list[int], list[int]]:
        found = [(m.start(), m.end()) for m in p.tail.finditer(self.text) if m.start() == 0 or self.text[m.start() - 1] in " \n"]
        return [a for a, _ in found], [b for _, b in found], [m.start() for m in p.banned.finditer(self.text)] if p.banned else []


_PATTERNS = [_Pattern(i, name, p) for i, (name, p) in enumerate(SENTENCES)]
_PLAIN = [p for p in _PATTERNS if p.name not in _RUN_ON] + [_Pattern(i, name, "all rights reserved") for i, (name, _) in enumerate(SENTENCES) if name == "all-rights"]
_RUNNING = [p for p in _PATTERNS if p.name in _RUN_ON]
_WITHIN = re.compile(rf"(?<![0-9a-z]){_VERB}(?: the terms of)?(?: either(?: of)?)? ".replace(" ", "[ \n]"))
_ALSO = re.compile(r"[ \n](?:and[ \n])?(?:or|and)[ \n](?:under[ \n])?(?:the[ \n]terms[ \n]of[ \n])?")
_NAMED = [(f"under-{key}", re.compile(name.replace(" ", "[ \n]") + r"(?=[ \n]|\Z)", re.S)) for key, name in _NAMES]


def _statements(stretch: _Stretch, at: int) -> list[tuple[str, int, int]]:
    """The licences that a statement within a sentence names, one or several, if it ends where an atom does."""
    m = _WITHIN.match(stretch.text, at)
    out, at = [], m.end()
    while True:
        fits = [(f.end(), -i) for i, (_, p) in enumerate(_NAMED) if (f := p.match(stretch.text, at))]
        if not fits:
            return []
        end, i = max(fits)
        # a name's open end must not swallow the next name
        if (k := next((x.start() for x in _ALSO.finditer(stretch.text, at, end) if any(p.match(stretch.text, x.end()) for _, p in _NAMED)), None)) is not None:
            shorter = [(f.end(), -j) for j, (_, p) in enumerate(_NAMED) if (f := p.match(stretch.text, at, k))]
            end, i = max(shorter) if shorter else (end, i)
        out.append((_NAMED[-i][0], at, end))
        if end >= len(stretch.text) or stretch.text[end] == "\n" and not (_ALSO.match(stretch.text, end) and any(p.match(stretch.text, _ALSO.match(stretch.text, end).end()) for _, p in _NAMED)):
            return out
        also = _ALSO.match(stretch.text, end)
        if not also:
            return []
        at = also.end()


def _stretches(text: str, atoms: list[tuple[int, int]], end: re.Pattern) -> list[tuple[int, int]]:
    """First and last atom of each stretch that no end of a sentence parts."""
    ends = [i for i in range(len(atoms) - 1) if end.search(text, atoms[i][1], atoms[i + 1][0])]
    return [*zip([0, *(i + 1 for i in ends)], [*ends, len(atoms) - 1], strict=True)] if atoms else []


def _word(text: str, start: int, end: int, number: int) -> tuple[int, int]:
    """Start and end of a word of an atom."""
    m = next(m for i, m in enumerate(re.finditer("[0-9a-z]+", text[start:end].lower())) if i == number)
    return start + m.start(), start + m.end()


_END, _HARD_END = re.compile(r"[.!?;:]|\n\n"), re.compile(r"[.!?]")


def _known(text: str) -> Iterator[tuple[str, int, int]]:
    """(identifier, start, end) of the sentences of a text, in order.  Sentences that no pattern knows, but that read like part of a
    licence, have the identifier None."""
    atoms = [(m.start(), m.end()) for m in _ATOM.finditer(text) if m.end() > m.start()]
    plain, running = _stretches(text, atoms, _END), _stretches(text, atoms, _HARD_END)
    urls = [(f"CC-{m[1].upper()}-{m[2]}" if m[1] else "CC0-1.0", m.start(), m.end()) for m in _CC_URL.finditer(text)]
    held: dict[tuple[int, int], _Stretch] = {}
    some = lambda span: held.get(span) or held.setdefault(span, _Stretch(text, atoms, *span))
    i = p = r = 0
    quiet = True  # whether the present stretch has no known sentence yet
    while i < len(atoms):
        start = atoms[i][0]
        while plain[p][1] < i:
            held.pop(plain[p], None)
            p, quiet = p + 1, True
        while running[r][1] < i:
            held.pop(running[r], None)
            r += 1
        while urls and urls[0][2] <= start:
            urls.pop(0)
        if tag := _identifier(text, start):
            yield f"spdx {tag[0]}", start, tag[1]
            quiet = False
            while i < len(atoms) and atoms[i][0] < tag[1]:
                i += 1
            continue
        near = some(plain[p])
        at = near.starts[i - near.first]
        best: tuple[int, int, str] | None = None
        if not near.empty[i - near.first]:
            if _HEADS.match(near.text, at):
                best = max(((near.atom(e), -x.order, x.name) for x in _PLAIN if (e := near.match(x, at)) >= 0), default=None)
            far = some(running[r])
            there = far.starts[i - far.first]
            long = max(((far.atom(e), -x.order, x.name) for x in _RUNNING if (e := far.match(x, there)) >= 0), default=None)
            best = max(filter(None, (best, long)), default=None)
        if best:
            yield best[2], start, atoms[best[0]][1]
            i, quiet = best[0] + 1, False
            continue
        # statements within the sentence, of which this atom holds the beginning
        end_of_atom, found = near.ends[i - near.first], []
        for a in near.within[bisect_left(near.within, at) : bisect_left(near.within, end_of_atom)]:
            if found := _statements(near, a):
                break
        if found:
            for name, a, b in found:
                j, k = (bisect_right(near.starts, x) - 1 for x in (a, b - 1))
                while near.empty[j]:
                    j -= 1
                while near.empty[k]:
                    k -= 1
                first = _word(text, *atoms[near.first + j], near.text.count(" ", near.starts[j], a))
                last = _word(text, *atoms[near.first + k], near.text.count(" ", near.starts[k], b))
                yield name, first[0], last[1]
            i, quiet = near.first + k + 1, False
            continue
        if urls and urls[0][1] < atoms[i][1]:
            yield f"spdx {urls[0][0]}", urls[0][1], urls[0][2]
            quiet = False
        if i == plain[p][1] and quiet and _LIKE.search(near.text):
            yield None, atoms[near.first][0], atoms[i][1]
        i += 1


#: Words of unknown sentences that may change what a licence says.
_LIKE = re.compile(r"\b(?:licen[cs]e[de]?|permi(?:ssion|tted)|redistribut|must|shall|acknowledg|warrant|liab)")


def sentences(text: str) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of the known sentences of a text, in order; a sentence ends at .!?;: or where a line does.

    A sentence that is wrapped over lines is found too, however many: lines are joined while no sentence ends between them.
    Known sentences with : or ; or a blank line within are joined over these.  An SPDX tag is a sentence, "spdx" and the
    identifier, and so is the address of a Creative Commons licence.  A statement such as "licensed under the MIT license" is
    found within a sentence too, with all the licences that it names, if it ends where a line or sentence does.
    """
    return [x for x in _known(text) if x[0]]


def licenses(found: list[tuple[str | None, int, int]]) -> list[tuple[str, int, int]]:
    """(licence, start, end) by the ordered rules; a known sentence that no rule takes is an unknown licence.

    A sentence without an identifier is none, but no rule reaches over it.
    """
    names, out, i = [x[0] for x in found], [], 0
    while i < len(names):
        if names[i] is None:
            i += 1
            continue
        if names[i].startswith("spdx "):
            out.append((names[i][5:], *found[i][1:]))
            i += 1
            continue
        for name, sequence in RULES:
            if tuple(names[i : i + len(sequence)]) == sequence:
                out.append((name, found[i][1], found[i + len(sequence) - 1][2]))
                i += len(sequence)
                break
        else:
            out.append((UNKNOWN, found[i][1], found[i][2]))
            i += 1
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_sentences, and licenses, an array of (license, start, end) by position.

    Positions count code points of the text.  A null or empty text has no sentences.  Repeated rows repeat, other
    columns are ignored, an empty table gives an empty result.
    """
    spans = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[*_known(t.as_py())] if t.is_valid else [] for t in batch.column("hinted")]
            rows = [[{"license": n, "start": a, "end": b} for n, a, b in licenses(x)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sum(y[0] is not None for y in x) for x in found], pa.int64()), pa.array(rows, spans)], ["doc_id", "n_sentences", "licenses"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(HINT), F.col("text")).alias("hinted"))
    return narrow.mapInArrow(run, "doc_id long, n_sentences long, licenses array<struct<license:string,start:long,end:long>>")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_licenses, licenses (distinct names, sorted, joined by commas), first_start (null if none).

    One row for each row of docs, as of scan(): no licences, an empty string and a null start for a null or empty text.
    Where several patterns know a sentence the first names it, and where several rules fit a place the first wins.
    """
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    return scan(docs).select("doc_id", "n_sentences", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.array_min(F.transform("licenses", lambda x: x["start"])).alias("first_start"))
