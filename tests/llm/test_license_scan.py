import re

from tarnwright.llm import license_scan as op

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE."""
LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY-ND 3.0.": "CC-BY-ND-3.0",
    "Licensed under CC BY-NC-SA 2.5 by its authors.": "CC-BY-NC-SA-2.5",
    "Licensed under CC BY-NC-ND.": "CC-BY-NC-ND",
    "Available under the Creative Commons Attribution 4.0.": "CC-BY-4.0",
    "Available under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
    "Licensed under a two-clause BSD license.": "BSD-2-Clause",
    "Licensed under the BSD License.": "BSD",
    "Licensed under the GPL version 2 or later.": "GPL-2.0-or-later",
    "Licensed under the Mozilla Public License, version 2.0.": "MPL-2.0",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
    "Released under CC0 1.0.": "CC0-1.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "See the LICENSE file for details.": "unknown",
}


#: Notices and what they name.
NOTICES = {
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": ["GPL-2.0"],
    "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.": ["GPL-3.0"],
    "The Very Long Name Of Some Quite Important Program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": ["GPL-3.0-or-later"],
    "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991": ["GPL-2.0"],
    "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007": ["GPL-3.0"],
    "The licenses for most software are designed to take away your\nfreedom to share and change it.": ["GPL-2.0"],
    "The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.": ["GPL-3.0"],
    "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:": ["Zlib"],
    "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt or copy at\nhttps://www.boost.org/LICENSE_1_0.txt)": ["BSL-1.0"],
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution.": ["EPL-2.0"],
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004": ["WTFPL"],
    "Everyone is permitted to copy and distribute verbatim or modified\ncopies of this license document, and changing it is allowed as long\nas the name is changed.": ["WTFPL"],
    "MIT License": ["MIT"],
    "The MIT License (MIT)": ["MIT"],
    "Apache License\nVersion 2.0, January 2004": ["Apache-2.0"],
    "BSD 3-Clause License": ["BSD-3-Clause"],
    "Licensed under either of Apache License, Version 2.0 or MIT license.": ["Apache-2.0", "MIT"],
    "This crate is licensed under either the MIT license or the Apache License 2.0.": ["MIT", "Apache-2.0"],
    "Text by Ann, licensed under CC BY 4.0.": ["CC-BY-4.0"],
    "The code in this folder is released under the terms of the\nBSD 2-Clause License.": ["BSD-2-Clause"],
    "See https://creativecommons.org/licenses/by-nc/4.0/ for details": ["CC-BY-NC-4.0"],
    "http://creativecommons.org/publicdomain/zero/1.0/": ["CC0-1.0"],
}
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{more}3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
ADVERT = """3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
   This product includes software developed by the organization.
"""


def test_notices():
    for text, want in NOTICES.items():
        for form in (text, f"words before.\n\n{text}\n\nWords after", "\n".join(f" * {x}" for x in text.split("\n"))):
            assert names(form) == want, form


def test_four_clauses_and_clauses_of_its_own():
    assert names(BSD.format(more="")) == ["BSD-3-Clause"]
    assert names(BSD.format(more=ADVERT)) == ["BSD-4-Clause"]
    # a clause that no pattern knows is no part of a licence that is known
    assert "BSD-3-Clause" not in names(BSD.format(more="3. Redistributions must be printed on yellow paper.\n"))


def test_grants_of_many_words_on_many_lines():
    words = "including without limitation the rights to use and to copy " * 1_000
    for width in (1, 8, 1_000):
        lines = words.split()
        lines = "\n".join(" ".join(lines[i : i + width]) for i in range(0, len(lines), width))
        grant = MIT.replace("including without limitation the rights", lines)
        assert names(grant) == ["MIT"], width
    name = " ".join(["Very"] * 10_000)
    assert names(next(t for t in NOTICES if t.startswith("The Very Long")).replace("The Very Long", name)) == ["GPL-3.0-or-later"]
    assert names(f"Copyright 2020 {name}\nAll rights reserved.") == ["All-Rights-Reserved"]


def test_many_heads_without_tails_take_linear_time():
    import time

    for text in ("Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction\n" * 2_000, "copyright 2020\n" * 30_000, "Neither the name of\n" * 30_000, "x licensed under mit\n" * 20_000):
        began = time.perf_counter()
        names(text)
        assert time.perf_counter() - began < 40


def names(text):
    return [x[0] for x in op.licenses([*op._known(text)])]


def test_whole_texts_and_lines():
    assert [x[0] for x in op.sentences(MIT)] == ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]
    assert names(MIT) == ["MIT"] and names(MIT.split("THE SOFTWARE")[0]) == ["unknown", "unknown"]
    for line, name in LINES.items():
        for text in (line, f"Words | before\n{line}\nafter", f"One. {line} Two.", line.replace(" the ", "\n the ")):
            assert names(text) == [name], text
        (_, a, b), = op.licenses(op.sentences("é. " + line))
        assert ("é. " + line)[a:b].strip() == line[:-1]
    assert names("The licence of a driver was under the MIT building. He licensed under nothing.") == []


def test_wrapped_at_any_width():
    """Sentences run over as many lines as they take, down to a word a line, with any white space and marks between."""
    words = MIT.split()
    for width in (1, 2, 3, 7, 1000):
        lines = [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
        assert names("\n".join(lines)) == ["MIT"], width
        assert names(("\n" + " " * 300).join(lines)) == ["MIT"], width
    assert names("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/.") == ["MPL-2.0"]


def test_long_text_without_sentence_ends_takes_linear_time():
    import time

    text = "the software is licensed under\n" * 20_000
    began = time.perf_counter()
    assert names(text) == [] and time.perf_counter() - began < 60


def test_every_head_is_known():
    """Where a pattern of a plain sentence fits, the heads let it be tried."""
    for line in [*LINES, *NOTICES, *re.split(r"(?<=[.:])\s+", MIT + BSD.format(more=ADVERT))]:
        text = op.normalised(line)
        if any(p.head.match(text) for p in op._PLAIN):
            assert op._HEADS.match(text), line
        assert names(line) or not op.identify(text), line


def test_every_sentence_has_a_hint():
    for line in [*LINES, *re.split(r"(?<=[.:])\s", MIT)]:
        if op.identify(op.normalised(line)):
            assert re.search(op.HINT, line), line
    for name, pattern in op.SENTENCES:
        plain = re.sub(r"licen\[cs\]e", "license", pattern).replace("(?:licensed|released|distributed|available|provided)", "released")
        assert re.search(op.HINT, plain), name


def test_scan(spark):
    rows = [(1, None), (2, ""), (3, MIT), (3, MIT), (None, "Released under the MIT License."), (5, "word " * 50000 + "\nLicensed under CC BY-NC 4.0.\n" + MIT), (6, "plain words")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id int, text string, hinted int")
    out = sorted((str(r.doc_id), r.n_sentences, r.n_licenses, r.licenses) for r in op.digest(docs).collect())
    assert out == sorted([("1", 0, 0, ""), ("2", 0, 0, ""), ("3", 4, 1, "MIT"), ("3", 4, 1, "MIT"), ("None", 1, 1, "MIT"), ("5", 5, 2, "CC-BY-NC-4.0,MIT"), ("6", 0, 0, "")])
    assert op.scan(docs.filter("false")).count() == 0


def plain(text):
    """Licences without any shortcut: every run of lines from every place against every pattern, the longest first."""
    text = text or ""
    atoms = [(m.start(), m.end()) for m in op._ATOM.finditer(text) if m.end() > m.start()]
    patterns = [(n, re.compile(p, re.S)) for n, p in op.SENTENCES]
    chain = re.compile(rf"{op._VERB}(?: the terms of)?(?: either(?: of)?)?((?: (?:and )?(?:(?:or|and) )?(?:under )?(?:the terms of )?(?:{'|'.join(f'(?:{p})' for _, p in op._NAMES)}))+)")
    found, i = [], 0

    def last(i, ends):
        while i + 1 < len(atoms) and not re.search(ends, text[atoms[i][1] : atoms[i + 1][0]]):
            i += 1
        return i

    while i < len(atoms):
        start, tag = atoms[i][0], op._identifier(text, atoms[i][0])
        if tag:
            found.append((f"spdx {tag[0]}", start, tag[1]))
            i = next((j for j in range(i, len(atoms)) if atoms[j][0] >= tag[1]), len(atoms))
            continue
        near, far = last(i, r"[.!?;:]|\n\n"), last(i, r"[.!?]")
        for j in range(far, i - 1, -1):
            sentence = op.normalised(text[start : atoms[j][1]])
            name = next((n for n, p in patterns if (j <= near or n in op._RUN_ON) and p.fullmatch(sentence)), None)
            if name and op.normalised(text[start : atoms[i][1]]):
                found.append((name, start, atoms[j][1]))
                i = j
                break
        else:
            first = text[start : atoms[i][1]]
            for m in re.finditer(op._VERB.replace(" ", "[^0-9a-z]+"), text[start : atoms[near][1]].lower()):
                if m.start() < len(first):
                    ends = [j for j in range(i, near + 1) if chain.fullmatch(op.normalised(text[start + m.start() : atoms[j][1]]))]
                    if ends:
                        found.append(("statement", start + m.start(), atoms[ends[0]][1]))
                        i = ends[0]
                        break
        i += 1
    return found


def test_documents_match_a_plain_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    mixed = [MIT, *LINES, "See: the software; is " * 30, "Copyright 2020 The Authors. All rights reserved.", "SPDX-License-Identifier: MIT OR Apache-2.0\nx"]
    made = [(10_000 + i, "\n".join([a, b]) + (" end." if i % 2 else "")) for i, (a, b) in enumerate((a, b) for a in mixed for b in mixed)]
    docs = docs.unionByName(spark.createDataFrame(made, docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: (r.n_sentences, [tuple(x) for x in r.licenses]) for r in op.scan(docs).collect()}
    assert out.keys() == texts.keys() and sum(bool(x) for _, x in out.values()) > 100
    for d, t in texts.items():
        mine, want = op.sentences(t), plain(t)
        assert [x if x[0] != "statement" else (mine[k][0], *x[1:]) for k, x in enumerate(want)] == mine, d
        # rules: the first whose sequence stands at a place
        rows, i, names = [], 0, [x[0] for x in op._known(t)]
        places = [x for x in op._known(t)]
        while i < len(names):
            fits = [(n, q) for n, q in op.RULES if names[i : i + len(q)] == list(q)]
            name, k = (None, 1) if names[i] is None else (names[i][5:], 1) if names[i].startswith("spdx ") else (fits[0][0], len(fits[0][1])) if fits else (op.UNKNOWN, 1)
            if name:
                rows.append((name, places[i][1], places[i + k - 1][2]))
            i += k
        assert out[d] == (len(mine), rows), d
