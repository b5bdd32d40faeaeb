"""Licences by their canonical notices."""

import pytest

from tarnwright.llm import license_scan

GNU = """{work} is free software{a} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{b} either version {version} of the License, or
(at your option) any later version.

{work} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with {work}.  If not, see <https://www.gnu.org/licenses/>.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def gnu(kind, version, work="This program"):
    a, b = (":", ",") if version == "3" else (";", ";")
    return GNU.format(work=work, kind=kind, version=version, a=a, b=b)


def commented(text):
    return "/*\n" + "".join(f" * {line}".rstrip() + "\n" for line in text.splitlines()) + " */\n"


def found(text):
    return [name for name, _, _ in license_scan.licenses(license_scan.sentences(text))]


@pytest.mark.parametrize("form", [str, commented])
def test_canonical_notices(form):
    assert found(form(gnu("", "3"))) == ["GPL-3.0-or-later"]
    assert found(form(gnu("", "2"))) == ["GPL-2.0-or-later"]
    assert found(form(gnu("", "3", "GNU Emacs"))) == ["GPL-3.0-or-later"]
    assert found(form(APACHE)) == ["Apache-2.0"]
    names = [x[0] for x in license_scan.sentences(form(APACHE))]
    assert names == ["apache-terms", "apache-compliance", "apache-copy", "apache-as-is", "apache-see"]
    assert len(license_scan.sentences(form(gnu("", "3")))) == 4


def test_spdx_tags_give_the_identifier():
    assert found("// SPDX-License-Identifier: MIT\nint x;\n") == ["MIT"]
    assert found("/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */") == ["GPL-2.0-or-later WITH Classpath-exception-2.0"]
    assert found("# SPDX-License-Identifier: (mit OR Apache-2.0). More.") == ["(MIT OR Apache-2.0)"]
    assert found("SPDX-License-Identifier: the tag that names a licence") == []


@pytest.mark.parametrize("form", [str, commented])
def test_all_rights_reserved_and_other_gnu_licences(spark, form):
    assert found(form(gnu("Lesser ", "2.1", "This library"))) == ["LGPL-2.1-or-later"]
    assert found(form(gnu("Lesser ", "3"))) == ["LGPL-3.0-or-later"]
    assert found(form(gnu("Affero ", "3"))) == ["AGPL-3.0-or-later"]
    assert found("Licensed under the GNU Affero General Public License v3.0.") == ["AGPL-3.0"]
    assert found("Released under the LGPL v2.1 or later.") == ["LGPL-2.1-or-later"]
    texts = ["Words.\nAll rights reserved.", "Copyright (c) 2020 Some Body\nAll rights reserved.", "(c) 2020-2024 A, all rights reserved", "All rights\nreserved", "No such line. Rights."]
    docs = spark.createDataFrame([(i, form(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in license_scan.digest(docs).collect()} == {i: "All-Rights-Reserved" if i < 4 else "" for i in range(5)}
    assert found("Copyright 2020 A\nLicensed under the MIT License.\nAll rights reserved.") == ["MIT", "All-Rights-Reserved"]
