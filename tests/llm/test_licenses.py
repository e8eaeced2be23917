"""License notices and their near misses, held against a plain comparison of wordings."""

from __future__ import annotations

import re
import time

import pytest

from sessionscope.llm import licenses
from sessionscope.llm.license_texts import TEMPLATES

HEADER = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License "
    "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
)
CLAUSE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
THIRD = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
FEE = "Permission to use, copy, modify, and{} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
TRUE = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "It is no toy. Released under the MIT License."),
    ("MIT", "RELEASED UNDER THE MIT LICENSE"),
    ("MIT", "Released\n# under the\n# MIT License."),
    ("MIT-grant", TEMPLATES["MIT-grant"].replace("documentation files", 'documentation files (the "Software")')),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "This code is licensed under the Apache License, version 2.0, see the file."),
    ("Apache-2.0-header", TEMPLATES["Apache-2.0-header"].replace("this file", "these files")),
    ("MPL-2.0", TEMPLATES["MPL-2.0"]),
    ("MPL-2.0", TEMPLATES["MPL-2.0"].replace("subject", "made subject")),
    ("ISC", FEE.format("/or")),
    ("ISC", FEE.format("")),
    ("BSD-2-Clause OR BSD-3-Clause", CLAUSE),
    ("BSD-3-Clause", THIRD.format("the copyright holder")),
    ("BSD-3-Clause", THIRD.format("Example Inc.")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "Text licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0-long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-long", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-plain", "This program is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-plain", "Licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-short", "licensed under the GNU GPL, version 3"),
    ("GPL-2.0-header", HEADER.format("General", "2")),
    ("GPL-3.0-header", HEADER.format("General", "3")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1-header", HEADER.format("Lesser General", "2.1")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-header", HEADER.format("Affero General", "3")),
    ("MIT-tag", "// SPDX-License-Identifier: MIT"),
    ("GPL-2.0-only-tag", "/* SPDX-License-Identifier: GPL-2.0-only */"),
    ("Apache-2.0-tag", "SPDX-License-Identifier:\tApache-2.0"),
]
MISSES = [
    "Released under the license.",
    "Not released under the MIT License.",
    "This was never released under the MIT License.",
    "It is no longer released under the MIT License.",
    "This isn’t released under the MIT License.",
    "Released under the modified MIT License.",
    "Released under the MIT-0 License.",
    "Released under the X11 License.",
    "Released under the ISC License.",
    "not licensed under the GNU GPL, version 3",
    "This work is not licensed under the GNU General Public License, version 3.",
    "This work is licensed under the GNU General Public License, version 9.",
    "This work is licensed under the GNU Library General Public License, version 2.",
    "This work is licensed under the GNU Lesser General Public License, version 2.",
    "This work is licensed under the GNU Affero General Public License, version 1.",
    "This work is licensed under the GNU Free Documentation License, version 3.",
    "This work is licensed under the General Public License, version 3.",
    HEADER.format("General", "1"),
    HEADER.format("Library General", "2"),
    "Licensed under the Apache License, Version 1.1.",
    "Licensed under the Academic Free License, Version 2.0.",
    "Licensed under CC BY 3.0.",
    "Licensed under CC BY-NC 2.0.",
    "Licensed under CC BZ 4.0.",
    "This work is licensed under a Creative Commons Attribution 3.0 International License.",
    "This work is licensed under a Creative Commons 4.0 International License.",
    TEMPLATES["MPL-2.0"].replace("2.0", "1.1"),
    TEMPLATES["MPL-2.0"].replace("Mozilla", "Common"),
    TEMPLATES["MPL-2.0"].replace("is subject", "is not subject"),
    "SPDX-License-Identifier: Zlib-acknowledgement",
    "SPDX-License-Identifier: MIT OR Apache-2.0",
    "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0",
    "SPDX-License-Identifier: GPL-1.0-only",
    "Redistribution of the heat and use of any source is permitted.",
    "Her driving license was not in force.",
]
BEFORE = "the weather turned while they crossed a narrow bridge and then"


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(TEMPLATES, licenses.Settings())


def confirmed(scanner, text):
    return [name for _, name, _, _, sure, _ in scanner.notices(text) if sure]


def plain_wordings(text):
    """Templates that stand in the text word for word, without those inside longer ones; knows no compression."""
    said = f" {' '.join(re.findall(r'[a-z0-9]+', text.lower()))} "
    found = {}
    for name, template in TEMPLATES.items():
        wording = f" {' '.join(re.findall(r'[a-z0-9]+', template.lower()))} "
        if wording in said:
            found[name] = wording
    return sorted(n for n, w in found.items() if not any(w != v and w.strip() in v for v in found.values()))


@pytest.mark.parametrize(("name", "text"), TRUE)
@pytest.mark.parametrize("before", ["", f"{BEFORE}.\n"])
def test_notices_are_confirmed(scanner, name, text, before):
    assert confirmed(scanner, f"{before}{text}") == [name]


@pytest.mark.parametrize("text", MISSES)
@pytest.mark.parametrize("before", ["", f"{BEFORE}.\n"])
def test_near_misses_are_not_confirmed(scanner, text, before):
    assert confirmed(scanner, f"{before}{text}") == []


def test_plain_wordings_agree(scanner):
    for name, template in TEMPLATES.items():
        assert plain_wordings(template) == [name] == confirmed(scanner, template)
    both = f"{CLAUSE} one and two. {THIRD.format('the copyright holder')} {BEFORE}. {TEMPLATES['MIT']}"
    assert sorted(confirmed(scanner, both)) == plain_wordings(both) == ["BSD-2-Clause OR BSD-3-Clause", "BSD-3-Clause", "MIT"]


def test_tables_agree_with_plain_wordings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = sorted((r.doc_id, r.license) for r in licenses.scan_licenses(docs).where("confirmed").collect())
    expected = [(r.doc_id, name) for r in docs.collect() for name in plain_wordings(r.text or "")]
    assert sorted(set(found)) == sorted(expected) and found


def test_places_on_lines(spark):
    text = "a b\n\nx Released under the MIT License. - y Released under the MIT License.\nReleased under the MIT License."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = sorted((r.line, r.word) for r in licenses.scan_licenses(docs).collect())
    assert found == [(2, 1), (2, 8), (3, 0)]


def test_long_line_takes_linear_time(scanner):
    def seconds(n):
        start = time.perf_counter()
        assert len(scanner.notices("Released under the MIT License. and so on " * n)) == n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(2000) < 16 * seconds(400) + 0.5
