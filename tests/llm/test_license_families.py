"""Members of license families aren't taken for each other, and long license texts are found by their pieces."""

import random

import pyarrow as pa

from tallyspark.llm import licenses

GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
CLAUSES = next(t for n, t in licenses.TEMPLATES if n == "BSD-2-Clause")
THIRD = " * Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def found(text, templates=licenses.TEMPLATES):
    known = licenses.Templates(templates)
    return [templates[r[1]][0] for r in known.scan(pa.array(["some words before " + text + " and some words behind"]))]


def test_families():
    for name, kind, version in (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3")):
        for subject in ("program", "library"):
            assert found(GPL.format(kind, version).replace("program", subject)) == [name]
    assert found(GPL.format("General Public License", "1")) == [] and found(GPL.format("Library General Public License", "2")) == []
    assert found(CLAUSES) == ["BSD-2-Clause"] and found(CLAUSES + THIRD) == ["BSD-3-Clause"]
    assert found(CLAUSES.replace("1. ", "* ").replace("2. ", "* ")) == ["BSD-2-Clause"]
    for name in ("MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause"):
        assert found(f"// SPDX-License-Identifier: {name}") == [name]


def test_long_texts():
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(1000))
    assert set(found(long, (*licenses.TEMPLATES, ("Long", long)))) == {"Long"} and found(long) == []
