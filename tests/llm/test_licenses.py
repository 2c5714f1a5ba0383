import pytest

pytest.importorskip("gridlore.llm")
from gridlore.llm import licenses  # noqa: E402

GNU = """This {what} is free software; you can redistribute it and/or
modify it under the terms of the GNU {kind}General Public
License as published by the Free Software Foundation; either
version {v} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
{kind}General Public License for more details.
"""
ISC = """Copyright (c) 2020, A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
"""
ZERO = ISC.replace(""", provided that the above
copyright notice and this permission notice appear in all copies""", "")
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
CC0 = """To the extent possible under law, the author(s) have dedicated all
copyright and related and neighboring rights to this software to the public
domain worldwide. This software is distributed without any warranty.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
BOOST = """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at
https://www.boost.org/LICENSE_1_0.txt)
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.
{more}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software.
"""
NOTICES = [
    (GNU.format(what="program", kind="", v="2"), "GPL-2.0-or-later"), (GNU.format(what="program", kind="", v="3"), "GPL-3.0-or-later"), (GNU.format(what="library", kind="Lesser ", v="2.1"), "LGPL-2.1-or-later"),
    (GNU.format(what="library", kind="Lesser ", v="3"), "LGPL-3.0-or-later"), (GNU.format(what="program", kind="Affero ", v="3"), "AGPL-3.0-or-later"), (ISC, "ISC"), (ZERO, "0BSD"), (EPL, "EPL-2.0"), (CC0, "CC0-1.0"), ("To the extent possible under law, A. Person has waived all copyright and related or neighboring rights to This Work.", "CC0-1.0"), (UNLICENSE, "Unlicense"),
    (ZLIB, "Zlib"), (BOOST, "BSL-1.0"), (BSD.format(more=""), "BSD-2-Clause"), (BSD.format(more=ENDORSE), "BSD-3-Clause"), ("Licensed under the GNU General Public License, version 2 or (at your option) any later version.", "GPL-2.0-or-later"),
    ("Released under the GNU Lesser General Public License v2.1.", "LGPL-2.1-only"), ("Licensed under CC0 1.0 Universal.", "CC0-1.0"), *((f"# SPDX-License-Identifier: {x}\nimport os", x) for x in ("ISC", "MPL-2.0", "EPL-2.0", "Unlicense", "Zlib", "0BSD", "BSD-2-Clause", "GPL-2.0-only")),
    ("# SPDX-License-Identifier: LGPL-2.1-or-later\nx", "LGPL-2.1"), ("SPDX-License-Identifier: CC0-1.0 */", "CC0-1.0"), ("Zlib is a library. The Unlicense is short. Permission is granted.", ""),
]


def test_headers_as_they_are_written(spark, tmp_path):
    """Plain, commented and with other line ends; the SQL agrees on each."""
    import duckdb

    marked = lambda t, mark: "".join(f"{mark} {line}".rstrip() + "\n" for line in t.splitlines())
    ways = [str, lambda t: marked(t, "#"), lambda t: marked(t, "//"), lambda t: "/*\n" + marked(t, " *") + " */\nint x;\n", lambda t: t.replace("\n", "\r\n")]
    texts = [(f(t), w) for t, w in NOTICES for f in (ways if "SPDX" not in t else ways[:1])]
    table = spark.createDataFrame([(k, t, "x") for k, (t, _) in enumerate(texts)] + [(None, texts[0][0], "x"), (3, None, "x"), (3, "", "x")], "doc_id long, text string, names string")
    got = [tuple(r) for r in licenses.scan(table).collect()]
    found = {r[0]: r for r in got if r[0] is not None and r[1] > 0}
    assert [(t, found[k][3] if k in found else "") for k, (t, _) in enumerate(texts)] == texts
    assert [r[3] for r in got if r[0] is None] == [NOTICES[0][1]] and sum(r[0] == 3 and r[1] == 0 for r in got) == 2
    table.toPandas().to_parquet(path := str(tmp_path / "d.parquet"))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(duckdb.sql(licenses.sql(f"'{path}'")).fetchall(), key=key) == sorted(got, key=key)
