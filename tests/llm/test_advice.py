import numpy as np
import pytest

pytest.importorskip("gridlore.llm")
from gridlore.llm import jaccard, licenses, packing, secrets  # noqa: E402

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
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
""" + APACHE.split("Version 2.0 ", 1)[1]
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ECL = APACHE.replace("Apache License", "Educational Community License").replace("www.apache.org/licenses/LICENSE-2.0", "opensource.org/licenses/ECL-2.0")


def marked(text, mark):
    return "".join(f"{mark} {line}".rstrip() + "\n" for line in text.splitlines())


def test_verbatim_notices_have_their_licences(spark):
    apache, mpl = "Apache-2.0", "MPL-2.0"
    cases = [(f(t), w) for t, w in ((APACHE, apache), (ASF, apache), (MPL, mpl), (ECL, "")) for f in (str, lambda t: marked(t, "#"), lambda t: marked(t, "//"), lambda t: f"/*\n{marked(t, ' *')} */\nint x;\n", lambda t: t.replace("\n", "\r\n"))]
    cases += [
        ("SPDX-License-Identifier: MIT\n#include <stdio.h>\nint x;", "MIT"), ("// SPDX-License-Identifier: MIT\n// Copyright A. Person", "MIT"), ("/* SPDX-License-Identifier: Apache-2.0 */ int x;", apache),
        ("<!-- SPDX-License-Identifier: GPL-3.0-or-later -->\r\n<p>", "GPL-3.0"), ("# SPDX-License-Identifier: BSD-3-Clause\nimport os", "BSD-3-Clause"), ("# SPDX-License-Identifier: MIT-0\nimport os", ""),
        ("# SPDX-License-Identifier: Apache-2.0 OR MIT\nimport os", "Apache-2.0,MIT"), ("// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\nx", apache),
        ("Released under the MIT License, see LICENSE for it.", "MIT"), ("Licensed under the GNU General Public License, version 3, by us.", "GPL-3.0-only"), ("Licensed under the GNU General Public License, version 3 or later.", "GPL-3.0-or-later"),
        ("Licensed under CC BY-NC 4.0 unless noted.", "CC-BY-NC-4.0"), ("The files are subject to the terms of the Mozilla Public License, version 2.0 and no other.", mpl),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")).collect()}
    assert [(t, got[k].licenses) for k, (t, _) in enumerate(cases)] == cases
    assert got[0].sentences == "apache2,apache2_comply,apache2_copy,apache2_asis,apache2_limits" and got[0].n_open == 0


def test_the_cost_decides_after_a_separator_and_in_quotes():
    for text, value in (
        ('pwd = "kqzvbnwplsxjhtrd"', "kqzvbnwplsxjhtrd"), ("login: XkqTzVbnWpLsRm", "XkqTzVbnWpLsRm"), ("pin: 8394617502836471", "8394617502836471"), ('passphrase = "zq8 vk2 xw9 tn4 pl7"', "zq8 vk2 xw9 tn4 pl7"),
        ("auth=KQZVBNWPLSXJHTRD", "KQZVBNWPLSXJHTRD"), ('the passcode is "kqzvbnwplsxjhtrd"', "kqzvbnwplsxjhtrd"), ("private key: zvkqxjwpgh,", "zvkqxjwpgh"), ("the pin was 8394-6175-0283", "8394-6175-0283"),
    ):
        at = text.index(value)
        assert [x[:3] for x in secrets.find(text)] == [(at, 3, at + len(value))], text
        assert secrets.redacted(text) == text.replace(value, "[GUESS]")
    for text in ("login: information", "auth: international", "Pin: government, then", 'pwd = "password"', "pin: 123456", "pin: 11111111111111", "the secret is straightforwardness", "the login was qwertzuiopmnbvc", "credentials: available.", "Credentials: understanding", "pin = 20200131"):
        assert secrets.find(text) == [], text


def test_prose_words_are_cheap():
    rank, longest = secrets.words()
    assert len(rank) > 10_000 and longest <= 24 and rank["password"] == 1
    assert all(secrets.guess_cost(w)[0] < 6 for w in ("information", "international", "government", "Development"))


def test_texts_of_one_id_go_their_own_ways(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, b + " more"), (5, c), (5, c), (6, None), (6, a + " end"), (None, b)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, count string").repartition(3)
    got = sorted(((r.doc_id or 0), r.class_id, r.n_links, r.copies) for r in jaccard.join(docs).collect())
    assert got == [(0, 1, 2, 2), (1, 1, 2, 2), (1, 1, 2, 2), (2, 1, 2, 2), (3, 1, 2, 2), (4, 1, 2, 1), (5, 5, 1, 2), (5, 5, 1, 2), (6, 1, 2, 1), (6, 6, 0, 1)]
    kept = sorted(((r.doc_id or 0), r.text or "") for r in jaccard.deduplicate(docs).collect())
    assert kept == [(0, b), (1, a), (1, b), (5, c), (6, "")]


def test_lengths_that_never_fill_a_sequence_are_fitted(monkeypatch):
    fitted, best_fit = [], packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda hist: fitted.append(int(hist.sum())) or best_fit(hist))
    for lengths in ({300: 9000}, {300: 5000, 410: 4000, 610: 3000}, {3 * k: 40 + k for k in range(60, 300)}, {10: 5000}, {512: 1000, 300: 900}):
        hist = np.zeros(1025, np.int64)
        for n, c in lengths.items():
            hist[n] = c
        fitted.clear()
        groups, back = packing.plan(hist), np.zeros_like(hist)
        assert all(sum(g) <= 1024 for g, _ in groups)
        for g, c in groups:
            for n in g:
                back[n] += c
        assert (back == hist).all()
        assert sum(c for _, c in groups) <= sum(c for _, c in best_fit(hist))
        if 10 not in lengths:
            assert min(fitted) < 0.5 * hist.sum(), (lengths, fitted)
