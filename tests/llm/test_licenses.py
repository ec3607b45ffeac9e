"""License scans: headers, licence files and inheritance."""

import re
import zlib

import numpy as np

from rivulet.llm.licenses import CELLS, TEMPLATES, Matcher, Templates, scan_licenses, word_frequency

SCHEMA = "doc_id long, path string, text string, license string, holder int"


def test_headers():
    m = Matcher(np.zeros(len(Templates().vocabulary)), 100, 0.7)
    assert m.match("some words\nLicensed under CC BY-NC 4.0.")[0] == "CC-BY-NC-4.0"
    assert m.match("Licensed under CC BY 4.0")[0] == "CC-BY-4.0"
    assert m.match("This work is licensed under the GNU General Public License, version 3.")[:2] == ("GPL-3.0", 1.0) or m.match("This work is licensed under the GNU General Public License, version 3.")[1] > 0.999
    assert m.match("x y z. " * 100 + "Released under the MIT License.")[0] == "MIT"
    assert m.match("the terms of this work are under discussion and rights are not")[0] is None
    assert m.match("") == (None, 0.0, 0.0)


def test_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", "x " * 50 + "\n" + mit), (2, "a/b/c/file.py", "code"), (3, "a/b/COPYING.txt", gpl), (4, "z/file.py", "code"), (5, "a/other.py", "words\nAll rights reserved."),
        (6, None, "code"), (7, None, gpl), (8, "a/b/c/file.py", None), (8, "a/b/c/file.py", None), (None, "a/n.py", ""), (9, "a/d/x.py", "long " * 20_000), (10, "ab/x.py", "code"),
    ]
    files = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA)
    got = {}
    for r in scan_licenses(files).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.scope, r.license_path))
    assert got[1] == [("MIT", "own", "a/LICENSE")] and got[2] == [("GPL-3.0", "inherited", "a/b/COPYING.txt")] and got[3] == [("GPL-3.0", "own", "a/b/COPYING.txt")]
    assert got[4] == [(None, "none", None)] and got[5] == [("Proprietary", "own", "a/other.py")] and got[6] == [(None, "none", None)] and got[7] == [("GPL-3.0", "own", None)]
    assert got[8] == 2 * [("GPL-3.0", "inherited", "a/b/COPYING.txt")] and got[None] == [("MIT", "inherited", "a/LICENSE")] and got[9] == [("MIT", "inherited", "a/LICENSE")] and got[10] == [(None, "none", None)]
    assert scan_licenses(files.limit(0)).count() == 0


GPL3 = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""


def test_wrapped_notices_and_full_texts():
    from rivulet.llm.licenses import TEXTS

    m = Matcher(np.zeros(len(Templates().vocabulary)), 100, 0.7)
    assert m.match("#!/bin/sh\n#\n" + GPL3 + "\necho done\n")[0] == "GPL-3.0"
    assert m.match(GPL3.replace("version 3", "version 2"))[0] == "GPL-2.0"
    assert m.match("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007")[0] == "GPL-3.0"
    assert m.match("GNU General Public License")[0] in (None, "GPL")
    apache = "/*\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in\n * compliance with the License.\n */\nint x;"
    assert m.match(apache)[0] == "Apache-2.0"
    assert m.match(" " * 20 + "Apache License\n" + " " * 10 + "Version 2.0, January 2004")[0] == "Apache-2.0"
    for p in TEXTS.glob("*.txt"):
        name, score, share = m.match("Copyright 2020 Some Body\n\n" + p.read_text())
        assert name == p.stem and score > 0.95 and share == 1.0


def test_full_text_holds_for_what_is_below(spark):
    from rivulet.llm.licenses import TEXTS

    files = spark.createDataFrame([(1, "r/TERMS", (TEXTS / "MPL-2.0.txt").read_text()), (2, "r/a/x.py", "code"), (3, "s/x.py", "code")], "doc_id long, path string, text string")
    assert {r.doc_id: (r.license, r.scope) for r in scan_licenses(files).collect()} == {1: ("MPL-2.0", "own"), 2: ("MPL-2.0", "inherited"), 3: (None, "none")}


BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice in the documentation.
"""
HEADERS = {
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.": "LGPL-2.1",
    GPL3.replace("GNU General", "GNU Affero General"): "AGPL-3.0",
    "Licensed under the BSD License.": "BSD", BSD2: "BSD-2-Clause", BSD2 + "3. Neither the name of the holder may be used.": "BSD-3-Clause",
    "Released under the ISC License.": "ISC", "This code is under the Mozilla Public License, version 2.0": "MPL-2.0",
    "// This program and the accompanying materials are made\n// available under the terms of the Eclipse Public License 2.0\n// which is available at https://www.eclipse.org/legal/epl-2.0/": "EPL-2.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 License.": "CC-BY-NC-SA-3.0",
    GPL3.replace("program is free software:", "program is free software;").replace("version 3", "version 2"): "GPL-2.0",
    "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later", "x = 1 /* SPDX-License-Identifier: mit */": "MIT",
    "the author has waived all copyrights and related rights to this work.": "CC0-1.0", "Redistribution and uses in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSD",
    "This work is licensed under a Creative Commons Attributions 4.0 International License.": "CC-BY-4.0", "Licensed under the GNU General Publics License, version 3.": "GPL-3.0",
    "Licensed under the Mozilla Public License, Version 1.1.": "MPL-1.1", "Licensed under the Mozilla Public License.": "MPL",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "MIT OR Apache-2.0", "# SPDX-License-Identifier: (MIT OR Apache-2.0)": "MIT OR Apache-2.0", "SPDX-License-Identifier: MIT AND (ISC or BSD-2-Clause) */": "MIT AND (ISC OR BSD-2-Clause)",
    "SPDX-License-Identifier: GPL-2.0-only WITH classpath-exception-2.0.": "GPL-2.0-only WITH classpath-exception-2.0", "SPDX-License-Identifier: (MIT": None, "SPDX-License-Identifier:": None,
    "This file is not licensed under the MIT License.": None, "This code is no longer\nreleased under the MIT License.": None, "You may not copy it.\n\nReleased under the MIT License.": "MIT",
    "The licence of a driver is released under conditions.": None, "A public general assembly met under the terms of the foundation.": None,
}


def test_families_are_told_apart():
    m = Matcher(np.zeros(len(Templates().vocabulary)), 1000, 0.7)
    assert {h: m.match(h)[0] for h in HEADERS} == HEADERS
    long = " ".join(["Some sentence about rivers."] * 40)
    assert m.match(f"{long} Licensed under the ISC License. {long}")[0] == "ISC"  # whatever the line's length


def plainly(m, text):
    """The best header by trying every run of lines, without bounds or phrases to look for first."""
    from rivulet.llm import licenses as li

    lines = list(li.headers(text))
    best, best_score = None, 0.0
    for line, _ in lines:
        found = m.expression(li.SPDX.search(line)[1]) if li.SPDX_MARK in line else None
        best, best_score = (best or found, 1.0) if found else (best, best_score)
    for start in range(len(lines)):
        for k in range(1, li.RUN + 1):
            run = lines[start : start + k]
            if len(run) < k or any(end for _, end in run[:-1]):
                break
            header = " ".join(line for line, _ in run)
            before = lines[start - 1][0] + " " if start and not lines[start - 1][1] else ""
            if any(x.end() > len(before) for x in li.DENIED.finditer(before + header)):
                continue
            cosines = m.cosines(li.WORD.findall(header), m.rows)
            fit = [(-c, i) for i, c in enumerate(cosines) if c >= m.threshold and m.t.deciding[i].search(header)]
            if fit and -min(fit)[0] > best_score + 1e-9:
                c, i = min(fit)
                best, best_score = li.named(m.t.names[i], header, [line for line, _ in lines[start + k : start + k + 25]]), -c
    return best, best_score


def changed(text):
    """The text with other endings of words, other breaks of lines, and words around it."""
    words = text.split()
    yield text
    for i in range(0, len(words), 3):
        yield " ".join([*words[:i], words[i].rstrip(".") + "s", *words[i + 1 :]])
        yield "some words before\n" + " ".join(words[:i]) + "\n * " + " ".join(words[i:])


def test_scan_equals_brute_force():
    """Every template with changed endings and breaks: the scan finds what a plain search of all runs finds."""
    m = Matcher(np.zeros(len(Templates().vocabulary)), 100, 0.7)
    found = 0
    for _, template in TEMPLATES:
        for text in changed(template):
            license, score, _ = m.match(text)
            want, want_score = plainly(m, text)
            assert abs(score - want_score) < 1e-6 and (license == want or want_score and abs(want_score - score) < 1e-6 and license is not None), text
            found += license is not None
    assert found > 300


def test_cosines_equal_brute_force():
    """Sparse cosines against dense vectors of all words, weighted by document frequency."""
    t = Templates()
    frequency = np.random.default_rng(0).integers(0, 50, len(t.vocabulary)).astype(float)
    words = "licensed under the apache license version 2 0 by unheard ofwords unheard".split()
    outside = {"unheard", "ofwords"}
    every = sorted(set(t.vocabulary) | outside)
    cells = np.random.default_rng(1).integers(0, 50, CELLS).astype(float)
    m = Matcher(np.r_[frequency, cells], 60, 0.7)
    idf = {w: np.log(61 / ((frequency[t.vocabulary[w]] if w in t.vocabulary else cells[zlib.crc32(w.encode()) % CELLS]) + 1)) + 1 for w in every}
    dense = lambda ws: np.array([ws.count(w) * idf[w] for w in every])
    a = dense(words)
    want = [float(a @ (b := dense(re.findall("[a-z0-9]+", text.lower())))) / np.linalg.norm(a) / np.linalg.norm(b) for _, text in TEMPLATES]
    assert np.allclose(m.cosines(words, m.rows), want)


def test_headers_alone_pass_nothing_on(spark):
    """A file that is no licence file gives its licence to no other, however little else it holds."""
    files = spark.createDataFrame([(1, "r/notes.txt", "Released under the MIT License."), (2, "r/a.txt", "code")], "doc_id long, path string, text string")
    assert {r.doc_id: (r.license, r.scope) for r in scan_licenses(files).collect()} == {1: ("MIT", "own"), 2: (None, "none")}


def test_frequencies_of_the_collection(spark):
    """Files that hold a word, however often, and words of no template by their cells."""
    files = spark.createDataFrame([(t,) for t in ("License xyzzy xyzzy", "license plugh", "the", None, "xyzzy")], "text string").repartition(3)
    frequency, n = word_frequency(files)
    t = Templates()
    assert n == 5 and len(frequency) == len(t.vocabulary) + CELLS
    assert frequency[t.vocabulary["license"]] == 2 and frequency[t.vocabulary["the"]] == 1
    of = lambda w: frequency[len(t.vocabulary) + zlib.crc32(w.encode()) % CELLS]
    assert of("xyzzy") == 2 and of("plugh") == 1 and frequency[len(t.vocabulary) :].sum() == 3
