"""License scans: sparse TF-IDF cosine of headers to templates, and inheritance from the nearest ancestor directory.

A file's headers are its sentences and lines, without the marks of comments, and runs of
up to RUN consecutive ones; a blank line ends a run. Words
are weighted by their document frequency over all files, counted in a first scan: word by
word for those of the templates, by CELLS hashed cells for all others (a word that shares its cell
counts as more frequent, never as rarer). A header matches the template of the highest cosine of at least
`threshold` of whose deciding phrases it holds one (of equal ones the first in the list). Of the GNU, Creative Commons, BSD,
Mozilla, Eclipse and Apache licences it's the one, and the version, that the header or what follows it names
("GPL" without a version). A header that says that something isn't licensed so doesn't count. A line with an SPDX
identifier, or an expression of several with AND, OR, WITH and parentheses, names its licence itself. The whole file is compared to full licence texts,
too, and matches from FULL_TEXT on. The file's own licence is the full text that it
matches, or else its best header. A file with a licence is a licence file if its
name says so (LICENSE, LICENCE, COPYING) or if it matches a full text;
its licence holds for its directory and all below. A file without a licence of its own
takes that of the nearest ancestor directory that has one; of several licence files of
a directory the first by path counts.

Paths are joined directory by directory: each file gives a row for each ancestor, so rows
grow with the depth of paths only, and a directory has one licence row, however many
files it holds.

Null texts are empty and match nothing; null paths stand alone and inherit nothing.
Repeated rows are treated alike; extra columns are ignored; an empty table gives an
empty table. Texts are scanned whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, slices

# Licences and the headers that name them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0"),
    ("Proprietary", "All rights reserved."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Phrases of which a header must hold one to be of a licence; =x is x as whole words.
DECIDING = {
    "MIT": ("=mit", "permission is hereby granted"), "Apache-2.0": ("=apache",), "GPL-2.0": ("general public",), "GPL-3.0": ("general public",),
    "LGPL-2.1": ("lesser general public", "library general public"), "AGPL-3.0": ("affero general public",), "BSD-3-Clause": ("=bsd", "redistribution and use"), "ISC": ("=isc", "permission to use, copy"),
    "MPL-2.0": ("=mozilla", "=mpl"), "EPL-2.0": ("=eclipse", "=epl"), "CC-BY-4.0": ("=cc by", "=cc-by", "creative commons attribution"), "CC-BY-SA-4.0": ("=cc by", "=cc-by", "creative commons attribution"),
    "CC-BY-NC-4.0": ("=cc by", "=cc-by", "creative commons attribution"), "CC0-1.0": ("=cc0", "waived all copyright"), "Proprietary": ("all rights reserved",), "Unlicense": ("public domain",),
}
SPDX_MARK = "spdx-license-identifier:"
#: A text without any of these can match no header: they are all the deciding phrases, and the mark of an identifier.
PHRASES = sorted({p.lstrip("=") for phrases in DECIDING.values() for p in phrases} | {SPDX_MARK})
DENIED = re.compile(r"\b(?:not|never|no longer|isn't|aren't|wasn't)\s+(?:be\s+|being\s+)?(?:licensed|released|distributed|covered|available|governed)\b")
SPDX_NAMES = ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "MPL-2.0", "0BSD", "Zlib")
SPDX = re.compile(re.escape(SPDX_MARK) + r"\s*(.*)")
SPDX_PART = re.compile(r"\s*([()]|[a-z0-9][a-z0-9.+-]*)")
#: Full texts, a file for each licence; read on the driver only.
TEXTS = Path(__file__).resolve().parent / "license_texts"
RUN, BLOCK, FULL_TEXT, CELLS = 12, 2048, 0.9, 1 << 18
#: Directories of up to so many licence files are broadcast to the ancestors of the others.
MOST_HOLDERS = 20_000
COMMENT = re.compile(r"^(?:[^a-z0-9(\"]|(?:rem|dnl)\s)+")
GNU_VERSION = re.compile(r"\bv(?:ersion)?[ .]*([123](?:\.1)?)")
SENTENCE_END = re.compile(r"(?<=[.!?]) +")
WORD = re.compile(r"[a-z0-9]+")
LICENCE_NAME = r"(?i)(^|/)(licen[sc]e|copying)([._-][^/]*)?$"


class Templates:
    """The templates and the full texts as rows of small dense matrices; the templates' own words come first."""

    def __init__(self):
        words = [WORD.findall(t.lower()) for _, t in TEMPLATES]
        texts = {p.stem: WORD.findall(p.read_text().lower()) for p in sorted(TEXTS.glob("*.txt"))}
        self.names, self.text_names = [name for name, _ in TEMPLATES], list(texts)
        own = sorted({w for ws in words for w in ws})
        more = sorted({w for ws in texts.values() for w in ws} - set(own))
        self.vocabulary, self.own = {w: i for i, w in enumerate(own + more)}, len(own)
        as_pattern = lambda p: rf"\b{re.escape(p[1:])}\b" if p[0] == "=" else re.escape(p)
        self.deciding = [re.compile("|".join(map(as_pattern, DECIDING[name]))) for name in self.names]
        self.identifiers = {x.lower(): x for x in [*self.names, *self.text_names, *SPDX_NAMES]}
        self.counts, self.text_counts = self.matrix(words)[:, : self.own], self.matrix(list(texts.values()))

    def matrix(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.vocabulary)))
        for row, words in enumerate(rows):
            for w in words:
                out[row, self.vocabulary[w]] += 1
        return out


def cell(word: str) -> int:
    return zlib.crc32(word.encode()) % CELLS


class Matcher:
    """Cosines of headers to the templates; frequency: number of files that hold each word of the vocabulary, and then of each cell."""

    def __init__(self, frequency: np.ndarray, files: int, threshold: float):
        self.t, self.threshold = Templates(), threshold
        n = len(self.t.vocabulary)
        frequency = np.r_[frequency, np.zeros(max(0, n + CELLS - len(frequency)))]
        idf = np.log((files + 1) / (np.minimum(frequency, files) + 1)) + 1
        self.idf, self.squares = idf[:n], (idf**2).tolist()
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        self.rows, self.texts = unit(self.t.counts * self.idf[: self.t.own]), unit(self.t.text_counts * self.idf)

    def cosines(self, words: list[str], rows: np.ndarray) -> np.ndarray:
        """Cosines of a bag of words to the rows, whose columns are the first words of the vocabulary."""
        ids, tf, outside = [], [], 0.0
        for w, n in Counter(words).items():
            i = self.t.vocabulary.get(w)
            if i is None or i >= rows.shape[1]:
                outside += n * n * self.squares[len(self.idf) + cell(w) if i is None else i]
            else:
                ids.append(i)
                tf.append(n)
        weighted = np.array(tf) * self.idf[ids]
        norm = np.sqrt((weighted**2).sum() + outside)
        return rows[:, ids] @ weighted / norm if ids else np.zeros(len(rows))

    def match(self, text: str) -> tuple[str | None, float, float]:
        """Licence and cosine of the full text or the best header, and the share of the text's words in matches."""
        return self.judged(text)[:3]

    def judged(self, text: str) -> tuple[str | None, float, float, bool]:
        """As match, and whether the text matches a full licence text."""
        lines = list(headers(text))
        words = [WORD.findall(line) for line, _ in lines]
        total = sum(map(len, words))
        if not total:
            return None, 0.0, 0.0, False
        flat = [w for ws in words for w in ws]
        full = self.cosines(flat, self.texts)
        if full.max() >= FULL_TEXT:
            return full_text_named(self.t.text_names[int(full.argmax())], lines), float(full.max()), 1.0, True
        # A header is a part of this, so a phrase that isn't in it is in no header.
        whole = " ".join(line for line, _ in lines)
        if not any(p in whole for p in PHRASES):
            return None, 0.0, 0.0, False
        best, best_score, matched = None, 0.0, set()
        for i, (line, _) in enumerate(lines):
            if SPDX_MARK in line and (found := self.expression(SPDX.search(line)[1])):
                best, best_score = best or found, 1.0
                matched.add(i)
        for start, k in self.candidates(words, [ends for _, ends in lines]):
            cosines = self.cosines([w for ws in words[start : start + k] for w in ws], self.rows)
            header = " ".join(line for line, _ in lines[start : start + k])
            before = lines[start - 1][0] + " " if start and not lines[start - 1][1] else ""
            if any(m.end() > len(before) for m in DENIED.finditer(before + header)):
                continue
            for top in np.argsort(-cosines, kind="stable").tolist():
                if cosines[top] < self.threshold:
                    break
                if self.t.deciding[top].search(header):
                    matched.update(range(start, start + k))
                    if cosines[top] > best_score:
                        best_score = float(cosines[top])
                        best = named(self.t.names[top], header, [line for line, _ in lines[start + k : start + k + 25]])
                    break
        return best, best_score, sum(len(words[i]) for i in matched) / total, False

    def expression(self, text: str) -> str | None:
        """A licence expression at the start of the text: identifiers joined by AND, OR and WITH, with parentheses; None if there is none."""
        parts, depth, at, operand = [], 0, 0, True
        good = 0, 0  # parts and place up to which the expression is whole
        while found := SPDX_PART.match(text, at):
            token = found[1]
            if token == "(" and operand:
                depth += 1
            elif token == ")" and not operand and depth:
                depth -= 1
            elif token in ("and", "or", "with") and not operand:
                operand = True
            elif operand and token not in ("(", ")", "and", "or", "with"):
                operand = False
            else:
                break
            parts.append(token.upper() if token in ("and", "or", "with") else self.t.identifiers.get(token.rstrip("."), token.rstrip(".")))
            at = found.end()
            if not operand and not depth:
                good = len(parts), at
        parts = parts[: good[0]]
        if len(parts) > 2 and parts[0] == "(" and parts[-1] == ")" and "(" not in parts[1:-1]:
            parts = parts[1:-1]
        return " ".join(parts).replace("( ", "(").replace(" )", ")") or None

    def candidates(self, words: list[list[str]], ends: list[bool]) -> Iterator[tuple[int, int]]:
        """(first line, number of lines) of the runs that may reach the threshold, by a bound.

        Products with the templates add up over the lines of a run, and its length is at least the root of the lines' squares.
        """
        own, vocabulary, all_squares, n = self.t.own, self.t.vocabulary, self.squares, len(self.idf)
        last = len(words)
        # A run may not go beyond the next end of a paragraph.
        limit = np.zeros(last, np.int64)
        stop = last
        for i in range(last - 1, -1, -1):
            stop = i + 1 if ends[i] else stop
            limit[i] = stop
        for first in range(0, last, BLOCK):
            block = words[first : first + BLOCK + RUN - 1]
            hits, outside = [], np.zeros(len(block))
            for row, ws in enumerate(block):
                found, rest = [], 0.0
                for w in ws:
                    j = vocabulary.get(w)
                    if j is not None and j < own:
                        found.append(j)
                    else:
                        rest += all_squares[n + cell(w) if j is None else j]
                hits.append(found)
                outside[row] = rest
            sizes = np.array([len(h) for h in hits])
            flat = np.repeat(np.arange(len(block)) * own, sizes) + np.array([j for h in hits for j in h], np.int64)
            x = np.bincount(flat, minlength=len(block) * own).reshape(len(block), own) * self.idf[:own]
            squares = (x**2).sum(axis=1) + outside
            dots = np.vstack([np.zeros(len(self.rows)), np.cumsum(x @ self.rows.T, axis=0)])
            lengths = np.concatenate([[0.0], np.cumsum(squares)])
            starts = np.arange(min(BLOCK, len(block)))
            for k in range(1, RUN + 1):
                s = starts[(starts + k <= len(block))]
                s = s[(first + s + k <= limit[first + s]) & (sizes[s] > 0) & (sizes[s + k - 1] > 0)]
                if not len(s):
                    continue
                most = (dots[s + k] - dots[s]).max(axis=1)
                for i in s[most + 1e-6 >= self.threshold * np.sqrt(lengths[s + k] - lengths[s])].tolist():
                    yield first + i, k


def named(template: str, header: str, after: list[str]) -> str:
    """The template's licence; of the GNU, Creative Commons and BSD licences the one and the version that the header, or what follows it, names."""
    if template.startswith("BSD"):
        rest = header + " " + " ".join(after)
        return "BSD-3-Clause" if "neither the name" in rest else "BSD-2-Clause" if "in the documentation" in rest else "BSD"
    if template.startswith("CC-BY"):
        parts = [part for part, pattern in (("NC", r"\bnc\b|noncommercial"), ("ND", r"\bnd\b|noderiv"), ("SA", r"\bsa\b|sharealike")) if re.search(pattern, header)]
        version = re.search(r"\b([1-4]\.\d)\b", header)
        return "-".join(["CC-BY", *parts, *([version[1]] if version else [])])
    if template.startswith(("MPL", "EPL", "Apache")):
        family = template.partition("-")[0]
        version = re.search(r"(?:\bv(?:ersion)?[ .]*|-v?|license,? )([12]\.[01])\b", header) or re.search(r"\bv(?:ersion)?[ .]*([12]\.[01])\b", " ".join(after[:2]))
        return f"{family}-{version[1]}" if version else family
    if not template.startswith(("GPL", "LGPL", "AGPL")):
        return template
    family = "LGPL" if re.search(r"\b(lesser|library) general", header) else "AGPL" if "affero" in header else "GPL"
    version = GNU_VERSION.search(header) or GNU_VERSION.search(" ".join(after[:2]))
    if not version:
        return family
    return f"{family}-{version[1]}" if "." in version[1] else f"{family}-{version[1]}.0"


def full_text_named(text_name: str, lines: list[tuple[str, bool]]) -> str:
    """The licence of a whole file alike to a full text; texts of one family differ in a title or a clause only."""
    title, whole = " ".join(line for line, _ in lines[:6]), " ".join(line for line, _ in lines)
    if text_name == "GPL-3.0" and "affero" in title:
        return "AGPL-3.0"
    if text_name.startswith("BSD"):
        return "BSD-3-Clause" if "neither the name" in whole else "BSD-2-Clause"
    return text_name


def headers(text: str) -> Iterator[tuple[str, bool]]:
    """Sentences of lines, without the marks of comments, and whether a run ends with them."""
    lines = [COMMENT.sub("", line) for line in text.lower().split("\n")]
    for line, after in zip(lines, [*lines[1:], ""], strict=True):
        sentences = [x for x in SENTENCE_END.split(line) if x]
        for k, sentence in enumerate(sentences, 1):
            yield sentence, k == len(sentences) and not after


def word_frequency(files: DataFrame) -> tuple[np.ndarray, int]:
    """Number of files that hold each word of the templates, then a word of each cell, and of all files: a fixed number of rows."""
    t = Templates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_words = len(t.vocabulary)
        frequency, n = np.zeros(n_words + CELLS + 1, np.int64), 0
        known = t.vocabulary.keys()
        for b in slices(batches, "text"):
            for text in b.column("text").to_pylist():
                n += 1
                words = set(WORD.findall((text or "").lower()))
                found = known & words
                frequency[[t.vocabulary[w] for w in found]] += 1
                # A file counts once for a cell.
                frequency[[n_words + c for c in {cell(w) for w in words - found}]] += 1
        frequency[-1] = n
        some = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(frequency[some])], ["word", "n"])

    rows = arrow_map(files.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(t.vocabulary) + CELLS + 1)
    out[rows.column("word").to_numpy()] = rows.column("n").to_numpy()
    return out[:-1], int(out[-1])


def own_licenses(files: DataFrame, threshold: float) -> DataFrame:
    """key, path, own licence, its cosine, whether the file is a licence file: by its name, or as all of it matches a full text."""
    shared = files.sparkSession.sparkContext.broadcast(Matcher(*word_frequency(files), threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            license, score, _, whole = zip(*(shared.value.judged(t or "") for t in b.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("path"), pa.array(license, pa.string()), pa.array(score, pa.float64()), pa.array(whole, pa.bool_())], ["key", "path", "license", "score", "whole"])

    found = arrow_map(files, run, "key long, path string, license string, score double, whole boolean")
    is_file = F.col("license").isNotNull() & (F.col("whole") | F.coalesce(F.col("path").rlike(LICENCE_NAME), F.lit(False)))
    return found.withColumn("is_license_file", is_file).drop("whole")


def directories(path: F.Column) -> F.Column:
    """All ancestor directories of a path, the root as an empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licenses(files: DataFrame, key: str = "doc_id", path: str = "path", threshold: float = 0.7) -> DataFrame:
    """key, license, score, scope (own, inherited, none), license_path of each row of files (key, path, text)."""
    files = files.select(F.col(key).cast("long").alias("key"), F.col(path).cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    own = materialize(own_licenses(files, threshold), "licenses")
    holders = own.where("is_license_file and path is not null")
    few = holders.count() <= MOST_HOLDERS
    of_directory = holders.withColumn("directory", F.element_at(directories(F.col("path")), -1)).groupBy("directory").agg(F.min(F.struct("path", "license", "score")).alias("holder"))
    # Files are known by their paths here: paths without a licence of their own, once each.
    bare = own.where("license is null and path is not null").select("path").distinct()
    above = bare.select("path", F.explode(directories(F.col("path"))).alias("directory")).join(F.broadcast(of_directory) if few else of_directory, "directory")
    nearest = above.groupBy("path").agg(F.max_by("holder", F.struct(F.length("directory"), "directory")).alias("holder"))
    out = own.join(nearest, "path", "left")
    inherited = F.col("license").isNull() & F.col("holder").isNotNull()
    return out.select(
        F.col("key").alias(key),
        F.when(inherited, F.col("holder.license")).otherwise(F.col("license")).alias("license"),
        F.when(inherited, F.col("holder.score")).otherwise(F.col("score")).alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(inherited, "inherited").otherwise("none").alias("scope"),
        F.when(inherited, F.col("holder.path")).when(F.col("license").isNotNull(), F.col("path")).alias("license_path"),
    )
