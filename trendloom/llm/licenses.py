"""License scans: TF-IDF cosine of passages to license templates, then inheritance by directory.

Passages, headers, notices within prose and whole license files alike, are compared with templates as
sparse TF-IDF vectors. Each template's rarest words are cues: as many as a passage must have one of to
be near enough, so passages without a cue needn't be compared. A file without a license of its own takes that of the nearest
directory above it which holds a license file; joins on paths find it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, materialize, read, shingles, summed, tidy

# Customary notices and opening passages of public licenses.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
    ),
    "BSD-2-Clause": ("BSD 2-Clause License", "Licensed under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (
        "BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: neither the name of the copyright holder nor the names of its contributors may be used to endorse",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-3.0-only"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0-only"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "CC0-1.0": ("Released under the Creative Commons CC0 1.0 Universal public domain dedication.", "Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
}
#: A passage is this near to a template at least.
NEAR = 0.6
#: Rows of directories that are broadcast at most, and the parts that larger ones are dealt into.
SMALL, PARTS = 100_000, 32
#: Words whose windows are compared at once, at most.
SLICE = 4096
#: A text is a license file if its passages that are near hold this share of its words.
WHOLE = 0.5
#: Names of license files.
NAMES = r"(?i)^(un)?licen[cs]es?([.-].*)?$|^copying([.-].*)?$"


def _grams(words: np.ndarray) -> np.ndarray:
    """A passage's terms: its words and its pairs of neighbouring words."""
    return np.concatenate([words, shingles(words, 2)]) if len(words) > 1 else words


def _hashes(text: str) -> np.ndarray:
    return next(ALNUM.texts(pa.array([text])))[1]


class Templates:
    """Template vectors over their own terms; ``idf`` tells how rare these are in the corpus."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.words = [_hashes(t) for name in sorted(templates) for t in templates[name]]
        pairs = [(name, _grams(w)) for name, w in zip((name for name in sorted(templates) for _ in templates[name]), self.words, strict=True)]
        self.names = [name for name, _ in pairs]
        self.terms = np.unique(np.concatenate([g for _, g in pairs])) if pairs else np.zeros(0, np.uint64)
        self.counts = np.array([np.bincount(np.searchsorted(self.terms, g), minlength=len(self.terms)) for _, g in pairs]).reshape(len(pairs), len(self.terms))
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.fit(np.zeros(len(self.terms) + 1))

    def fit(self, seen: np.ndarray) -> Templates:
        """``seen``: documents with each term, then all documents."""
        self.idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
        self.unknown = np.log(1 + seen[-1]) + 1
        rows = self.counts * self.idf
        self.unit = rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)
        self.cues = np.unique(np.concatenate([np.zeros(0, np.uint64), *[self._cues(k) for k in range(len(self.words))]]))
        return self

    def _cues(self, k: int, near: float = NEAR) -> np.ndarray:
        """The rarest words of template ``k``, until what is left of it without them has a length below ``near``:
        the cosine of a passage that has none of them is at most that length."""
        words, weight = self.words[k], self.unit[k] ** 2
        of = lambda grams: weight[np.searchsorted(self.terms, grams)]
        pairs = shingles(words, 2) if len(words) > 1 else words[:0]
        own = np.unique(words)
        cues: list[np.uint64] = []
        for w in own[np.lexsort((own, -self.idf[np.searchsorted(self.terms, own)]))]:
            left = ~np.isin(words, cues)
            grams = np.unique(np.concatenate([words[left], pairs[left[:-1] & left[1:]]]))
            if of(grams).sum() < (near - 1e-6) ** 2:
                break
            cues.append(w)
        return np.array(cues, np.uint64)

    def slid(self, words: np.ndarray, block: np.ndarray, at: np.ndarray, near: float) -> list[tuple[int, int]]:
        """Windows (from, to) of the templates' numbers of words, in one ``block``, that are nearest to a template.

        Each cue (``at``) has one of those that hold it, if any is at least near; cosines are exact.
        """
        most, found = int(self.lengths.max(initial=0)), []
        if not most:
            return found
        ends = np.searchsorted(block, block[at], "right")
        low = np.maximum(np.searchsorted(block, block[at], "left"), at - most + 1)
        high = np.minimum(ends, at + most)
        k = 0
        while k < len(at):  # runs of cues whose surroundings overlap, in slices
            m = k + 1
            while m < len(at) and low[m] < high[m - 1] and block[at[m]] == block[at[k]] and high[m] - low[k] < SLICE:
                m += 1
            found += [(a + int(low[k]), z + int(low[k])) for a, z in self._slid(words[low[k] : high[m - 1]], at[k:m] - low[k], near)]
            k = m
        return found

    def _slid(self, words: np.ndarray, at: np.ndarray, least: float) -> list[tuple[int, int]]:
        n, most = len(words), int(self.lengths.max())
        dots, squares, twice = [], [], []
        for grams in (words, shingles(words, 2) if n > 1 else words[:0]):
            place = np.minimum(np.searchsorted(self.terms, grams), len(self.terms) - 1)
            own = self.terms[place] == grams
            idf = np.where(own, self.idf[place], self.unknown)
            value = np.where(own, self.unit[:, place] * idf, 0.0)
            dots.append(np.concatenate([np.zeros((len(value), 1)), np.cumsum(value, axis=1)], axis=1))
            squares.append(np.concatenate([[0.0], np.cumsum(idf * idf)]))
            # places of equal terms: a term of count c has c * c in the norm, not c
            same = [(np.flatnonzero(grams[d:] == grams[:-d]), d) for d in range(1, min(most, len(grams)))]
            first = np.concatenate([x for x, _ in same] + [np.zeros(0, np.int64)])
            twice.append((first, first + np.repeat([d for _, d in same], [len(x) for x, _ in same]).astype(np.int64), 2 * idf[first] ** 2))
        cues = np.zeros(n + 1, np.int64)
        cues[at + 1] = 1
        cues = np.cumsum(cues)
        near = []
        for size in np.unique(self.lengths):
            starts = np.arange(n - size + 1)
            if not len(starts):
                continue
            dot, norm = 0.0, 0.0
            for d, q, (i, j, w), wide in zip(dots, squares, twice, (size, size - 1), strict=True):
                dot = dot + d[self.lengths == size][:, starts + wide] - d[self.lengths == size][:, starts]
                norm = norm + q[starts + wide] - q[starts]
                held = j - i < wide
                change = np.zeros(n + 2)
                np.add.at(change, np.clip(j[held] - wide + 1, 0, n), w[held])
                np.add.at(change, i[held] + 1, -w[held])
                norm = norm + np.cumsum(change)[: len(starts)]
            cosine = dot.max(axis=0) / np.sqrt(norm)
            good = starts[(cosine >= least - 1e-9) & (cues[starts + size] > cues[starts])]
            near += [(-round(float(cosine[a]), 9), int(a), int(a + size)) for a in good]
        settled, out = np.zeros(n, bool), []
        for _, a, z in sorted(near):
            mine = at[np.searchsorted(at, a) : np.searchsorted(at, z)]
            if not settled[mine].all():
                settled[mine] = True
                out.append((a, z))
        return out

    def known(self, grams: np.ndarray) -> np.ndarray:
        """Places of the grams that templates have."""
        at = np.minimum(np.searchsorted(self.terms, grams), len(self.terms) - 1)
        return at[self.terms[at] == grams]

    def best(self, words: np.ndarray) -> tuple[float, str]:
        """The nearest template's cosine and name; of equals the first name."""
        grams, counts = np.unique(_grams(words), return_counts=True)
        at = np.minimum(np.searchsorted(self.terms, grams), len(self.terms) - 1)
        own = self.terms[at] == grams
        v = counts[own] * self.idf[at[own]]
        rest = counts[~own] * self.unknown
        cosines = self.unit[:, at[own]] @ v / np.sqrt((v * v).sum() + (rest * rest).sum())
        k = int(cosines.argmax())
        return float(cosines[k]), self.names[k]


def passages(words: np.ndarray, data: np.ndarray, start: np.ndarray, templates: Templates, near: float = NEAR) -> np.ndarray:
    """Word ranges (from, to) around cues: the line, the block between blank lines, and windows slid over the block."""
    at = np.flatnonzero(np.isin(words, templates.cues))
    if not len(at):
        return np.zeros((0, 2), np.int64)
    breaks = np.flatnonzero(data == 10)
    solid = np.flatnonzero((data > 32) | (data == 0))
    line = np.searchsorted(breaks, start)  # of each word
    of_solid = np.unique(np.searchsorted(breaks, solid))  # lines that aren't blank
    block = np.cumsum(np.diff(of_solid, prepend=of_solid[0] if len(of_solid) else 0) > 1)[np.searchsorted(of_solid, line)]
    ends = lambda x: np.stack([np.searchsorted(x, x[at], "left"), np.searchsorted(x, x[at], "right")], axis=1)
    slid = np.array(templates.slid(words, block, at, near), np.int64).reshape(-1, 2)
    return np.unique(np.concatenate([ends(line), ends(block), slid]), axis=0)


def frequencies(texts: DataFrame, templates: Templates) -> np.ndarray:
    """In how many of all ``texts`` (text) each term of the templates occurs, then their number."""
    size = len(templates.terms) + 1

    def step(batches):
        total = np.zeros(size)
        for b in batches:
            for _, words, *_ in ALNUM.texts(b.column(0)):
                total[np.unique(templates.known(_grams(words)))] += 1
                total[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])

    return summed(texts.select(F.col("text").cast("string").alias("text")).mapInArrow(step, "part binary"), size)


def directory(path: Column) -> Column:
    """What stands before the last slash; without one, the empty root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan_licenses(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, near: float = NEAR) -> DataFrame:
    """One row per row of ``files`` (path, text): all its columns but the text, and what was found.

    ``own_license`` and ``own_score`` are those of the nearest template, ``own_words`` the words of
    the text in passages at least ``near`` to one; ``is_license_file`` holds for texts with a
    license whose name says so or which have little else. ``license`` is the file's own or, with
    ``inherited_from``, that of the license file in the nearest directory above or beside it. Of
    several in one directory the highest score, then the least path, counts.

    Nulls: a null text is empty and has no license, but may inherit; a null path has no directory:
    it neither gives nor takes. Repeated rows each give a row. An empty table gives none. Input
    columns named like the results are replaced, others may have any name. Texts are scanned whole,
    whatever their length. A directory may hold any share of the files. ``near`` is ``NEAR`` or more.
    """
    spark = files.sparkSession
    if near < NEAR:
        raise ValueError(f"cues are those of passages at least {NEAR} near")
    table = Templates(templates)
    table.fit(frequencies(files, table))
    shared = spark.sparkContext.broadcast(table)
    results = ["own_license", "own_score", "own_words", "is_license_file", "license", "inherited_from"]
    kept = [c for c in files.columns if c not in (*results, "text")]
    row = F.struct(*[files[f"`{c}`"] for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    rows = files.select(F.col("text").cast("string").alias("text"), row.alias("row"), F.col("path").cast("string").alias("path"))

    def step(batches):
        table = shared.value
        for b in batches:
            license, score, own, share = [], [], [], []
            for _, words, data, start, _ in ALNUM.texts(b.column(0)):
                best, covered = (0.0, ""), np.zeros(len(words) + 1, np.int64)
                for a, z in passages(words, data, start, table, near):
                    cosine, name = table.best(words[a:z])
                    if cosine >= near - 1e-9:
                        covered[a] += 1
                        covered[z] -= 1
                        best = max(best, (cosine, name), key=lambda x: (round(x[0], 9), [-ord(c) for c in x[1]]))
                n = int((np.cumsum(covered[:-1]) > 0).sum())
                license.append(best[1] or None)
                score.append(round(best[0], 6))
                own.append(n)
                share.append(n >= WHOLE * len(words) and n > 0)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(license, pa.string()), pa.array(score, pa.float64()), pa.array(own, pa.int64()), pa.array(share, pa.bool_())], [*b.schema.names[1:], *results[:4]])

    schema = type(rows.schema)(rows.schema.fields[1:]).add("own_license", "string").add("own_score", "double").add("own_words", "long").add("is_license_file", "boolean")
    found = rows.mapInArrow(step, schema)
    named = F.coalesce(F.regexp_extract("path", r"[^/]*$", 0).rlike(NAMES), F.lit(False))
    found = found.withColumn("is_license_file", F.col("own_license").isNotNull() & (F.col("is_license_file") | named))
    # small rows, read by three branches below: the texts are scanned once
    found = materialize(found.withColumn("dir", directory(F.col("path"))), "license-found")

    holders = found.where("is_license_file AND dir IS NOT NULL").groupBy(F.col("dir").alias("above")).agg(F.min(F.struct(-F.col("own_score"), "path", "own_license")).alias("holder"))
    # Each directory is expanded into itself and those above it once, however many files it has.
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = found.where("own_license IS NULL AND dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = dirs.join(holders, "above").groupBy("dir").agg(F.max_by("holder", F.length("above")).alias("holder"))
    nearest = materialize(nearest.select("dir", F.col("holder.path").alias("from"), F.col("holder.own_license").alias("given")), "license-dirs")
    if nearest.count() <= SMALL:
        out = found.join(F.broadcast(nearest), "dir", "left")
    else:  # the files of one directory are dealt into parts
        part = F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int").alias("part")
        out = found.select("*", part).join(nearest.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")), ["dir", "part"], "left")
    inherits = F.col("own_license").isNull()
    return out.select(*[F.col(f"row.`{c}`") for c in kept], *results[:4], F.coalesce("own_license", "given").alias("license"), F.when(inherits, F.col("from")).alias("inherited_from"))


@tidy
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, document."""
    docs = read(spark, sf_dir, "documents")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    files = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text")
    return scan_licenses(files)
