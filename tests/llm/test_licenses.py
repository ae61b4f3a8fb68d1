"""License scan against a plain dictionary version, and directory inheritance against a walk upwards."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from trendloom.llm import licenses
from trendloom.llm.common import read

MIT = "Released under the MIT License."
FILES = [
    ("a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    ("a/b/c/x.txt", "nothing here"),
    ("a/b/y.txt", "prose first\n" + MIT + "\nprose last, of many more words than the notice has itself"),
    ("a/b/c/d/COPYING.md", "This work is licensed under the GNU General Public License, version 3.\n" + "words " * 80),
    ("a/b/c/d/z", None),
    ("a/b/c/d/z", ""),
    ("q/r.txt", "a license of no known kind, with many other words in its only line that none has"),
    ("top.txt", "x"),
    (None, MIT),
    (None, "plain"),
    ("ab/x.txt", "y"),
    ("n/m/k.txt", MIT),
    ("n/m/j.txt", "without"),
]


def plain_scores(texts):
    """Best cosine of all lines, all blocks and all windows of templates' lengths in a block, with dictionaries."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: Counter([(x,) for x in w] + list(zip(w, w[1:], strict=False)))
    df, n = Counter(), len(texts)
    for t in texts:
        df.update(set(grams(words(t))))
    vocabulary = {g for ts in licenses.TEMPLATES.values() for t in ts for g in grams(words(t))}
    idf = lambda g: math.log((1 + n) / (1 + df[g])) + 1 if g in vocabulary else math.log(1 + n) + 1
    vector = lambda w: {g: c * idf(g) for g, c in grams(w).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vector(words(t))) for name in sorted(licenses.TEMPLATES) for t in licenses.TEMPLATES[name]]
    out = []
    for t in texts:
        best = (0.0, None)
        parts = []
        for block in re.split(r"\n(?:[ \t\r]*\n)+", t or ""):
            parts += [words(part) for part in [block, *block.split("\n")]]
            w = words(block)
            known = np.concatenate([[0], np.cumsum([(x,) in vocabulary for x in w])])
            for size in {len(words(x)) for ts in licenses.TEMPLATES.values() for x in ts}:
                # of fewer known words, a window is far from all
                parts += [w[i : i + size] for i in range(len(w) - size + 1) if 5 * (known[i + size] - known[i]) >= 2 * size]
        for w in parts:
            v = vector(w)
            for name, tv in templates:
                c = sum(x * tv.get(g, 0) for g, x in v.items()) / norm(v) / norm(tv)
                if c >= licenses.NEAR and c > best[0] + 1e-9:
                    best = (c, name)
        out.append(best)
    return out


def test_scores_against_dictionaries(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    rows = docs.collect()
    got = {r.path: r for r in licenses.scan_licenses(docs).collect()}
    want = plain_scores([r.text for r in rows])
    assert sum(name is not None for _, name in want) >= 3
    for r, (score, name) in zip(rows, want, strict=True):
        assert got[r.path].own_license == name
        assert abs(got[r.path].own_score - score) < 2e-6


def test_inheritance_against_walk(spark):
    files = spark.createDataFrame([(*x, "old", 1) for x in FILES], "path string, text string, license string, extra int")
    got = licenses.scan_licenses(files)
    assert got.columns == ["path", "extra", "own_license", "own_score", "own_words", "is_license_file", "license", "inherited_from"]
    rows = got.collect()
    assert len(rows) == len(FILES)
    holders = {r.path.rpartition("/")[0]: r for r in rows if r.is_license_file and r.path is not None}
    assert set(holders) == {"a", "a/b/c/d", "n/m"}
    for r in rows:
        want = (r.own_license, None)
        if r.own_license is None and r.path is not None:
            at = r.path
            while at:
                at = at.rpartition("/")[0]
                if at in holders:
                    want = (holders[at].own_license, holders[at].path)
                    break
        assert (r.license, r.inherited_from) == want
    by = {r.path: r.license for r in rows}
    assert (by["a/b/c/x.txt"], by["a/b/c/d/z"], by["ab/x.txt"], by["n/m/j.txt"]) == ("Apache-2.0", "GPL-3.0", None, "MIT")


def test_templates_without_customary_words(spark):
    """Cues come from the templates, so any text equal to one is found, whatever its words are."""
    own = {"X": ("the quick brown fox jumps over a lazy dog",), "Y": ("sphinx of black quartz judge my vow",)}
    texts = [("x.txt", "the quick brown fox jumps over a lazy dog"), ("y.txt", "so it goes\nsphinx of black quartz judge my vow\nand on"), ("z.txt", "nothing of the kind")]
    got = {r.path: r for r in licenses.scan_licenses(spark.createDataFrame(texts, "path string, text string"), own).collect()}
    assert {k: r.own_license for k, r in got.items()} == {"x.txt": "X", "y.txt": "Y", "z.txt": None}
    for name, many in licenses.TEMPLATES.items():
        rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(many)], "path string, text string")
        assert all(r.own_score > 0.999 for r in licenses.scan_licenses(rows, {name: many}).collect())


def test_passages_without_cues_are_far():
    """What a template is without its cues is shorter than the least cosine."""
    table = licenses.Templates().fit(np.arange(len(licenses.Templates().terms) + 1) % 11 + 1.0)
    for k, words in enumerate(table.words):
        left = np.where(np.isin(words, table._cues(k)), np.uint64(0), words)
        terms = {int(x) for x in left if x} | {int(x) for x, a, b in zip(licenses.shingles(words, 2), left[:-1], left[1:], strict=True) if a and b}
        rest = sum(table.unit[k, np.searchsorted(table.terms, np.uint64(t))] ** 2 for t in terms)
        assert rest < licenses.NEAR**2


def test_hot_directory_and_names(spark, monkeypatch):
    monkeypatch.setattr(licenses, "SMALL", 0)
    files = spark.range(300).selectExpr("concat('d/', id) AS path", "'plain' AS text", "1 AS dir", "2 AS __dir", "3 AS row", "4 AS part", "5 AS `a.b`")
    more = spark.createDataFrame([("d/LICENSE", MIT, 1, 2, 3, 4, 5), ("e/x", "y", 1, 2, 3, 4, 5)], files.schema)
    out = licenses.scan_licenses(files.unionByName(more))
    rows = out.collect()
    assert out.columns[:6] == ["path", "dir", "__dir", "row", "part", "a.b"] and {tuple(r)[1:6] for r in rows} == {(1, 2, 3, 4, 5)}
    assert sorted(r.license == "MIT" for r in rows) == [False] + [True] * 301


def test_empty_and_long(spark):
    schema = "path string, text string"
    assert licenses.scan_licenses(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 300_000 + "\n" + MIT + "\n" + "word " * 300_000
    (row,) = licenses.scan_licenses(spark.createDataFrame([("p", long)], schema)).collect()
    assert row.own_license == "MIT" and not row.is_license_file


def test_notices_in_mid_line_and_wrapped(spark):
    prose = "he said that day how all of them went down by the old river and saw nothing but rain "
    wrapped = prose + "Licensed under the Apache\n * License, Version 2.0. " + prose
    texts = {
        "MIT": prose * 3 + MIT + " " + prose * 3,
        "Apache-2.0": prose + "Licensed under the Apache License, Version 2.0. " + prose * 40,
        "wrapped": wrapped,
        "apart": prose + "Licensed under the Apache\n\n" + prose,
        "none": prose + "she had no license for it and asked no permission " + prose,
    }
    rows = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = {r.path: r for r in licenses.scan_licenses(rows).collect()}
    assert {k: r.own_license for k, r in got.items()} == {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "wrapped": "Apache-2.0", "apart": None, "none": None}
    assert [got[k].own_words for k in ("MIT", "Apache-2.0", "wrapped")] == [5, 8, 8]
    assert not any(r.is_license_file for r in got.values())


def test_slid_windows_against_each_window():
    """Each cue's best window, by cosines of all windows; with words that repeat."""
    table = licenses.Templates().fit(np.arange(len(licenses.Templates().terms) + 1) % 7 + np.eye(1, len(licenses.Templates().terms) + 1, len(licenses.Templates().terms))[0] * 50)
    random = np.random.default_rng(5)
    pool = "the license the under released mit apache version 2 0 the river permission is hereby granted free of of charge any".split()
    for n in (3, 40, 90):
        words = licenses._hashes(" ".join([*random.choice(pool, n), "released under the mit license", *random.choice(pool, n)]))
        at = np.flatnonzero(np.isin(words, table.cues))
        want = {}
        for size in set(table.lengths.tolist()):
            unit = table.unit[table.lengths == size]
            for a in range(len(words) - size + 1):
                grams, counts = np.unique(licenses._grams(words[a : a + size]), return_counts=True)
                place = np.minimum(np.searchsorted(table.terms, grams), len(table.terms) - 1)
                own = table.terms[place] == grams
                v = counts * np.where(own, table.idf[place], table.unknown)
                cosine = round(float((unit[:, place[own]] @ v[own]).max() / np.sqrt((v * v).sum())), 9)
                for p in at[(at >= a) & (at < a + size)] if cosine >= licenses.NEAR else ():
                    want[p] = min(want.get(p, (0.0, 0, 0)), (-cosine, a, a + size))
        assert want
        assert set(table.slid(words, np.zeros(len(words), int), at, licenses.NEAR)) == {x[1:] for x in want.values()}
