"""Collocations against counts in dictionaries."""

import random
import re
from collections import Counter

import numpy as np

from trendloom.llm import collocations


def plain(rows, least, top, depth=4):
    upper = {c: c + 32 for c in range(65, 91)}
    counts, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(upper)):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, depth + 1):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        good = {p for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p in good:
            if any(len(q) > len(p) and 100 * f[q] >= 80 * f[p] and any(q[i : i + len(p)] == p for i in range(len(q))) for q in good):
                continue
            cuts = [(2000000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def result(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS n", "2 AS range", "'x' AS word", "3 AS f").repartition(5)


def texts(rng, count):
    pools = {None: "a b c d", "und": "a b c", "en": "the of New york city Ångström AND été x y z", "fr": "le la ΣΣ ï"}
    ends = [" ", "  ", "\t", ", ", ". ", "\n", "\x0b", "!?", "\xa0"]
    return [(lang, "".join(rng.choice(pools[lang].split()) + rng.choice(ends) for _ in range(rng.randrange(0, 60)))) for lang in rng.choices(list(pools), k=count)]


def test_against_dictionaries(spark):
    rng = random.Random(3)
    rows = texts(rng, 150) + [("en", "New York City. " * 40), ("en", None), (None, ""), ("de", ".,;"), ("de", "Ein Wort")] + [("en", "one two three four five")] * 30
    for least, top in ((2, 2000), (5, 7)):
        want = plain(rows, least, top)
        assert result(collocations.collocations(table(spark, rows), least=least, top=top)) == want and len(want) > 20
    # pieces of a few words, and owners that merge all the time
    assert result(collocations.collocations(table(spark, rows), least=3, flush=40, gather=60)) == plain(rows, 3, 2000)


def test_a_third_of_all_words_is_one(spark):
    rng = random.Random(4)
    rows = [("en", " ".join(rng.choice(["hot", *(f"w{i}" for i in range(40))][: 1 if rng.random() < 0.4 else None]) for _ in range(400))) for _ in range(40)]
    assert result(collocations.collocations(table(spark, rows), least=4, top=50, flush=700)) == plain(rows, 4, 50)


def test_very_long_text_and_word(spark):
    rows = [("en", "ab Cd ef. " * 60_000), ("en", ("x" * 70_000 + " y ") * 31)]
    got = result(collocations.collocations(table(spark, rows)))
    assert got == plain(rows, 30, 2000) and len(got) > 1


def test_ties_at_the_end(spark):
    rows = [("en", f"a{i} b{i}. " * 3) for i in range(30)]
    got = result(collocations.collocations(table(spark, rows), least=3, top=4))
    assert [r[2] for r in got] == sorted(f"a{i} b{i}" for i in range(30))[:4]


def test_empty(spark):
    assert result(collocations.collocations(table(spark, []))) == []
    assert result(collocations.collocations(table(spark, [(None, None), ("en", "a b")]))) == []


def test_tally_and_pieces():
    """Merged and serialised levels against counters, the order kept."""
    rng = np.random.default_rng(2)
    for depth in (1, 2, 3, 4):
        rows = rng.integers(0, 4, (500, depth)).astype(np.uint64) << np.uint64(62)
        columns, counts = collocations.tally(list(rows.T.copy()))
        want = sorted(Counter(map(tuple, rows.tolist())).items())
        assert [tuple(map(int, x)) for x in zip(*columns, strict=True)] == [k for k, _ in want] and counts.tolist() == [v for _, v in want]
        again, n = collocations.unpack(collocations.pack(columns, counts))
        assert all((a == b).all() for a, b in zip(again, columns, strict=True)) and (n == counts).all()
        twice = collocations.tally([np.concatenate([c, c[::2]]) for c in columns], np.concatenate([counts, counts[::2]]))
        assert twice[1].sum() == counts.sum() + counts[::2].sum()
