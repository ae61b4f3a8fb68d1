"""Decontamination against looking for each window at each place."""

import hashlib
import random
import re

from trendloom.llm import decontaminate

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for d, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontaminate(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdeéß1", k=rng.randrange(1, 5))) for _ in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 5, 6, 12, 13, 14, 30])))) for i in range(40)]
    items = [(i, t) for i, t in items if len(t.split()) not in (1, 2) or i % 5 == 0] + [(2, items[3][1]), (100, items[9][1]), (None, items[20][1] + " Q"), (101, None), (102, " ,.! "), (103, "the " * 20)]
    rows = []
    for i in range(250):
        w = rng.choices(vocab, k=rng.randrange(60))
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1] or ""
            part = part.upper() if rng.random() < 0.3 and "ß" not in part else part
            cut = part.split()
            w += (cut if rng.random() < 0.6 else cut[rng.randrange(3) :]) + rng.choices(vocab, k=rng.randrange(20))
        rows.append((i if i % 31 else None, rng.choice([" ", "\n", ", ", "--"]).join(w)))
    rows += [(900, None), (901, ""), (902, " . "), (903, "the " * 40), (904, "the " * 12), (905, " ".join(rng.choices(vocab, k=200_000)) + " " + items[-5][1]), *rows[:3]]
    docs = spark.createDataFrame([(d, t, None, "s", 1) for d, t in rows], DOCS).selectExpr("*", "1 AS key", "2 AS n_words", "3 AS window")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS words")
    out = decontaminate.decontaminate(docs.repartition(4), bench)
    assert sorted(map(tuple, out.collect()), key=str) == plain(rows, items)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c", None, None, None)], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.decontaminate(docs, bench).collect()] == [(1, 3, 0, 0)]
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
