"""Near-duplicates against comparing all pairs in plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from trendloom.llm import common, neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_set(text):
    w = plain_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows):
    """(doc_id, n_shingles, component_id, kept) of all rows."""
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    up[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = low.get(top(i))
        out.append((d, len(sets[i]), c, c is None or d == c))
    return sorted(out, key=str)


def vocabulary(rng, n):
    return ["".join(rng.choices("abcdefghijk", k=rng.randrange(2, 9))) for _ in range(n)]


def altered(rng, words, vocab, share):
    return [rng.choice(vocab) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("node", [256, 6])
def test_near_duplicates(spark, monkeypatch, node):
    monkeypatch.setattr(neardup, "NODE", node)
    rng = random.Random(node)
    vocab = vocabulary(rng, 500)
    passage = rng.choices(vocab, k=60)
    texts = [None, "", " \t\n\x0b", "one", "One", "two words", "two words", "TWO  words", "a b c d", "a b c d e", "é ü", "É ü", "x y z"]
    for _ in range(25):
        base = rng.choices(vocab, k=rng.choice([8, 30, 120, 300]))
        for share in [0, 0, 0.003, 0.01, 0.02, 0.03, 0.05]:
            texts.append(" ".join(altered(rng, base, vocab, share)))
    texts += [" ".join(rng.choices(vocab, k=20) + passage + rng.choices(vocab, k=5)) for _ in range(80)]
    base = rng.choices(vocab, k=250)
    texts += [" ".join(altered(rng, base, vocab, rng.choice([0.002, 0.006, 0.012]))) for _ in range(90)]
    long = rng.choices(vocab, k=150_000)
    texts += [" ".join(long), " ".join(altered(rng, long, vocab, 0.005)), "x" * 1_200_000]
    rows = [(i if i % 41 else None, t) for i, t in enumerate(texts)] + [(3, "one"), (3, "one"), (7000, texts[-2])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, None, "s", 1) for d, t in rows], DOCS).selectExpr("*", "1 AS low", "2 AS kept", "3 AS cid")
    out = neardup.near_duplicates(docs.repartition(5)).collect()
    assert sorted(map(tuple, out), key=str) == plain_groups(rows)


def test_copies_and_blocks(spark, monkeypatch):
    """Nodes that no level splits are compared block by block."""
    monkeypatch.setattr(neardup, "NODE", 4)
    monkeypatch.setattr(neardup, "DEPTH", 1)
    rng = random.Random(9)
    vocab = vocabulary(rng, 300)
    base = rng.choices(vocab, k=400)
    rows = [(i, " ".join(altered(rng, base, vocab, 0.002))) for i in range(60)] + [(i, " ".join(base)) for i in range(60, 200)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out), key=str) == plain_groups(rows)


def boilerplate(rng, n, shared=150, own=60):
    common = [f"c{i}" for i in range(shared)]
    return [common + [f"w{rng.randrange(10**9)}" for _ in range(own)] for _ in range(n)]


def test_recall_at_depth(spark, monkeypatch):
    """Documents that shared text keeps together for 12 levels and more: links at the least similarity are still found."""
    monkeypatch.setattr(neardup, "NODE", 16)
    seen = []
    add = neardup.Leaves.add

    def watched(self, classes, trees):
        add(self, classes, trees)
        seen.append((max(x.agg({"level": "max"}).first()[0] or 0 for x in self.split), trees.stop))

    monkeypatch.setattr(neardup.Leaves, "add", watched)
    rng = random.Random(12)
    texts = boilerplate(rng, 1200)
    pairs = []
    for i in range(80):  # the last 16 words differ, and so 16 of 206 shingles
        copy = list(texts[i])
        copy[-16:] = [f"v{rng.randrange(10**9)}" for _ in range(16)]
        assert 85 <= 100 * (206 - 16) / (206 + 16) <= 86
        pairs.append((i, len(texts)))
        texts.append(copy)
    out = neardup.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    component = {r.doc_id: r.component_id for r in out.collect()}
    assert max(level for level, _ in seen) >= 12 and max(trees for _, trees in seen) > neardup.TREES
    found = sum(component[b] == a for a, b in pairs)
    assert found >= 0.9 * len(pairs)
    assert len(set(component.values())) == len(texts) - found  # and nothing else is linked


def test_boilerplate_makes_no_crossings(spark, monkeypatch):
    """Documents that share most of their text but aren't linked are split, not compared all with all."""
    rows = []
    crossings = neardup.crossings

    def watched(labelled):
        out = crossings(labelled)
        rows.append(out.count())
        return out

    monkeypatch.setattr(neardup, "crossings", watched)
    monkeypatch.setattr(neardup, "NODE", 64)
    monkeypatch.setattr(neardup, "TREES", 4)
    for n in (400, 800):
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(boilerplate(random.Random(n), n))], "doc_id long, text string")
        assert neardup.near_duplicates(docs).where("kept").count() == n
    assert len(rows) == 2 and rows[1] <= 2 * rows[0] <= 2 * 800


def met(monkeypatch):
    """Pairs that nodes of families have in the second round, one number for each call."""
    seen = []
    differences = neardup.differences

    def watched(members, sets):
        nodes, pairs = differences(members, sets)
        sizes = [r.n for r in nodes.groupBy("node").agg({"cid": "count"}).selectExpr("`count(cid)` AS n").collect()]
        seen.append(sum(n * (n - 1) // 2 for n in sizes) + pairs.count())
        return nodes, pairs

    monkeypatch.setattr(neardup, "differences", watched)
    return seen


@pytest.mark.parametrize("shared,own", [(100, 10), (100, 14), (300, 40), (60, 15)])
def test_unlinked_families_are_linear(spark, monkeypatch, shared, own):
    """Most text is shared, nothing is linked but planted pairs: no more pairs meet than there are documents, at either size."""
    seen = met(monkeypatch)
    monkeypatch.setattr(neardup, "NODE", 32)
    for n in (300, 600):
        texts = boilerplate(random.Random(n), n, shared, own)
        planted = [(i, n + i) for i in range(n // 10)]
        for i, _ in planted:
            texts.append(texts[i][:-1] + [f"v{i}"])
        out = neardup.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in out} == {i: i for i in range(n)} | {b: a for a, b in planted}
    print("pairs", seen)
    assert not seen or (len(seen) == 2 and seen[0] <= 300 and seen[1] <= 600)


def test_families_within_families(spark, monkeypatch):
    """Nested shared text, members that lack some of it, some linked, some not: as all pairs compared."""
    seen = met(monkeypatch)
    monkeypatch.setattr(neardup, "NODE", 8)
    rng = random.Random(21)
    common = [f"c{i}" for i in range(100)]
    rows = []
    for i in range(420):
        text = common[: rng.choice([100, 100, 100, 94, 88])] + [f"s{i % 3}-{k}" for k in range(rng.choice([0, 4, 8]))] + [f"w{rng.randrange(10**9)}" for _ in range(rng.choice([8, 10, 12]))]
        rows.append((i, " ".join(text)))
        if rng.random() < 0.2:
            text[-rng.choice([1, 2, 5]) :] = [f"v{rng.randrange(10**9)}"]
            rows.append((1000 + i, " ".join(text)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out), key=str) == plain_groups(rows)
    assert seen


def test_differences_lose_no_link(spark):
    """Sets around a common one: pairs and shared nodes connect what all pairs of sets connect."""
    rng = np.random.default_rng(5)
    base = np.arange(1, 61)
    sets = []
    for _ in range(150):
        own = np.setdiff1d(base, rng.choice(base, rng.integers(0, 9), replace=False))
        sets.append(np.union1d(own, rng.integers(100, 160, rng.integers(0, 14))).astype(np.uint64))
    members = spark.createDataFrame([(7, i, i) for i in range(len(sets))], "node long, cid long, label long")
    held = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "cid long, members binary")
    nodes, pairs = neardup.differences(members, held)
    meet, up = {}, list(range(len(sets)))
    for r in nodes.collect():
        meet.setdefault(r.node, set()).add(r.cid)
    near = {(r.a, r.b) for r in pairs.collect()}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    def linked(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both)

    assert near and all(linked(a, b) for a, b in near)
    candidates = near | {(a, b) for c in meet.values() for a in c for b in c if a < b}
    for a, b in candidates:
        if linked(a, b):
            up[top(a)] = top(b)
    missed = [(a, b) for b in range(len(sets)) for a in range(b) if linked(a, b) and top(a) != top(b)]
    assert not missed


def test_sketch_threshold_loses_next_to_nothing():
    """The chance that a pair at 85 % agrees in fewer of the orders than candidates must."""
    from math import comb

    least = int(np.ceil(neardup.SKETCH * neardup.ORDERS))
    assert sum(comb(neardup.ORDERS, i) * 0.85**i * 0.15 ** (neardup.ORDERS - i) for i in range(least)) < 1e-8
    assert neardup.trees_for(8) <= neardup.TREES < neardup.trees_for(12)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_chain_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)]
    rng.shuffle(chain)
    out = {r.cid: r.label for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(50)}


def test_word_hashes_agree_with_words(monkeypatch):
    monkeypatch.setattr(common, "CHUNK", 50)
    rng = random.Random(2)
    texts = ["".join(rng.choices("aAbB \n\t\x0b\x1cé😀-9", k=rng.randrange(200))) for _ in range(200)] + [None, "", "z" * 400 + " " + "z" * 400]
    for words, pattern in ((common.SPACED, r"[^\x20\x09-\x0D]+"), (common.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        for column in (pa.array(texts), pa.array(["skip", *texts])[1:]):
            rows = list(words.texts(column))
            assert [r[0] for r in rows] == list(range(len(texts)))
            for _, hashes, data, starts, ends in rows:
                text = data.tobytes().decode()
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
                found = re.findall(pattern, low)
                assert [low.encode()[a:b].decode() for a, b in zip(starts, ends)] == found
                for w, h in zip(found, hashes, strict=True):
                    assert seen.setdefault((pattern, w), h) == h
        assert len({h for (_, w), h in seen.items()}) == len(seen)


def test_least_is_minwise():
    a, b = np.arange(2000, dtype=np.uint64), np.arange(300, 2000, dtype=np.uint64)
    agree = (neardup.least(common.mix(a)) == neardup.least(common.mix(b))).mean()
    assert abs(agree - 0.85) < 0.12
