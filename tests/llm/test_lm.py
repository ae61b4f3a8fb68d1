"""LM scores: base by plain counts, the model's probabilities against loops, its sum over all tokens, held-out gain."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trendloom.llm import lm

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def check_base(rows, found, fold=True):
    """``rows`` of (doc_id, text) against the results in the same order."""
    held = [fold and zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter()
    for (_, text), h in zip(rows, held, strict=True):
        if not h:
            counts.update([*words(text), None])
    total, distinct = sum(counts.values()), len(counts)
    for (i, text), h, r in zip(rows, held, found, strict=True):
        tokens = [*words(text), None]
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), total), i
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert math.isfinite(r.score) and r.score <= 1e-9


def test_query(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    found = sorted(lm.op12_lm_scores(spark, SF).collect(), key=lambda r: r.doc_id)
    check_base(docs, found)
    held = [r for r in found if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert len(held) == sum(zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in found) and gain > 0.1


def texts(rng, count):
    pools = [["the", "cat", "sat", "on", "a", "mat", "and", "slept"], ["le", "chat", "est", "sur", "un", "tapis", "É", "noir"]]
    return [(i, " ".join(rng.choice(pools[i % 2]) if rng.random() < 0.9 else f"w{rng.randrange(500)}" for _ in range(rng.randrange(0, 40)))) for i in range(count)]


def test_rare_words_are_joined(spark):
    """With 20 common words in each task, the rest's counts come from the table."""
    rows = [*texts(random.Random(2), 200), (7, "The the THE"), (7, "The the THE"), (None, None), (500, ""), (501, "  \t\n"), (502, "zzz " * 30_000), (503, "q" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS n_known", "3 AS at", "4 AS h", "5 AS row")
    results = []
    for common in (20, lm.COMMON):
        out = lm.score_texts(df, lm.train(df, common=common))
        assert out.columns == ["doc_id", "text", "at", "h", "row", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        key = lambda r: (str(r.doc_id), str(r.text))
        found = sorted(out.collect(), key=key)
        check_base([(r.doc_id, r.text) for r in found], found, fold=False)
        results.append([r.base_score for r in found])
    assert results[0] == pytest.approx(results[1])


def test_empty(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = df.where("false")
    assert lm.score_texts(none, lm.train(df)).count() == 0
    found = lm.score_texts(df, lm.train(none)).collect()
    assert all(r.n_known == r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in found)


def trained(seed, docs=120, members=None):
    rng = random.Random(seed)
    column = pa.array([t for _, t in texts(rng, docs)])
    tokens = [t for _, t in lm.tokens_of(column, 300)]
    hashes = np.concatenate([t.hash for t in tokens])
    other = np.concatenate([t.other for t in tokens])
    h, first, c = np.unique(hashes, return_index=True, return_counts=True)
    order = np.lexsort([h, -c])
    v = lm.Vocabulary(h[order], c[order], other[first][order], np.zeros(lm.OTHERS), np.zeros(lm.OTHERS, np.int64), int(c.sum()), len(h))
    w = lm.Weights()
    return column, tokens, v, w


def test_probabilities_sum_to_one():
    """Over all known words and one unseen word of each class, after any context."""
    _, tokens, v, w = trained(5, docs=400)
    for t in tokens:
        w.learn(lm.Events(t, v), v)
    e = lm.Events(tokens[0], v)
    for at in (0, 7, 150):
        own = np.array([at])
        classes, _ = w.shares(e, v, own, np.zeros(0, np.int64))
        keys = tokens[0]
        total = 0.0
        for c in range(lm.CLASSES):
            size = min(max(v.members - c * lm.MEMBERS, 0), lm.MEMBERS)
            if size:
                total += float(classes[0, c])
        for c in range(lm.OTHERS):
            tail = v.counts[(v.rank >= v.members) & (v.others == c)]
            total += float(classes[0, lm.CLASSES + c]) * float(((tail + 1).sum() + 1) / (v.sums[c] + v.kinds[c] + 1))
        assert total == pytest.approx(1, abs=1e-4) and len(keys.hash) > 150


def test_against_loops():
    """Forward scores and gradient steps, token by token in Python."""
    _, tokens, v, w = trained(6)
    mask, m64 = lm.BUCKETS - 1, (1 << 64) - 1
    p_ = int(lm._P)

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m64
        return x ^ (x >> 31)

    where = {int(h): i for i, h in enumerate(v.hashes)}
    tables = [np.zeros((lm.BUCKETS, w)) for w in lm.Weights.WIDTHS]
    squares = [np.zeros(lm.BUCKETS), np.zeros(lm.BUCKETS)]

    def token(t, i):
        start = int((t.last - t.sizes + 1)[np.searchsorted(t.last, i)])

        def symbol(j):
            if j < start:
                return int(lm.BEGIN)
            r = v.rank[where[int(t.hash[j])]]
            return int(t.hash[j]) if r < lm.CONTEXT else int(t.other[j])

        one, two = symbol(i - 1), symbol(i - 2)
        keys = [mix((one + p_) & m64), mix((mix((two * p_ + 2) & m64) + one) & m64), mix((two * p_ + 3) & m64)]
        r = int(v.rank[where[int(t.hash[i])]])
        member = r < v.members
        cls = r // lm.MEMBERS if member else lm.CLASSES + int(t.other[i])
        rows = [[k & mask for k in keys], [((k ^ cls) * p_ & m64) >> 40 & mask for k in keys] if member else None]
        return cls, r % lm.MEMBERS, rows

    def softmax(x):
        x = np.exp(x - x.max())
        return x / x.sum()

    for t in tokens:
        e = lm.Events(t, v)
        before = lm.Weights(w)
        got = before.log10(e, v)
        gradients = [{}, {}]
        for i in range(len(t.hash)):
            cls, slot, rows = token(t, i)
            p = softmax(v.class_bias + sum(tables[0][r] for r in rows[0]))
            want = math.log10(p[cls])
            p[cls] -= 1
            for r in rows[0]:
                gradients[0][r] = gradients[0].get(r, 0) + p
            if rows[1] is not None:
                q = softmax(v.member_bias[cls] + sum(tables[1][r] for r in rows[1]))
                want += math.log10(q[slot])
                q[slot] -= 1
                for r in rows[1]:
                    gradients[1][r] = gradients[1].get(r, 0) + q
            else:
                want -= math.log10(v.sums[cls - lm.CLASSES] + v.kinds[cls - lm.CLASSES] + 1)
            assert got[i] == pytest.approx(want, abs=2e-3), i
        w.learn(e, v)  # fewer tokens than a step
        for k in (0, 1):
            for r, g in gradients[k].items():
                squares[k][r] += (g * g).mean()
                tables[k][r] -= lm.RATE / math.sqrt(squares[k][r] + 1e-8) * g
            assert np.allclose(w.tables[k], tables[k], atol=2e-3)


def test_average_of_tasks(spark):
    """One round over two partitions is the mean, by tokens, of what each learns alone."""
    rows = texts(random.Random(9), 60)
    df = spark.createDataFrame([(t,) for _, t in rows], "text string").repartition(2).cache()
    model = lm.train(df, rounds=1)
    v, total, used = model.vocabulary.value, [0, 0], 0
    for part in df.rdd.glom().collect():
        own = lm.Weights()
        n = 0
        for _, t in lm.tokens_of(pa.array([r.text for r in part]), lm.FLUSH // 8):
            own.learn(lm.Events(t, v), v)
            n += len(t.hash)
        total, used = [a + n * b for a, b in zip(total, own.tables, strict=True)], used + n
    for want, got in zip(total, model.weights.tables, strict=True):
        assert np.abs(want).max() > 0 and np.allclose(want / used * (1 - lm.DECAY), got, atol=1e-5)
