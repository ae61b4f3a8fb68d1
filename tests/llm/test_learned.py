"""Language ID and quality classifier: held-out accuracy, nulls, empty tables, clashing columns."""

import random
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trendloom.llm import language, quality
from trendloom.llm.common import SPACED, read

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    found = {r.doc_id: r for r in language.op8_language_id(spark, SF).collect()}
    docs = read(spark, SF, "documents").select("doc_id", "lang", "text").collect()
    assert len(found) == len(docs)
    held = [(r.lang, found[r.doc_id].lang_pred) for r in docs if found[r.doc_id].held_out and r.lang and r.text]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 0


def test_language_odd_rows(spark):
    schema = "doc_id long, text string, lang string, lang_pred string"
    rows = [(1, "the cat and the dog", "en", "x"), (None, None, None, None), (3, "", "en", None), (4, "123 !?", "fr", None), (5, "le chat et le chien", "fr", None), (5, "le chat et le chien", "fr", None), (6, "the " * 200_000, None, None)]
    docs = spark.createDataFrame(rows, schema)
    out = language.identify(docs, language.train(docs.select("text", "lang"))).collect()
    by = {r.doc_id: r.lang_pred for r in out}
    assert len(out) == 7 and by[None] == by[3] == by[4] == "und" and by[1] in ("en", "fr")
    empty = spark.createDataFrame([], schema)
    model = language.train(empty.select("text", "lang"))
    assert language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, model).collect()} == {"und"}


def test_quality_held_out(spark):
    found = {r.doc_id: r for r in quality.op5_quality(spark, SF).collect()}
    labels = [(r.quality, found[r.doc_id]) for r in read(spark, SF, "labels").collect() if r.doc_id in found]
    held = [(q, r.predicted) for q, r in labels if r.held_out and q is not None]
    assert sum(q == p for q, p in held) >= 0.8 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in found.values())


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", 0), (2, None, 0), (None, "", 1), (1, "good words here", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    out = quality.score_quality(docs, quality.train(docs, labels)).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    none = docs.where("false")
    assert quality.score_quality(none, quality.train(none, labels.where("false"))).count() == 0


def labelled_texts():
    rng = random.Random(6)
    pools = {x: ["".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(60)] for x, letters in (("aa", "abcdeéx"), ("bb", "efghiß x"), ("cc", "klmnoжx"))}
    return [(" ".join(rng.choices(pools[x], k=rng.randrange(1, 30))), x) for x in rng.choices(sorted(pools), k=150)]


def test_grams_of_strings():
    """Bucket counts against grams of the normalised string, one by one."""
    for text in ("Ab  c", "x", "é1É", "a" * 9, " .b. "):
        plain = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        want = np.zeros(language.BUCKETS, np.int64)
        for n in (1, 2, 3):
            for i in range(n == 1, len(plain) - n + 1):  # the space before the text is no gram of its own
                h = 0
                for k, c in enumerate(plain[i : i + n], 1):
                    h = ((h * 0x85EBCA77 if k > 1 else 0) + ord(c) * 0x9E3779B1 + k) % 2**32
                h = (h ^ (h >> 15)) * 0xC2B2AE3D % 2**32
                want[h >> (32 - language.BITS)] += 1
        assert (language.count_grams(text) == want).all(), text


def test_language_against_loops(spark, monkeypatch):
    """Follow-the-regularised-leader feature by feature, averaged shards, and the temperature by trying all."""
    monkeypatch.setattr(language, "SHARDS", 2)
    rows = labelled_texts()
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = language.train(docs)
    key = F.xxhash64("text", "lang")
    order = docs.distinct().select("text", "lang", key.alias("key"), F.pmod(F.xxhash64(key), F.lit(2)).alias("shard"), F.xxhash64(key, F.lit(9)).alias("at"), (F.pmod(key, F.lit(language.CALIBRATE)) == 0).alias("calibrate")).orderBy("at").collect()
    langs = sorted({r.lang for r in order})
    assert model.langs == langs
    counts = {r.text: language.count_grams(r.text) for r in order}
    seen = sum((counts[t] > 0).astype(int) for t, _ in rows)
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1

    def vector(text):
        at = np.flatnonzero(counts[text])
        v = [np.log1p(counts[text][i]) * idf[i] for i in at]
        size = sum(x * x for x in v) ** 0.5
        return {int(i): float(np.float32(x / size)) for i, x in zip(at, v, strict=True)}

    def weight(z, n):
        return 0.0 if abs(z) <= language.L1 else -(z - np.sign(z) * language.L1) / ((language.BETA + n**0.5) / language.ALPHA + language.L2)

    def shares(x, w, temperature=1.0):
        s = [sum(v * w(i, k) for i, v in x.items()) / temperature for k in range(3)]
        e = [np.exp(a - max(s)) for a in s]
        return [a / sum(e) for a in e]

    state = {}
    for _ in range(language.EPOCHS):
        after = []
        for shard in (0, 1):
            own = dict(state)
            for r in order:
                if r.shard == shard and not r.calibrate:
                    x = vector(r.text)
                    p = shares(x, lambda i, k, own=own: weight(*own.get((i, k), (0.0, 0.0))))
                    for i, v in x.items():
                        for k in range(3):
                            z, n = own.get((i, k), (0.0, 0.0))
                            g = v * (p[k] - (langs[k] == r.lang))
                            own[i, k] = (z + g - ((n + g * g) ** 0.5 - n**0.5) / language.ALPHA * weight(z, n), n + g * g)
            after.append(own)
        state = {f: tuple(np.mean([s.get(f, state.get(f, (0.0, 0.0))) for s in after], axis=0)) for f in after[0].keys() | after[1].keys()}
    want = np.zeros((language.BUCKETS, 3))
    for (i, k), (z, n) in state.items():
        want[i, k] = weight(z, n)
    assert np.abs(model.weights - want).max() < 1e-9 and (want == 0).mean() > 0.5
    loss = [sum(-np.log(shares(vector(r.text), lambda i, k: want[i, k], t)[langs.index(r.lang)]) for r in order if r.calibrate) for t in language.TEMPERATURES]
    assert model.temperature == language.TEMPERATURES[int(np.argmin(loss))]
    name, score = model.predict(counts[rows[0][0]])
    p = shares({i: v for i, v in vector(rows[0][0]).items()}, lambda i, k: want[i, k], model.temperature)
    assert name == langs[int(np.argmax(p))] and score == pytest.approx(max(p), abs=1e-5)


def test_language_of_many_labels(spark):
    """Copies count once, rare labels stay, and of too many labels the commonest are learned."""
    common = [(f"the same words again {i % 3}", "en") for i in range(400)]
    rows = [*common, *[("le chat noir", "fr")] * 2, ("der hund läuft", "de"), *[(f"stray {c}", f"x{c}") for c in string.ascii_lowercase]]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = language.train(docs, labelled=60)
    assert {"en", "fr", "de"} <= set(model.langs) and len(model.langs) == 29
    assert language.train(docs, languages=2).langs == ["en", "fr"]
    assert language.identify(docs, model).count() == len(rows)


def test_quality_against_plain_algebra(spark):
    """Standardised statistics, ridge weights from all rows at once, isotonic means by their min-max form."""
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcXYZ.,1" if i % 3 else "abc", k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 60)))) for i in range(240)]
    rows += [(240, None), (241, ""), (242, "tie tie"), (243, "tie tie"), (244, "w " * 300_000)]
    labels = [(i, int((i % 3 > 0) ^ (rng.random() < 0.15))) for i, _ in rows if i != 241] + [(None, 1), (9999, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (241, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score_quality(docs, quality.train(docs, marks)).collect()}
    x = {i: quality.statistics(*next(SPACED.texts(pa.array([t], pa.string())))[1:]) for i, t in rows}
    y = {i: q for i, q in labels if i in x}
    held = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(quality.CALIBRATE)) == 0).collect()}
    own = np.array([x[i] for i in y])
    mean, deviation = own.mean(axis=0), own.std(axis=0)
    deviation[deviation <= 1e-6] = 1.0
    f = {i: quality.random_features(v[None, :], mean, deviation)[0] for i, v in x.items()}
    fit = [i for i in y if i not in held]
    a, b = np.array([f[i] for i in fit]), np.array([y[i] for i in fit], float)
    d = a.shape[1]
    # ridge as least squares with a row for each penalty
    roots = np.sqrt(np.append(np.full(d - 1, quality.PENALTY), 1e-6))
    weights = np.linalg.lstsq(np.vstack([a, np.diag(roots)]), np.append(b, np.zeros(d)), rcond=None)[0]
    steps = {}
    for i in y:
        if i in held:
            steps.setdefault(int(round(float(f[i] @ weights) / quality.STEP)), []).append(y[i])
    at = sorted(steps)
    total = lambda i, j: [q for s in at[i : j + 1] for q in steps[s]]
    values = [max(min(np.mean(total(i, j)) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    for i, v in f.items():
        want = float(np.interp(v @ weights, [s * quality.STEP for s in at], values))
        assert got[i] == pytest.approx(want, abs=2e-3), i


def test_quality_statistics_of_words():
    text = "Aa bb BB bb bb\nAa bb\nx"
    got = quality.statistics(*next(SPACED.texts(pa.array([text])))[1:])
    k = len(quality._CLASSES) + 1
    words = text.split()
    sizes = [len(w) for w in words]
    assert got[k : k + 3] == pytest.approx([np.log1p(8) / 4, np.mean(sizes) / 8, np.std(sizes) / 8])
    assert got[k + 3 :] == pytest.approx([np.log(3) / np.log(8), (3 / 7) ** 0.5, 5 / 8, (3 / 8) ** 0.5, (1 / 8) ** 0.5, 0.0])
    assert got[0] == pytest.approx((4 / len(text)) ** 0.5) and not quality.statistics(*next(SPACED.texts(pa.array([""])))[1:]).any()


def test_three_hundred_languages(spark):
    """Each label is learned and predicted, however many there are; a rare one too."""
    rng = np.random.default_rng(11)
    letter = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = []
    for k in range(300):
        words = ["".join(rng.choice(letter, rng.integers(3, 8))) for _ in range(12)]
        rows += [(" ".join(rng.choice(words, 15)), f"l{k:03}", i == 7) for i in range(8 if k else 40)]
    docs = spark.createDataFrame(rows, "text string, lang string, out boolean").repartition(8)
    model = language.train(docs.where("NOT out").select("text", "lang"))
    assert model.langs == [f"l{k:03}" for k in range(300)]
    found = language.identify(docs.where("out"), model).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.9 * len(found)
    assert len({r.lang_pred for r in found}) >= 270
