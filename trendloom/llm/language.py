"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

Weights are sparse: follow-the-regularised-leader with elastic-net penalties; a temperature then
calibrates the shares.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_fold, materialize, read, summed, tidy

#: n-grams of 1 to ORDER characters are hashed into so many buckets.
ORDER, BITS = 3, 15
BUCKETS = 1 << BITS
#: Follow the regularised leader: learning rate and its offset, L1 and L2 penalties, passes.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 1e-4, 2
#: At most so many different labelled texts are learned from, those of the least hashes, shared out evenly
#: among the languages, but at least one of each. Every language is learned; a task's state has a column for each, of 0.5 MB.
LABELLED = 6_000
#: Numbers of a chunk in which tasks send what they changed.
CHUNK = 1 << 17
#: Every fifth of them sets the temperature.
CALIBRATE = 5
#: Shards that learn side by side in a pass; their states are averaged after it.
SHARDS = 4
UNKNOWN = "und"
PIECE = 1 << 18

_letters: np.ndarray | None = None
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def count_grams(text: str | None) -> np.ndarray | None:
    """Counts of the n-grams of a whole text by bucket; None without a letter.

    Lower-cased; runs of anything but letters are one space, and so are both ends.
    """
    if not text:
        return None
    total, any_letter, table = np.zeros(BUCKETS, np.int64), False, letters()
    tail = np.array([32], np.uint32)  # the last characters of the piece before
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE].lower()
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = table[code]
        any_letter |= bool(is_letter.any())
        code = np.where(is_letter, code, np.uint32(32))
        if at + PIECE >= len(text):
            code = np.append(code, np.uint32(32))
        code = np.concatenate([tail, code])
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
        keep[: len(tail)] = True
        code = code[keep]
        h = np.zeros(len(code), np.uint32)
        for n in range(1, ORDER + 1):
            if len(code) < n:
                break
            # h[i] covers the n characters that end at i; those that end in the tail were counted before
            h = (np.concatenate([[np.uint32(0)], h[:-1]]) if n > 1 else h) * _FACTORS[1] + code * _FACTORS[0] + np.uint32(n)
            mixed = h ^ (h >> np.uint32(15))
            mixed = mixed * _FACTORS[2]
            own = mixed[max(n - 1, len(tail)) :]
            total += np.bincount(own >> np.uint32(32 - BITS), minlength=BUCKETS)
        tail = code[-(ORDER - 1) :]
    return total if any_letter else None


def _gram_counts(column: pa.Array):
    for x in column:
        yield count_grams(x.as_py())


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader's weights; most are exactly 0."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """Languages, inverse document frequencies, weights (buckets by languages) and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the TF-IDF vector, of length 1."""
        at = np.flatnonzero(counts)
        v = np.log1p(counts[at]) * self.idf[at]
        return at, v / max(np.sqrt(v @ v), 1e-12)

    def predict(self, counts: np.ndarray | None) -> tuple[str, float]:
        if counts is None or not self.langs:
            return UNKNOWN, 0.0
        at, v = self.vector(counts)
        p = softmax(v @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _sum(parts: pa.Table) -> pa.Table:
    """The sum of a chunk's changes, one row of at most each shard."""
    total = sum(np.frombuffer(x.as_buffer()) for x in parts.column("part"))
    return pa.table({"at": parts.column("at").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, labelled: int = LABELLED, languages: int | None = None) -> Model:
    """Learns from ``docs`` (text, lang) with a non-null lang and a letter in the text.

    Document frequencies cover all of them. The classifier learns all labels, or the ``languages`` commonest if that is given,
    from at most ``labelled`` different texts, an equal number of each language at most, in ``SHARDS``
    shards; what leaves a task is what it changed of its state, chunk by chunk, which the buckets and languages bound. Copies of a
    text count once. Without such documents the model knows no language.
    """
    spark = docs.sparkSession
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    by_lang = rows.groupBy("lang").count()
    langs = sorted(r.lang for r in (by_lang if languages is None else by_lang.orderBy(F.desc("count"), "lang").limit(languages)).collect())
    if not langs:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), 1.0)
    size = len(langs)

    def frequencies(batches):
        seen = np.zeros(BUCKETS + 1)
        for b in batches:
            for counts in _gram_counts(b.column(0)):
                if counts is not None:
                    seen[:-1] += counts > 0
                    seen[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()])], ["part"])

    seen = summed(rows.select("text").mapInArrow(frequencies, "part binary"), BUCKETS + 1)
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    model = Model(langs, idf, np.zeros((BUCKETS, size)), 1.0)

    keyed = rows.where(F.col("lang").isin(langs)).withColumn("key", F.xxhash64("text", "lang"))
    # Spark limits each task's rows of a language before it sorts them
    least = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    keys = keyed.select("lang", "key").distinct().withColumn("n", least).where(F.col("n") <= max(1, labelled // size)).select("key", "lang")
    chosen = keyed.join(F.broadcast(keys), ["key", "lang"]).groupBy("key", "lang").agg(F.any_value("text").alias("text")).select("text", "lang", "key")
    place = {lang: i for i, lang in enumerate(langs)}

    def vectors(batches):
        for b in batches:
            out = []
            for counts, lang, key in zip(_gram_counts(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if counts is not None:
                    at, v = model.vector(counts)
                    out.append((key, place[lang], at.astype("<i4").tobytes(), v.astype("<f4").tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["key", "y", "at", "v"])

    data = materialize(chosen.mapInArrow(vectors, "key long, y int, at binary, v binary").withColumn("calibrate", F.pmod("key", F.lit(CALIBRATE)) == 0), "lang-vectors")
    fit = data.where("NOT calibrate").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(SHARDS)).cast("int"))
    z, n = np.zeros((BUCKETS, size)), np.zeros((BUCKETS, size))
    step = max(1, CHUNK // size)
    for _ in range(EPOCHS):
        state = spark.sparkContext.broadcast((z, n))

        def learn(batches, state=state):
            z, n = (x.copy() for x in state.value)
            used, changed = 0, np.zeros(BUCKETS, bool)
            for b in batches:
                for y, at, v in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                    at, v = np.frombuffer(at.as_buffer(), "<i4"), np.frombuffer(v.as_buffer(), "<f4").astype(np.float64)
                    zi, ni = z[at], n[at]
                    w = weights_of(zi, ni)
                    p = softmax(v @ w)
                    p[y] -= 1
                    g = v[:, None] * p[None, :]
                    more = ni + g * g
                    z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
                    n[at] = more
                    changed[at] = True
                    used += 1
            if used:
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([np.ones(1).tobytes()])], ["at", "part"])
            for at in range(0, BUCKETS, step):
                if changed[at : at + step].any():
                    own = np.stack([z[at : at + step] - state.value[0][at : at + step], n[at : at + step] - state.value[1][at : at + step]])
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([own.tobytes()])], ["at", "part"])

        shards = fit.repartitionByRange(SHARDS, "shard").sortWithinPartitions(F.xxhash64("key", F.lit(9)), "y").select("y", "at", "v")
        parts = shards.mapInArrow(learn, "at long, part binary").groupBy("at").applyInArrow(_sum, "at long, part binary").collect()
        state.unpersist()
        tasks = sum(np.frombuffer(r.part)[0] for r in parts if r.at < 0)
        for r in parts:
            if r.at >= 0:
                dz, dn = np.frombuffer(r.part).reshape(2, -1, size) / tasks
                z[r.at : r.at + step] += dz
                n[r.at : r.at + step] += dn
    model.weights = weights_of(z, n)

    def losses(batches):
        out = np.zeros(len(TEMPERATURES))
        for b in batches:
            for y, at, v in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                x = np.frombuffer(v.as_buffer(), "<f4").astype(np.float64) @ model.weights[np.frombuffer(at.as_buffer(), "<i4")]
                out -= np.log(np.maximum(softmax(x[None, :] / TEMPERATURES[:, None])[:, y], 1e-12))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["part"])

    loss = summed(data.where("calibrate").select("y", "at", "v").mapInArrow(losses, "part binary"), len(TEMPERATURES))
    model.temperature = float(TEMPERATURES[loss.argmin()]) if loss.any() else 1.0
    return model


#: Temperatures that calibration chooses among.
TEMPERATURES = np.geomspace(0.02, 5, 60)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` from the whole ``text``.

    ``und`` with score 0 if the text is null or has no letter, or the model knows no language.
    Repeated rows and nulls elsewhere don't matter; an empty table gives no rows. Columns of these
    two names in the input are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("lang_pred", "lang_score")
    kept = rest.schema.names
    text = kept.index("text")

    def step(batches):
        for b in batches:
            out = [shared.value.predict(c) for c in _gram_counts(b.column(text))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], [*kept, "lang_pred", "lang_score"])

    schema = type(rest.schema)([*rest.schema.fields]).add("lang_pred", "string").add("lang_score", "double")
    return rest.mapInArrow(step, schema)


@tidy
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(id_fold("doc_id", 3) != 1).select("text", "lang"))
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return found.select("doc_id", (id_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.round("lang_score", 6).alias("score"))
