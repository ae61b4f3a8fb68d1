"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, id_fold, materialize, read, summed, tidy

#: Random features; width of the Gaussian kernel over standardised statistics; ridge penalty.
FEATURES, WIDTH, PENALTY = 384, 4.0, 1.0
#: At most this many labelled rows are learned from, those of the least hashed ids.
LABELLED = 20_000
#: Every fourth labelled row calibrates, the others fit.
CALIBRATE = 4
#: Scores are calibrated in steps of this size at the finest.
STEP = 0.002
#: A document counts as good from this score.
GOOD = 0.7

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"#$%&*@^~", b"|<>[]{}\\_=+/", b"'\"()-"]
_KIND = np.full(256, len(_CLASSES), np.int64)
for _i, _c in enumerate(_CLASSES):
    _KIND[list(_c)] = _i
#: Number of statistics.
STATS = len(_CLASSES) + 1 + 9


def statistics(words: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Statistics of one whole text; an empty one has all at 0.

    Roots of the shares of kinds of bytes, and: length, mean and deviation of word lengths, shares of
    distinct words, of words like the one before, of the commonest word, of capitalised and of
    all-capital words, and of lines like an earlier one.
    """
    out = np.zeros(STATS)
    if not len(words):
        return out
    k = len(_CLASSES) + 1
    out[:k] = np.sqrt(np.bincount(_KIND[data], minlength=k) / len(data))
    size = end - start
    _, counts = np.unique(words, return_counts=True)
    upper = np.concatenate([[0], np.cumsum(_KIND[data] == 0)])
    capitals = upper[end] - upper[start]
    breaks = np.flatnonzero(data == 10)
    lines = np.searchsorted(start, breaks)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words)])
    sums = np.diff(prefix[np.concatenate([[0], lines, [len(words)]])])
    out[k:] = [
        np.log1p(len(words)) / 4, size.mean() / 8, size.std() / 8, np.log(len(counts)) / max(np.log(len(words)), 1),
        np.sqrt((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0, counts.max() / len(words),
        np.sqrt((capitals > 0).mean()), np.sqrt(((capitals > 1) & (2 * capitals >= size)).mean()), 1 - len(np.unique(sums)) / len(sums),
    ]
    return out


def random_features(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """cos(w x + b) for Gaussian w and uniform b, and a constant; far outliers are held at 6 deviations."""
    rng = np.random.default_rng(2007)
    w = rng.normal(0, 1 / WIDTH, (STATS, FEATURES))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / deviation, -6, 6)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])


def _stats_of(column: pa.Array) -> np.ndarray:
    return np.array([statistics(*rest) for _, *rest in SPACED.texts(column)]).reshape(-1, STATS)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (points, values), values never falling; x ascending."""
    blocks: list[list[float]] = []
    for a, v, w in zip(x, y, weight, strict=True):
        blocks.append([v, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _, hi = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + v2 * w2) / (b[1] + w2), b[1] + w2, hi
    points = [p for b in blocks for p in (b[2], b[3])]
    return np.array(points), np.array([v for b in blocks for v in (b[0], b[0])])


class Model:
    def __init__(self, mean, deviation, weights, points, values):
        self.mean, self.deviation, self.weights, self.points, self.values = mean, deviation, weights, points, values

    def raw(self, x: np.ndarray) -> np.ndarray:
        return random_features(x, self.mean, self.deviation) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.points, self.values), 0, 1) if len(self.points) else np.full(len(x), 0.5)


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """Fits on ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) marks 0 or 1.

    At most ``most`` labels are taken, so that they can be broadcast; documents meet them in place.
    Tasks sum their normal equations; only sums, whose size the features fix, reach the driver.
    Null ids and labels don't count. Without labels of both kinds every score is the labels' mean,
    or 0.5.
    """
    chosen = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("text", "y", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(CALIBRATE)) == 0).alias("calibrate"))

    def measure(batches):
        for b in batches:
            x = _stats_of(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1), b.column(2)], ["x", "y", "calibrate"])

    measured = materialize(rows.mapInArrow(measure, "x binary, y double, calibrate boolean"), "quality-stats")
    matrix = lambda b: np.frombuffer(b"".join(b.column(0).to_pylist()), np.float64).reshape(-1, STATS)

    def moments(batches):
        total = np.zeros(2 * STATS + 2)
        for b in batches:
            x = matrix(b)
            total += np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x), np.sum(b.column(1).to_numpy(zero_copy_only=False))]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])

    total = summed(measured.mapInArrow(moments, "part binary"), 2 * STATS + 2)
    n, share = total[-2], total[-1] / max(total[-2], 1)
    if not 0 < share < 1:
        return Model(np.zeros(STATS), np.ones(STATS), np.zeros(FEATURES + 1), np.array([0.0]), np.array([share if n else 0.5]))
    mean = total[:STATS] / n
    deviation = np.sqrt(np.maximum(total[STATS : 2 * STATS] / n - mean**2, 0))
    deviation = np.where(deviation > 1e-6, deviation, 1.0)
    d = FEATURES + 1

    def equations(batches):
        total = np.zeros(d * d + d)
        for b in batches:
            f = random_features(matrix(b), mean, deviation)
            total += np.concatenate([(f.T @ f).ravel(), f.T @ b.column(1).to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])

    total = summed(measured.where("NOT calibrate").mapInArrow(equations, "part binary"), d * d + d)
    penalty = PENALTY * np.eye(d)
    penalty[-1, -1] = 1e-6
    weights = np.linalg.solve(total[: d * d].reshape(d, d) + penalty, total[d * d :])
    model = Model(mean, deviation, weights, np.zeros(0), np.zeros(0))

    def raw(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.round(model.raw(matrix(b)) / STEP), -1000, 1500).astype(np.int32)), b.column(1)], ["step", "y"])

    # a few thousand steps at most
    steps = measured.where("calibrate").mapInArrow(raw, "step int, y double").groupBy("step").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("step").collect()
    model.points, model.values = isotonic(np.array([r.step * STEP for r in steps]), np.array([r.y for r in steps]), np.array([r.n for r in steps], float))
    return model


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text); null texts count as empty ones.

    Whole texts are measured. Repeated rows each give a row, null ids too; an empty table gives
    none. Other columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(_stats_of(b.column(1))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(step, "doc_id long, score double")


@tidy
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(id_fold("doc_id", 4) != 2)
    scored = score_quality(docs, train(docs, labels))
    return scored.select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), F.round("score", 6).alias("score"), (F.round("score", 6) >= GOOD).cast("int").alias("predicted"))
