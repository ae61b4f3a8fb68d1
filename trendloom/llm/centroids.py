"""Centroid clustering of integer vectors by exponion search, exact to the last unit.

Each vector carries an upper bound of its distance to its own centroid and a lower bound of that to
any other. A round moves the centroids, widens the bounds by how far, and searches only vectors whose
bounds no longer part: among the centroids in a ball around their own one, read off its list of
neighbours sorted by distance. Bounds are whole numbers, rounded to the safe side; so a vector that
lies as near to another centroid is always searched, and its tie goes to the smaller number.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, remove, tidy, work_path

#: Clusters, rounds, components of a vector, units of a component, and what the start's hashes begin with.
CLUSTERS, ROUNDS, LENGTH, SCALE, SEED = 40, 5, 64, 256, "2"
#: Integers up to this leave every distance and product exact in doubles; a table with larger ones is
#: worked on in Python's integers.
EXACT = 1 << 22
#: Vectors of a block.
BLOCK = 8_192
_LONG = 1 << 63
#: A bound that no distance reaches: there is no other centroid.
_NONE = 1 << 61


class Numbers:
    """Integer matrices in doubles that are exact, or, where ``large``, in Python's integers."""

    def __init__(self, large: bool):
        self.large = large
        self.kind = object if large else np.float64

    def scaled(self, x: np.ndarray, scale: int) -> np.ndarray:
        """floor(scale * x) of finite doubles; beyond 2**52 doubles are whole numbers."""
        if not self.large:
            return np.floor(x * scale)
        exact = lambda v: int(v) * scale if abs(v) >= 1 << 52 else math.floor(v * scale)
        return np.array([[exact(float(v)) for v in row] for row in x], object).reshape(x.shape)

    def pack(self, x: np.ndarray) -> pa.Array:
        """A binary for each row."""
        if self.large:
            return pa.array([" ".join(map(str, row)).encode() for row in x.tolist()], pa.binary())
        offsets = np.arange(len(x) + 1, dtype=np.int32) * (4 * x.shape[1])
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.astype("<i4").tobytes())])

    def unpack(self, values: pa.Array, width: int) -> np.ndarray:
        if not self.large:
            return np.frombuffer(b"".join(values.to_pylist()), "<i4").reshape(-1, width).astype(np.float64)
        return np.array([[int(v) for v in x.split()] for x in values.to_pylist()], object).reshape(-1, width)

    def pack_bound(self, x: np.ndarray) -> pa.Array:
        """Longs; what is beyond becomes ``_NONE``: true of a lower bound, and of an upper one it says none is known."""
        return pa.array(np.minimum(x, _NONE).astype(np.int64))

    def unpack_bound(self, values: pa.Array, upper: bool) -> np.ndarray:
        x = values.to_numpy().astype(self.kind)
        if upper and self.large:
            x[x >= _NONE] = 1 << 2048
        return x

    def squared(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Squared distances of all rows of ``x`` to all of ``c``."""
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]

    def root(self, squares: np.ndarray, up: bool) -> np.ndarray:
        """Whole square roots, rounded up or down."""
        if self.large:
            ceil = lambda v: math.isqrt(v - 1) + 1 if v > 0 else 0
            return np.frompyfunc(ceil if up else math.isqrt, 1, 1)(squares)
        # the root of a whole number below 2**53 is within half a unit, so one step mends it
        r = np.floor(np.sqrt(squares))
        r -= r * r > squares
        r += (r + 1) * (r + 1) <= squares
        return r + (r * r < squares) if up else r


class Centroids:
    """Centroids with their distances to each other, each one's others sorted by distance."""

    def __init__(self, numbers: Numbers, points: np.ndarray):
        self.numbers, self.points = numbers, points
        k = len(points)
        squares = numbers.squared(points, points)
        down, up = numbers.root(squares, False), numbers.root(squares, True)
        self.order = np.array([sorted(range(k), key=lambda j: (down[i, j], j != i, j)) for i in range(k)], np.int64).reshape(k, k)
        self.reach = np.take_along_axis(down, self.order, axis=1)  # rounded down: nothing of the ball is left out
        nearest = [min((int(v) for j, v in enumerate(row) if j != i), default=_NONE) for i, row in enumerate(up)]
        floor = [min((int(v) for j, v in enumerate(row) if j != i), default=_NONE) for i, row in enumerate(down)]
        self.gap_up, self.gap_down = np.array(nearest, numbers.kind), np.array(floor, numbers.kind)

    def two_nearest(self, x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, squared distance, squared distance of the second) of each row's nearest of the
        centroids ``among``, ties to the smaller number; the second is ``None``'s where there is none."""
        among = np.sort(among)
        d = self.numbers.squared(x, self.points[among])
        rows, first = np.arange(len(x)), np.argmin(d, axis=1)
        best = d[rows, first]
        if len(among) == 1:
            return among[first], best, np.full(len(x), _NONE * _NONE if self.numbers.large else float(_NONE), self.numbers.kind)
        d[rows, first] = best + d.max() + 1
        return among[first], best, d.min(axis=1)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(own, upper, lower bound, scanned) by all centroids: the first round."""
        own, first, second = self.two_nearest(x, np.arange(len(self.points)))
        lower = self.numbers.root(second, False) if len(self.points) > 1 else np.full(len(x), _NONE, self.numbers.kind)
        return own, self.numbers.root(first, True), lower, len(x) * len(self.points)

    def exponion(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from bounds that hold: ``own``'s distance is at most ``upper``, others' at least ``lower``."""
        own, upper, lower = own.copy(), upper.copy(), lower.copy()
        scanned = 0

        def open_(some: np.ndarray) -> np.ndarray:
            # strictly less, so that a tie is searched
            return some[~((upper[some] < lower[some]) | (2 * upper[some] < self.gap_down[own[some]])).astype(bool)]

        left = open_(np.arange(len(x)))
        if len(left):
            away = x[left] - self.points[own[left]]
            upper[left] = self.numbers.root((away * away).sum(axis=1), True)
            scanned += len(left)
            left = open_(left)
        for c in np.unique(own[left]):
            group = left[own[left] == c]
            # whatever is as near as the own centroid, and the second nearest, lie within the ball
            radius = 2 * upper[group] + self.gap_up[c]
            count = np.searchsorted(self.reach[c], radius, "right")
            # shells of twice as many centroids each, so that a block does about what its vectors need
            shell = 1 << np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
            for size in np.unique(shell):
                some = group[shell == size]
                among = self.order[c, : min(int(size), len(self.points))]
                own[some], first, second = self.two_nearest(x[some], among)
                upper[some] = self.numbers.root(first, True)
                if len(among) > 1:
                    lower[some] = self.numbers.root(second, False)
                scanned += len(some) * len(among)
        return own, upper, lower, scanned


def whole_vectors(vectors: DataFrame, length: int, scale: int) -> tuple[DataFrame, Numbers]:
    """(vec_id, v): vectors of exactly ``length`` finite components as packed integers floor(scale * x)."""
    listed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    listed = listed.where((F.size("v") == length) & F.coalesce(sound, F.lit(False)))
    greatest = listed.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    numbers = Numbers(greatest * scale > EXACT - 1)

    def pack(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            yield pa.RecordBatch.from_arrays([b.column(0), numbers.pack(numbers.scaled(x, scale))], ["vec_id", "v"])

    return materialize(listed.mapInArrow(pack, "vec_id long, v binary"), "centroid-vectors"), numbers


def starts(rows: DataFrame, clusters: int, seed: str) -> DataFrame:
    """The ``clusters`` vectors whose ``seed:vec_id`` hash least, in that order; repeated ids by their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return rows.select(key.alias("hash"), "v").orderBy(F.col("hash").asc_nulls_last(), "v").limit(clusters)


STATE = "vec_id long, v binary, own int, upper long, lower long, scanned long, part binary"


def _round(rows: DataFrame, numbers: Numbers, old: Centroids | None, new: Centroids, length: int) -> DataFrame:
    """``STATE`` after one assignment: a row for each vector, and one for each task with ``part``, its
    sums, counts and distances by centroid. ``old`` is what the bounds in ``rows`` are about."""
    spark, k = rows.sparkSession, len(new.points)
    moved = None
    if old is not None:
        away = new.points - old.points
        moved = numbers.root((away * away).sum(axis=1), True)
        order = np.argsort(-moved, kind="stable")
        others = np.full(k, moved[order[0]], numbers.kind)  # how far any other centroid has moved at most
        others[order[0]] = moved[order[1]] if k > 1 else 0
    else:
        others = None
    shared = spark.sparkContext.broadcast((numbers, new, moved, others))
    names = [f.split()[0] for f in STATE.split(", ")]

    def step(batches):
        numbers, new, moved, others = shared.value
        sums, counts, inertia = np.zeros((k, length), object), np.zeros(k, object), np.zeros(k, object)
        seen = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                x = numbers.unpack(b.column(1), length)
                if moved is None:
                    own, upper, lower, scanned = new.assign(x)
                else:
                    own = b.column(2).to_numpy()
                    upper, lower = numbers.unpack_bound(b.column(3), True), numbers.unpack_bound(b.column(4), False)
                    own, upper, lower, scanned = new.exponion(x, own, upper + moved[own], np.maximum(lower - others[own], 0))
                away = x - new.points[own]
                distance = (away * away).sum(axis=1)
                for c in np.unique(own):
                    mine = own == c
                    # a block's sums are exact in either kind, tasks' sums are Python's integers
                    sums[c] += np.array([int(v) for v in x[mine].sum(axis=0)], object)
                    counts[c] += int(mine.sum())
                    inertia[c] += int(distance[mine].sum())
                scans = np.zeros(len(x), np.int64)
                scans[0] = scanned
                bounds = numbers.pack_bound(upper), numbers.pack_bound(lower)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), *bounds, pa.array(scans), pa.nulls(len(x), pa.binary())], names)
                seen += len(x)
        if seen:
            part = " ".join(map(str, [*sums.ravel(), *counts, *inertia])).encode()
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, kind) for kind in kinds], pa.array([part], pa.binary())], names)

    return rows.mapInArrow(step, STATE)


def _totals(state: DataFrame, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, counts and distances by centroid; tasks' parts are added on the executors first."""

    def add(batches):
        total = None
        for b in batches:
            for x in b.column(0):
                own = np.array([int(v) for v in x.as_py().split()], object)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, total)).encode()], pa.binary())], ["part"])

    parts = state.where("part IS NOT NULL").select("part")
    tasks = max(1, int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = np.zeros(k * (length + 2), object)
    for row in parts.repartition(tasks).mapInArrow(add, "part binary").repartition(4).mapInArrow(add, "part binary").collect():
        total += np.array([int(v) for v in bytes(row.part).split()], object)
    return total[: k * length].reshape(k, length), total[k * length : k * (length + 1)], total[k * (length + 1) :]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector.

    Takes rows (vec_id, embedding) of exactly ``length`` components, none null or non-finite, as
    integers floor(scale * x); others are left out. Centroids start as the ``clusters`` vectors of
    the least sha256 of ``seed:vec_id``, fewer if there are fewer vectors. Each round assigns every
    vector to its nearest centroid, ties to the smaller number, and sets each centroid that has
    vectors to the floor of their mean; then vectors are assigned once more. Repeated rows are
    vectors each; a null vec_id comes last among the starts and stays in the result. Distances are
    squared; one beyond a long is null, as is such a sum. An empty table gives no rows. Other columns
    don't matter.
    """
    spark = vectors.sparkSession
    rows, numbers = whole_vectors(vectors, length, scale)
    first = pa.array([bytes(r.v) for r in starts(rows, clusters, seed).collect()], pa.binary())
    if not len(first):
        return spark.createDataFrame([], RESULT)
    now, old, k, path, state = Centroids(numbers, numbers.unpack(first, length)), None, len(first), None, rows
    for turn in range(rounds + 1):
        last, path = path, work_path(spark, "centroid-state")
        _round(state, numbers, old, now, length).write.parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        if last:
            remove(spark, last)
        sums, counts, inertia = _totals(state, k, length)
        state = state.where("part IS NULL")
        if turn < rounds:
            moved = [[int(s) // int(n) for s in row] if n else [int(v) for v in was] for row, n, was in zip(sums, counts, now.points, strict=True)]
            old, now = now, Centroids(numbers, np.array(moved, numbers.kind).reshape(k, length))
    shas = [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in now.points]
    as_long = lambda v: int(v) if v < _LONG else None
    inertias, total = [as_long(v) for v in inertia], as_long(sum(inertia))
    shared = spark.sparkContext.broadcast((numbers, now.points))

    def measure(batches):
        numbers, points = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                own = b.column(2).to_numpy()
                away = numbers.unpack(b.column(1), length) - points[own]
                d = pa.array([as_long(v) for v in (away * away).sum(axis=1)], pa.int64())
                mine = own.tolist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), d, pa.array([inertias[c] for c in mine], pa.int64()), pa.array([total] * len(mine), pa.int64()), pa.array([shas[c] for c in mine])],
                    [f.split()[0] for f in RESULT.split(", ")],
                )

    return state.mapInArrow(measure, RESULT)


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


@tidy
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds one after the other, each vector against all centroids."""
    gap = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {LENGTH} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v LIMIT {CLUSTERS})""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT row_id, least % {CLUSTERS} AS c, least // {CLUSTERS} AS d FROM (SELECT k.row_id, min({gap} * {CLUSTERS} + c.c) AS least FROM kept k, c{i} c GROUP BY k.row_id))""")
        if i < ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN (
    SELECT c, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY place) AS v FROM (
      SELECT a.c, t.place, sum(k.v[t.place]) AS s, count(*) AS n FROM kept k JOIN a{i} a USING (row_id), range(1, {LENGTH + 1}) t(place) GROUP BY a.c, t.place) GROUP BY c) n USING (c))""")
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM kept k JOIN a{ROUNDS} a USING (row_id) JOIN c{ROUNDS} f ON f.c = a.c"""
    )


SQL = _sql()
