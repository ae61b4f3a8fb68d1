"""Nearest neighbours against all pairs."""

import numpy as np

from trendloom.llm import neighbours


def plain(rows, k, every):
    def sound(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and sound(v)]
    queries = {}
    for i, v in ok:
        if i % every == 0 and (i not in queries or tuple(v) < tuple(queries[i])):
            queries[i] = v
    out = {}
    for i, q in queries.items():
        best = {}
        for j, v in ok:
            if j != i and len(v) == len(q):
                best[j] = max(best.get(j, -2), float(q @ v / (np.sqrt(q @ q) * np.sqrt(v @ v))))
        out[i] = sorted(((-round(s, 12), j) for j, s in best.items()))[:k]
    return out


def as_dict(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS shard", "2 AS rank", "3 AS v")


def test_exact_at_factor_one(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(700)]
    hot = rows[5][1]
    rows += [(1000 + i, hot) for i in range(60)] + [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [None] + [1.0] * 7), (2050, [float("nan")] * 8), (2051, [float("inf")] + [0.0] * 7), (None, hot)]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3002, [-1.0, 0.0]), (10, rows[11][1]), (10, rows[12][1]), *rows[:40], (13, rows[14][1])]
    got = as_dict(neighbours.nearest(table(spark, rows), every=10, factor=1.0, shard=200, block=50))
    want = plain(rows, 5, 10)
    assert got.keys() == {q for q in want if want[q]}
    for q in got:
        assert [s for s, _ in got[q]] == [s for s, _ in want[q]], q
        assert got[q] == want[q] or len(got[q][0]) != 2


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(10, 32))
    data = (centers[rng.integers(0, 10, 4000)] + rng.normal(size=(4000, 32))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    got = as_dict(neighbours.nearest(table(spark, rows), shard=1500))
    want = plain(rows, 5, 50)
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95


def test_ties_go_to_the_least_ids(spark):
    """Vectors of one direction and different lengths, and different vectors at one cosine."""
    scaled = [(i, [float(1 + (i * 37) % 61), 2.0 * (1 + (i * 37) % 61), 0.0]) for i in range(60)]
    got = as_dict(neighbours.nearest(table(spark, scaled)))
    assert [j for _, j in got[50]] == [0, 1, 2, 3, 4] and [j for _, j in got[0]] == [1, 2, 3, 4, 5]
    axes = [(i, [float(j == i % 300) for j in range(300)]) for i in range(299, -1, -1)]
    for factor in (1.0, neighbours.FACTOR):
        got = as_dict(neighbours.nearest(table(spark, axes), factor=factor, shard=60, block=2))
        assert {q: [j for _, j in x] for q, x in got.items()} == {q: [j for j in range(6) if j != q][:5] for q in range(0, 300, 50)}


def test_large_doubles(spark):
    rows = [(0, [1e308, 1e308]), (1, [1e-300, 1e-300]), (2, [1e308, -1e308]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = as_dict(neighbours.nearest(df))
    assert [j for _, j in got[0]] == [1, 3, 2] and [round(-s, 6) for s, _ in got[0]] == [1.0, 0.707107, 0.0]


def test_recall_on_the_table(spark):
    from trendloom.llm.common import read

    df = read(spark, "/root/testdata/sf0.1", "embeddings")
    want = plain([(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()], 5, 50)
    for shard in (16_000, 300):
        got = as_dict(neighbours.nearest(df, shard=shard))
        assert sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want) >= 0.95 * 5 * len(want)


def test_one_hot_direction(spark):
    """A third of all rows in one direction, more than a shard's worth; nobody loses a neighbour."""
    rng = np.random.default_rng(8)
    data = [(i, rng.normal(size=6).tolist()) for i in range(600)] + [(1000 + i, [float(1 + i % 7)] * 6) for i in range(300)]
    got = as_dict(neighbours.nearest(table(spark, data), factor=1.0, shard=40, block=3))
    want = plain([(i, np.float32(v)) for i, v in data], 5, 50)
    assert {q: [j for _, j in x] for q, x in got.items()} == {q: [j for _, j in x] for q, x in want.items()}


def test_empty(spark):
    assert neighbours.nearest(table(spark, [])).count() == 0
    assert neighbours.nearest(table(spark, [(0, [1.0, 2.0])])).count() == 0
