"""Approximate nearest neighbours by cosine: vantage-point trees per shard.

A coarse vantage-point tree, fitted on a bounded sample, deals vectors into shards; each shard has a
tree of its own. Queries search their own shard first. How far their k-th nearest is there bounds
which other shards the triangle inequality, relaxed by a factor, still lets them visit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, tidy

#: Neighbours of a query; every how many-th vector is a query.
K, EVERY = 5, 50
#: Vectors of a shard and queries of a block, at most about so many; both bound a task's memory.
SHARD, BLOCK = 16_000, 4_000
#: The coarse tree is fitted on so many vectors, those of the least hashes, and has a leaf for every
#: so many of them at the most.
SAMPLE, PER_LEAF = 8_000, 16
#: Vectors of a leaf of a shard's tree.
LEAF = 128
#: How far the triangle inequality's margin is relaxed; 1 prunes nothing that could be nearer.
FACTOR = 4.0
#: Cosines that differ by less than this are ties, as rounding alone tells them apart.
TIE = 1e-12
#: Distances of unit vectors are true to this.
SLACK = 1e-7
_FAR = np.iinfo(np.int64).max


class Tree:
    """A vantage-point tree over unit vectors, by Euclidean distance (which orders as cosine does)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.nodes: list[tuple] = []
        self._build(np.arange(len(points)), leaf, np.random.default_rng(1))

    def _build(self, own: np.ndarray, leaf: int, rng) -> int:
        """Nodes are (members, None) or (vantage point, low, high, inner, outer); both sides get half."""
        me = len(self.nodes)
        self.nodes.append(())
        if len(own) <= leaf:
            self.nodes[me] = (own, None)
            return me
        vantage = self.points[rng.choice(own)]
        far = _distances(self.points[own], vantage[None, :])[:, 0]
        order = np.argsort(far, kind="stable")
        half = len(own) // 2
        inner, outer = own[order[:half]], own[order[half:]]
        low, high = float(far[order[half - 1]]), float(far[order[half]])
        self.nodes[me] = (vantage, low, high, self._build(inner, leaf, rng), self._build(outer, leaf, rng))
        return me

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> np.ndarray:
        """Places of ``k`` nearest points of each query (-1: none), ``own`` being left out; of ties the least places.

        Queries go down together; a side is left out for those whose margin, times ``factor``, is
        more than the distance of their k-th nearest so far.
        """
        count = len(self.points)
        best = np.full((len(queries), k), _FAR)  # cosine's distance from 1 in steps of TIE, then place, as one number

        def visit(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            at = self.nodes[node]
            if at[1] is None:
                for i in range(0, len(who), 512):
                    q = who[i : i + 512]
                    key = np.rint(np.maximum(1 - queries[q] @ self.points[at[0]].T, 0) / TIE).astype(np.int64) * count + at[0][None, :]
                    key[at[0][None, :] == own[q][:, None]] = _FAR
                    best[q] = np.partition(np.hstack([best[q], key]), k - 1, axis=1)[:, :k]
                return
            vantage, low, high, inner, outer = at
            d = _distances(queries[who], vantage[None, :])[:, 0]
            near_inner = 2 * d < low + high

            def worth(some: np.ndarray, margin: np.ndarray) -> np.ndarray:
                last = best[some].max(axis=1)
                reach = np.where(last == _FAR, np.inf, np.sqrt(2 * TIE * (last // count)))
                return some[factor * np.maximum(margin, 0) <= reach + SLACK]

            # the nearer side first, so that the other is often not worth it
            visit(inner, who[near_inner])
            visit(outer, who[~near_inner])
            visit(outer, worth(who[near_inner], (high - d)[near_inner]))
            visit(inner, worth(who[~near_inner], (d - low)[~near_inner]))

        visit(0, np.arange(len(queries)))
        return np.where(best == _FAR, -1, np.sort(best, axis=1) % count)


class Router:
    """A coarse tree: nodes are (vantage point, radius, inner, outer); leaves are shards' numbers."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.leaves = 0
        self.top = self._build(sample, leaves, np.random.default_rng(2))

    def _build(self, own: np.ndarray, leaves: int, rng):
        if leaves < 2 or len(own) < 2 * PER_LEAF:
            self.leaves += 1
            return self.leaves - 1
        vantage = own[rng.integers(len(own))]
        far = _distances(own, vantage[None, :])[:, 0]
        radius = float(np.median(far))
        inner = far <= radius
        if inner.all():
            self.leaves += 1
            return self.leaves - 1
        return vantage, radius, self._build(own[inner], leaves // 2, rng), self._build(own[~inner], leaves - leaves // 2, rng)

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int32)

        def go(node, who: np.ndarray) -> None:
            if isinstance(node, int):
                out[who] = node
            elif len(who):
                inner = _distances(points[who], node[0][None, :])[:, 0] <= node[1]
                go(node[2], who[inner])
                go(node[3], who[~inner])

        go(self.top, np.arange(len(points)))
        return out

    def visits(self, queries: np.ndarray, reach: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf): the leaves that may hold something within ``reach`` of a query."""
        found: list[tuple[np.ndarray, int]] = []

        def go(node, who: np.ndarray) -> None:
            if isinstance(node, int):
                found.append((who, node))
            elif len(who):
                margin = _distances(queries[who], node[0][None, :])[:, 0] - node[1]
                go(node[2], who[factor * np.maximum(margin, 0) <= reach[who] + SLACK])
                go(node[3], who[factor * np.maximum(-margin, 0) <= reach[who] + SLACK])

        go(self.top, np.arange(len(queries)))
        return np.concatenate([w for w, _ in found]), np.concatenate([np.full(len(w), n, np.int32) for w, n in found])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _stack(column: pd.Series) -> np.ndarray:
    """Rows of finite doubles, scaled by powers of two to below 1, which changes no cosine and overflows nowhere."""
    x = np.array(column.tolist(), np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_routers(rows: DataFrame, shard: int) -> dict[int, Router]:
    """A coarse tree for each length of vectors that needs more than one shard, from ``SAMPLE`` rows at most."""
    leaves = max(1, 2 * rows.count() // shard)
    if leaves < 2:
        return {}
    some = rows.select("length", "v").orderBy(F.xxhash64("v")).limit(SAMPLE).toPandas()
    out = {int(n): Router(_unit(_stack(part["v"])), min(leaves, len(part) // PER_LEAF)) for n, part in some.groupby("length")}
    return {n: r for n, r in out.items() if r.leaves > 1}


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest vectors of each query.

    Queries are the rows of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``. Every
    vector is in one shard. The score is the cosine of the original vectors in double precision;
    scores within ``TIE`` are ties, which go to the smaller vec_id.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do
    null ids. Vectors of different lengths aren't compared. Rows of one vec_id are one candidate,
    with its best score, and one query, with its least vector; they aren't each other's candidates.
    A query with fewer candidates gets all. Other columns don't matter.
    """
    spark = vectors.sparkSession
    double = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), double.alias("v"))
    # a null component leaves SQL's forall unknown, so each test is made definite
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = materialize(rows.withColumn("length", F.size("v")), "nn-vectors")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("length", "v")).alias("q"))
    queries = materialize(queries.select("vec_id", "q.length", "q.v"), "nn-queries")
    # Of vectors of one direction only the k + 1 least ids can be among anyone's neighbours: all tie.
    greatest = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("direction", F.transform("v", lambda x: F.round(x / greatest, 14))).dropDuplicates(["vec_id", "direction"])
    least = F.row_number().over(Window.partitionBy("direction").orderBy("vec_id"))
    rows = materialize(rows.withColumn("n", least).where(F.col("n") <= k + 1).select("vec_id", "length", "v"), "nn-candidates")
    routers = spark.sparkContext.broadcast(fit_routers(rows, shard))

    def settle(batches):
        for pdf in batches:
            leaf = np.zeros(len(pdf), np.int32)
            for n, r in routers.value.items():
                own = np.flatnonzero(pdf["length"] == n)
                if len(own):
                    leaf[own] = r.home(_unit(_stack(pdf["v"].iloc[own])))
            yield pdf.assign(leaf=leaf)

    points = materialize(rows.mapInPandas(settle, "vec_id long, length int, v array<double>, leaf int"), "nn-points")
    parts = points.groupBy("length", "leaf").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"))
    parts = materialize(parts, "nn-shards")

    def found_in(asked: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of each query's best in the shards of its leaf; ``asked`` has vec_id, length, v, leaf."""
        asked = asked.join(parts, ["length", "leaf"])
        blocks = asked.groupBy("length", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.first("parts").alias("parts"))
        dealt = lambda n, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.col(n)).cast("int")
        every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        have = points.join(blocks, ["length", "leaf"]).select("vec_id", "v", "length", "leaf", dealt("parts", 1).alias("part"), every_one("blocks").alias("block"), F.lit(False).alias("query"))
        ask = asked.drop("parts").join(blocks, ["length", "leaf"]).select("vec_id", "v", "length", "leaf", every_one("parts").alias("part"), dealt("blocks", 2).alias("block"), F.lit(True).alias("query"))
        return have.unionByName(ask).groupBy("length", "leaf", "part", "block").applyInPandas(search, "query_id long, vec_id long, score double")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, have = pdf[pdf["query"]], pdf[~pdf["query"]].sort_values("vec_id", kind="stable")
        if ask.empty or have.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, data, q_ids, q_data = have["vec_id"].to_numpy(), _stack(have["v"]), ask["vec_id"].to_numpy(), _stack(ask["v"])
        unit, q_unit = _unit(data), _unit(q_data)
        # one tree per repetition, so that each id occurs once in a tree
        turn = have.groupby("vec_id").cumcount().to_numpy()
        out = []
        for t in range(turn.max() + 1):
            mine = np.flatnonzero(turn == t)
            own = np.minimum(np.searchsorted(ids[mine], q_ids), len(mine) - 1)
            own = np.where(ids[mine][own] == q_ids, own, -2)
            places = Tree(unit[mine]).search(q_unit, own, k, factor)
            who, col = np.nonzero(places >= 0)
            hit = mine[places[who, col]]
            x, y = q_data[who], data[hit]
            score = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            out.append(pd.DataFrame({"query_id": q_ids[who], "vec_id": ids[hit], "score": score}))
        return pd.concat(out)

    def best_of(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.rint((1 - F.col("score")) / TIE), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if not routers.value:
        return best_of(found_in(queries.withColumn("leaf", F.lit(0))))

    at_home = queries.mapInPandas(settle, "vec_id long, length int, v array<double>, leaf int")
    first = materialize(found_in(materialize(at_home, "nn-asked")), "nn-first")
    last = best_of(first).groupBy("query_id").agg(F.max_by("score", "rank").alias("score"), F.max("rank").alias("found"))
    reach = F.when(F.col("found") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score")))).otherwise(float("inf"))

    def further(batches):
        """The other leaves that each query must visit."""
        for pdf in batches:
            for n, r in routers.value.items():
                own = pdf[pdf["length"] == n]
                if len(own):
                    unit = _unit(_stack(own["v"]))
                    who, leaf = r.visits(unit, own["reach"].to_numpy(), factor)
                    away = leaf != r.home(unit)[who]
                    yield own[["vec_id", "length", "v"]].iloc[who[away]].assign(leaf=leaf[away])

    bounded = queries.join(last, queries["vec_id"] == last["query_id"], "left").select("vec_id", "length", "v", F.coalesce(reach, F.lit(float("inf"))).alias("reach"))
    more = materialize(bounded.mapInPandas(further, "vec_id long, length int, v array<double>, leaf int"), "nn-further")
    return best_of(first.unionByName(found_in(more)))


@tidy
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
