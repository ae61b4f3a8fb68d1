"""Steps whose work must not outgrow their input, beside brute-force versions."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from trendloom.model import posts, snapshots
from trendloom.operators import similarity as sim
from trendloom.plans import composite, streams, texts


def test_titles_are_normalised_once(spark, sf_dir):
    # what the result is computed from has no pattern left in it, least of all one for each pair of characters
    plan = texts.title_shares(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_bigram_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdefgh "), 40)) for _ in range(30)]
    rows = [(10 * i + k, f"w{i % 2}", t[:k] + "xy"[: k % 3] + t[k:]) for i, t in enumerate(base) for k in range(6)]
    grams = {r[0]: {r[2][i : i + 2] for i in range(len(r[2]) - 1)} for r in rows}
    of = {r[0]: r[1] for r in rows}
    share = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    want = {(a, b) for a, b in itertools.combinations(sorted(of), 2) if of[a] == of[b] and share(a, b) >= 0.8 - 1e-9}
    df = spark.createDataFrame(rows, "id long, w string, norm string")
    for block in (1000, 25):
        assert {(r.a, r.b) for r in sim.bigram_pairs(df, 0.8, "w", block).collect()} == want
    # links alone: as many as connect them, however many pairs
    timed = df.selectExpr("*", "0L as first", "0L as last")
    links = sim.bigram_pairs(timed, 0.8, "w", most=0)
    assert links.count() < len(rows) < len(want) + len(rows)
    a = {r.id: r.group for r in sim.groups(df, links.select("a", "b")).collect()}
    b = {r.id: r.group for r in sim.groups(df, spark.createDataFrame(sorted(want), "a long, b long")).collect()}
    assert a == b


def test_cosine_links_connect_what_pairs_do(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 12)))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for least, block in ((0.8, 1000), (0.8, 90), (0.5, 90)):
        pairs, links = sim.cosine_pairs(df, least).select("a", "b"), sim.cosine_links(df, least, block, tile=16)
        assert links.join(pairs.selectExpr("a as x", "b as y"), F.expr("least(a, b) = x and greatest(a, b) = y"), "left_anti").isEmpty()
        assert {r.id: r.group for r in sim.groups(df, links).collect()} == {r.id: r.group for r in sim.groups(df, pairs).collect()}
    assert sim.cosine_links(df, 0.3).count() < len(rows) < sim.cosine_pairs(df, 0.3).count()


def test_composite_reads_texts_once(spark, sf_dir):
    for query in (composite.composite_scores, composite.news_signals):
        assert not [f for f in query(spark, sf_dir).inputFiles() if "documents" in f]
    assert [f for f in posts(spark, sf_dir).inputFiles() if "documents" in f]


def test_velocity_takes_many_files_at_once(spark, sf_dir, tmp_path):
    snapshots(spark, sf_dir).repartition(20).write.parquet(f"{tmp_path}/snapshots")
    streams.stream_velocity(spark, sf_dir, str(tmp_path))
    # one batch of rows, and maybe one without that moves the watermark
    assert len(list(tmp_path.glob("rows/b*"))) <= 2
