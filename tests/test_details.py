"""Views, stores and quality figures on single cases."""

import math

import pytest
from pyspark.sql import functions as F

from trendloom.plans import details

AT = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_popular_elsewhere_leaves_out_the_own_cluster(spark):
    rows = [(i, "news", "big" if i < 6 else f"c{i}", float(100 - i), i == 9) for i in range(10)] + [(20, "video", "v", 1.0, False), (21, "video", "v", 2.0, False)]
    p = spark.createDataFrame(rows, "id long, category string, cluster string, score double, old boolean")
    p = p.withColumn("scraped_at", F.expr(f"{AT} - CASE WHEN old THEN INTERVAL 2 DAYS ELSE INTERVAL 1 HOUR END")).drop("old")
    got = {r.id: r.popular for r in details.popular_elsewhere(p, F.expr(f"{AT} - INTERVAL 1 DAY")).collect()}
    assert got[0] == [6, 7, 8]  # five of the category's best are its own cluster; post 9 is old
    assert got[7] == [0, 1, 2, 3, 4]
    assert got[20] == []  # only its own cluster is there


def test_store_keeps_written_summaries(spark):
    kind = "stable_id string, title string, summary string, category_label string"
    old = spark.createDataFrame([("a", "A", "written", "x"), ("b", "B", "[fallback] B", "x"), ("c", "C", None, "x"), ("d", "D", "written", "x"), (None, "N", "written", "x")], kind)
    new = spark.createDataFrame([(k, f"new {k}", f"[fallback] new {k}", "y") for k in "abce"], kind)
    got = {r.stable_id: (r.title, r.summary, r.category_label) for r in details.store_issues(old, new).collect()}
    fresh = {k: (f"new {k}", f"[fallback] new {k}", "y") for k in "bce"}
    assert got == fresh | {"a": ("A", "written", "x")}
    assert details.store_issues(old, new.limit(0)).count() == 5


def test_cohesion_is_the_mean_of_all_pairs(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 2.0]), ("a", [3.0, 3.0]), ("a", [0.0, 0.0]), ("a", None), ("b", [1.0, 1.0])]
    got = {r.cluster: (r.n, r.cohesion) for r in details.cohesion(spark.createDataFrame(rows, "cluster string, v array<double>")).collect()}
    assert got["a"] == (3, pytest.approx(2 * math.sqrt(0.5) / 3))
    assert got["b"] == (1, None)


def test_rule_summary(spark):
    of = lambda *x: value(spark, details.rule_summary(*[F.lit(v) for v in x]))
    assert of("t", " t ", 3) == of("t", None, 3) == "t — 관련 보도 3건"
    assert of("t", "other", 3) == "t — other"
    assert of("t", "x" * 81, 3) == "t — " + "x" * 80 + "…"


def test_cache_hits_need_little_change(spark):
    cache = spark.createDataFrame([("a", [1, 2, 3, 4], 4), ("b", [1, 2], 0), ("c", [], 0)], "fingerprint string, cached_ids array<long>, hit_count long")
    now = spark.createDataFrame([("a", [4, 3, 2, 1, 5]), ("b", [1, 3]), ("c", []), ("d", [1])], "fingerprint string, top_ids array<long>")
    got = {(r.fingerprint, r.change, r.hit_count) for r in details.cached_summaries(cache, now).collect()}
    assert got == {("a", 0.2, 5), ("c", 0.0, 1)}


def test_judgements(spark):
    rows = [(None, 1, 0, 0.5), (5, 2, 2, 0.5), (6, None, 0, 0.0), (9, 5, 1, 1.0)]
    r = details.judged(spark.createDataFrame(rows, "coherence int, title_quality int, outliers int, cost double")).first()
    assert (r.coherence_p50, r.coherence_avg, r.low_count, r.title_avg, r.outlier_ratio, r.cost) == (6, 5.0, 1, 2.0, 0.5, 2.0)


def test_video_ids(spark):
    name = "abcDEF_-123"
    assert {value(spark, details.video_id(F.lit(u))) for u in (f"https://h.test/watch?a=1&v={name}", f"https://youtu.be/{name}?t=1", f"https://h.test/embed/{name}")} == {name}
    assert value(spark, details.video_id(F.lit("https://h.test/watch?v=short"))) is None
