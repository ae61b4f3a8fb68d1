"""Volume dampening counts every post of every source."""

import math
from collections import Counter

import pytest

from trendloom.model import posts
from trendloom.plans.posts import dampening, volume_dampening


def test_all_posts_count(spark, sf_dir):
    want = Counter(r.source_key for r in posts(spark, sf_dir).select("source_key").collect())
    rows = volume_dampening(spark, sf_dir).collect()
    assert {r.source_key: r.n for r in rows} == want
    assert {r.median for r in rows} == {sorted(want.values())[len(want) // 2]}


def test_uneven_sources(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 10), ("c", 10), ("d", 20), ("e", 1000)], "source_key string, n long")
    got = {r.source_key: r.dampening for r in dampening(counts).collect()}
    assert got == pytest.approx({"a": 1.0, "b": 1.0, "c": 1.0, "d": 1 - 0.15 * math.log(2), "e": 0.7}, abs=1e-6)
