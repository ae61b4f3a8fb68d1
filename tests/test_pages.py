"""Single cases of what views and pages are made of; test_plans compares them with their SQL."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendloom import settings
from trendloom.functions.text import short_count
from trendloom.operators.scoring import places
from trendloom.plans import pages
from trendloom.sources import feeds


def test_places_of_a_large_key(spark):
    """A third of all rows under one key, another null; columns named as those that places are made with."""
    rows = [(None if i % 5 == 0 else "hot" if i % 3 == 0 else f"k{i % 7}", (i * 37) % 101, i, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, rank long, id long, first long")
    got = {(r.k, r.id): (r.place, r["rank"], r.first) for r in places(df, ["k"], F.desc("rank"), F.col("id")).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            want[k, r[2]] = (n, r[1], r[3])
    assert got == want
    assert places(df.where("false"), ["k"], F.col("id")).count() == 0


def test_pages_by_cursor(spark):
    rows = [(i, (i * 7) % 5) for i in range(23)]
    df = spark.createDataFrame(rows, "id long, score long")
    want = sorted(rows, key=lambda r: (-r[1], -r[0]))
    seen, at = [], (1 << 40, 0)
    while page := [(r.id, r.score) for r in pages.after_cursor(df, *at, n=10).collect()]:
        seen += page
        at = page[-1][1], page[-1][0]
    assert seen == want


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 1.0, 9.0], 0.707107), ([0.0, 0.0], [1.0], None), ([], [1.0], None), (None, [1.0], None), ([3.0], [2.0, 5.0], 1.0)])
def test_cosine_of_unequal_lengths(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(F.round(pages.cosine_or_null(F.col("a"), F.col("b")), 6).alias("c")).first().c
    assert got == want


def test_circuits(spark):
    t = dt.datetime(2024, 1, 1)
    runs = [("a", t + dt.timedelta(minutes=i), i, None if i == 2 else "E") for i in range(8)] + [("b", t, 1, "E"), ("b", t, 2, None)] + [("c", t + dt.timedelta(minutes=i), i, "E") for i in range(4)]
    df = spark.createDataFrame(runs, "source_key string, started_at timestamp_ntz, id long, error_message string")
    got = {r.source_key: (r.failures, r.opened_at, r.wait_minutes) for r in pages.circuits(df, F.lit(t + dt.timedelta(minutes=37)).cast("timestamp_ntz")).collect()}
    assert got == {"a": (5, t + dt.timedelta(minutes=7), 30.0), "b": (0, None, 0.0), "c": (4, None, 0.0)}


def test_page_views_and_city_records(spark):
    body = '{"items":[{"articles":[{"article":"특수:x","views":9,"rank":1},{"article":"대한민국","views":9,"rank":2},{"article":"A_b","views":250000,"rank":3},{"article":"c","views":50000,"rank":4}]}]}'
    df = spark.createDataFrame([("w", body), ("e", '{"items":[]}'), ("n", None), ("bad", "x")], "source_key string, body string")
    assert [tuple(r) for r in feeds.page_views(df).collect()] == [("w", "A b", 1.0, 3, 250000), ("w", "c", 0.5, 4, 50000)]
    inner = "<CITYDATA><LIVE_PPLTN_STTS><LIVE_PPLTN_STTS><AREA_CONGEST_LVL>붐빔</AREA_CONGEST_LVL><AREA_PPLTN_MIN>9876</AREA_PPLTN_MIN><AREA_PPLTN_MAX>20000</AREA_PPLTN_MAX></LIVE_PPLTN_STTS></LIVE_PPLTN_STTS></CITYDATA>"
    cities = spark.createDataFrame([("역", f"<r>{inner}</r>"), ("x", "<r><CITYDATA/></r>"), ("n", None)], "area string, body string")
    assert [r.title for r in feeds.city_records(cities).collect()] == ["역: 붐빔 (인구 약 9,876~2만명)"]


def test_short_counts(spark):
    got = [r.t for r in spark.createDataFrame([(999,), (12345,), (1_200_000,)], "n long").coalesce(1).select(short_count(F.col("n")).alias("t")).collect()]
    assert got == ["999", "12.3K", "1.2M"]


def test_flags(spark):
    stored = spark.createDataFrame([("feature_flags", "embeddings_enabled", "false"), ("feature_flags", "scoring_track_b_enabled", "true"), ("feature_flags", "scoring_v8_enabled", "0"), ("other", "gemini_summary_enabled", "false")], "group string, key string, value string")
    got = {r.flag: r.enabled for r in settings.flags(stored).collect()}
    assert got == {"embeddings_enabled": False, "gemini_summary_enabled": True, "cross_validation_enabled": True, "scoring_track_b_enabled": True, "scoring_v8_enabled": True}
