"""Kept tables, swapped loads, checked settings and the older composite on single cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trendloom import settings
from trendloom.operators import stores
from trendloom.plans import composite



def test_partitions_are_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame(list(x), "id long, source_key string")
    stores.replace_partitions(rows((1, "a"), (2, "a"), (3, "b"), (4, None)), path, "source_key")
    stores.replace_partitions(rows((5, "a"), (6, "c")), path, "source_key")
    stores.replace_partitions(rows(), path, "source_key")
    assert sorted((r.id, r.source_key) for r in spark.read.schema("id long, source_key string").parquet(path).collect()) == [(3, "b"), (4, None), (5, "a"), (6, "c")]


def test_days_are_kept_and_let_go(spark, tmp_path):
    path = f"{tmp_path}/t"

    def take(day, hour, *ids):
        rows = [(i, dt.datetime(2024, 1, day, hour)) for i in ids]
        stores.append_days(spark.createDataFrame(rows, "id long, at timestamp"), path, "at", keep=3)
        return sorted((r.day[-2:], r.id) for r in stores.read_days(spark, path, "id long, at timestamp").collect())

    assert take(1, 5, 1, 2) == [("01", 1), ("01", 2)]
    assert take(1, 6, 3) == [("01", 1), ("01", 2), ("01", 3)]
    assert take(1, 6, 3) == [("01", 1), ("01", 2), ("01", 3)]  # repeated
    assert take(3, 0, 4) == [("01", 1), ("01", 2), ("01", 3), ("03", 4)]
    assert take(4, 0, 5) == [("03", 4), ("04", 5)]


def test_a_failed_load_leaves_the_old_one(spark, tmp_path):
    path = f"{tmp_path}/t"
    one = lambda n: {"rows": spark.range(n).select("id"), "meta": spark.range(1).select(F.lit(n).alias("n"))}
    seen = lambda: (stores.current(spark, path, "rows").count(), stores.current(spark, path, "meta").first().n)
    stores.swap_in(spark, path, one(3))
    before = stores.current(spark, path, "rows")
    broken = {"rows": spark.range(9).select("id"), "meta": spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("n"))}
    with pytest.raises(Exception, match="no"):
        stores.swap_in(spark, path, broken)
    assert seen() == (3, 3)

    def refuse(staged):
        if staged["rows"].count() > 4:
            raise ValueError("too many")

    with pytest.raises(ValueError, match="too many"):
        stores.swap_in(spark, path, one(5), refuse)
    assert seen() == (3, 3)
    stores.swap_in(spark, path, one(4), refuse)
    assert seen() == (4, 4) and before.count() == 3  # who read the old one can go on
    stores.swap_in(spark, path, one(2))
    assert seen() == (2, 2) and len(stores.loaded(spark, path)) == 2


@pytest.mark.parametrize(("group", "key", "value", "fault"), [
    ("issue_aggregator", "MAX_ISSUES", "30", None), ("issue_aggregator", "MAX_ISSUES", "4.5", "MAX_ISSUES: below 5.0"), ("issue_aggregator", "MAX_ISSUES", "1e3", "MAX_ISSUES: above 100.0"), ("issue_aggregator", "MAX_ISSUES", '"30"', "MAX_ISSUES: not a number"),
    ("issue_aggregator", "MAX_ISSUES", None, "MAX_ISSUES: not a number"), ("issue_aggregator", "MAX_ISSUES", "NaN", "MAX_ISSUES: not a number"), ("issue_aggregator", "other", "1", "unknown field other"), ("nothing", "x", "1", "unknown group nothing"), (None, "x", "1", "unknown group "),
    ("source_weights", "values", '{"yna": 2, "b": 0.01, "a": "x"}', "values.a: not a number; values.b: below 0.1"), ("source_weights", "values", '{"yna": 2.5}', None), ("source_weights", "values", "{}", None), ("source_weights", "values", "[1]", "values: not an object"), ("source_weights", "values", "{no", "values: not an object"),
    ("trend_signal", "BASE_BONUS_BY_COUNT", "[1, 1.5, 9, null]", "BASE_BONUS_BY_COUNT[2]: above 3.0; BASE_BONUS_BY_COUNT[3]: not a number"), ("trend_signal", "BASE_BONUS_BY_COUNT", "1", "BASE_BONUS_BY_COUNT: not a list"), ("trend_signal", "BASE_BONUS_BY_COUNT", " [1.0] ", None),
])
def test_faults(spark, group, key, value, fault):
    rows = spark.createDataFrame([(group, key, value)], "group string, key string, value string")
    assert settings.check_changes(rows).first().fault == fault


def test_defaults_are_within_their_bounds(spark):
    rows = [(g, k, d) for g, k, _, d, *_ in settings.bound_rows()]
    assert settings.check_changes(spark.createDataFrame(rows, "group string, key string, value string")).where("fault IS NOT NULL").count() == 0 and len(rows) > 40


def test_groups_are_set_whole_and_reset(spark):
    rows = [(1, "breaking_news", "MIN_SOURCES", "5"), (1, "breaking_news", "MAX_BOOST", "4"), (2, "breaking_news", "MIN_SOURCES", "6"), (2, "breaking_news", "MAX_BOOST", "99"), (3, "trend_signal", "MIN_LATIN_KEYWORD_LEN", "4"), (4, "trend_signal", None, None), (5, "trend_signal", "MIN_KOREAN_KEYWORD_LEN", "3")]
    changes = spark.createDataFrame(rows, "batch long, group string, key string, value string")
    stored = spark.createDataFrame([("summary_queue", "NOVELTY_FACTOR", "2"), ("trend_signal", "TREND_SIGNAL_BONUS_CAP", "3")], "group string, key string, value string")
    after = settings.apply_changes(stored, changes)
    assert sorted(map(tuple, after.collect())) == [("breaking_news", "MAX_BOOST", "4"), ("breaking_news", "MIN_SOURCES", "5"), ("summary_queue", "NOVELTY_FACTOR", "2"), ("trend_signal", "MIN_KOREAN_KEYWORD_LEN", "3")]
    every = {(r.group, r.key): (json.loads(r.value), r.changed) for r in settings.settings(spark, after).collect()}
    assert every["breaking_news", "MIN_SOURCES"] == (5, True) and every["trend_signal", "TREND_SIGNAL_BONUS_CAP"] == (1.8, False)


def test_composite_of_single_posts(spark):
    t = dt.datetime(2024, 1, 1, 10)
    post = lambda i, source, category, title="t", **x: (i, source, category, title, x.get("v", 10), 0, 0, None, t)
    posts = spark.createDataFrame([post(1, "yna", "news"), post(2, "theqoo", "community"), post(3, "youtube", "video", v=0), post(4, "x", "video", v=0), post(5, "yna", "news", "[사진] a"), post(6, "x", "news")], "id long, source_key string, category string, title string, view_count long, comment_count long, like_count long, published_at timestamp_ntz, scraped_at timestamp_ntz")
    fields = "id long, engagement double, portal double, importance double, trend double, news_engagement double, video double, weight double, velocity double, community_velocity double, cluster double, breaking double"
    signals = spark.createDataFrame([(1, 9.0, 5.0, 2.0, 1.4, 3.0, 1.0, 1.3, 1.5, 1.6, 2.0, 3.0), (2, 4.0, 5.0, 2.0, 1.4, 3.0, 1.0, 1.3, 1.5, 1.6, 2.0, 3.0), (3, 4.0, None, None, 1.4, None, None, None, 1.5, None, 2.0, 3.0), (4, 4.0, None, None, None, None, None, None, None, None, None, None)], fields)
    got = {r.id: r for r in composite.composite(posts, F.lit(t + dt.timedelta(minutes=180)).cast("timestamp_ntz"), signals).collect()}
    fresh = 10 * 2 ** (-180 / 45)
    news = 0.32 * 5 + 0.27 * 2 + 0.18 * 5 + 0.13 * 3 + 0.10 * fresh + 0.08 * 1
    assert got[1].score == pytest.approx(news * 0.5 * 2.5 * 1.3 * 3.0) and got[1].base == pytest.approx(news * 2.5 * 1.3 * 3.0)
    assert got[2].score == pytest.approx(4 * 2 ** (-180 / 150) * 1.4 * 1.6) and got[3].score == pytest.approx(4 * 1.15 * 2 ** (-0.5) * 2.5 * 0.95 * 1.5 * 2.0 * 1.4)
    # sources of more posts than the upper median source are damped, none here; a source without weight has the default
    assert got[4].score == pytest.approx(4 * 0.8 * 2 ** (-0.5) * 0.8 * 0.95 * (1 - 0.15 * 0.6931471805599453)) and 5 not in got and got[6].engagement_factor == 1.0
