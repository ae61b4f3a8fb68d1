"""Boards on single cases: charts with repeated titles, periods, votes, sizes of clusters, snippets."""

import datetime as dt

from pyspark.sql import functions as F

from trendloom.model import as_of
from trendloom.plans import boards, details

NOW = dt.datetime(2024, 1, 31)


def ago(**by):
    return NOW - dt.timedelta(**by)


def test_charts_keep_the_latest_of_a_title(spark):
    rows = [
        (1, "a", "Song!", ago(hours=2), '{"rank": 1}'), (2, "a", "song", ago(hours=1), '{"rank": 7}'), (3, "a", "other", ago(hours=5), '{"rank": 2.5}'),
        (4, "a", "third", ago(hours=3), '{"rank": 7}'), (5, "a", "none", ago(hours=1), '{"rank": "none"}'), (6, "a", "empty", ago(hours=1), None),
        (7, "a", "broken", ago(hours=1), "{"), (8, "b", "song", None, '{"rank": 3}'), (9, "b", "song", None, '{"rank": 1}'), (10, None, "x", ago(hours=1), '{"rank": 4}'),
    ]
    p = spark.createDataFrame(rows, "id long, source_key string, title string, scraped_at timestamp_ntz, metadata string")
    got = {(r.source_key, r.unified_rank, r.id, r["rank"]) for r in boards.list_charts(p).collect()}
    assert got == {("a", 1, 3, 2.5), ("a", 2, 2, 7.0), ("a", 3, 4, 7.0), ("b", 1, 8, 3.0), (None, 1, 10, 4.0)}
    assert {r.id for r in boards.list_charts(p, 1).collect()} == {3, 8, 10}
    assert boards.list_charts(p.limit(0)).count() == 0


def test_periods_hold_each_other(spark):
    rows = [
        ("s", "S", "community", 100, 2, 0, ago(hours=24)), ("s", "S", "community", 0, 0, 4, ago(hours=25)), ("s", "S", "community", 300, None, 0, ago(days=7, minutes=1)),
        ("t", "T", "community", None, None, None, ago(hours=1)), ("u", "U", "news", 9, 9, 9, ago(hours=1)), ("v", "V", "community", 9, 9, 9, ago(days=31)), ("v", "V", "community", 9, 9, 9, None),
    ]
    p = spark.createDataFrame(rows, "source_key string, source_name string, category string, view_count long, comment_count long, like_count long, scraped_at timestamp_ntz")
    got = {(r.period, r.source_key): (r["rank"], r.post_count, r.total_views, r.avg_views, r.score) for r in boards.rank_communities(p, as_of()).collect()}
    assert got == {
        ("today", "s"): (1, 1, 100, 100, 110), ("today", "t"): (2, 1, 0, 0, 0), ("7d", "s"): (1, 2, 100, 100, 160), ("7d", "t"): (2, 1, 0, 0, 0),
        ("30d", "s"): (1, 3, 400, 200, 200), ("30d", "t"): (2, 1, 0, 0, 0),
    }


def test_votes_are_answered_once_each(spark):
    """One post with votes through many hours, repeated voters, equal and missing times."""
    rows = [(i, 1, f"v{i % 40}", ago(minutes=7 * (i % 90))) for i in range(200)]
    rows += [(300, 2, "x", None), (301, 2, "x", NOW), (302, 2, "y", NOW), (303, 2, None, NOW), (304, None, "x", NOW)]
    votes = spark.createDataFrame(rows, "id long, post_id long, voter string, at timestamp_ntz")
    got = {r.id: (r.is_new, r.vote_count) for r in boards.answer_votes(votes).collect()}
    seen, want = {}, {}
    for i, post, voter, at in sorted(rows, key=lambda r: (r[3] or dt.datetime.min, r[0])):
        if post is not None and voter is not None:
            came = seen.setdefault(post, set())
            want[i] = (voter not in came, len(came | {voter}))
            came.add(voter)
    assert got == want and got[300] == (True, 1) and got[301] == (False, 1) and got[302] == (True, 2)


def test_cluster_sizes(spark):
    members = spark.createDataFrame([("large", f"s{i % 5}") for i in range(51)] + [("just", "s1")] * 50 + [("one", "s1"), ("two", None)], "cluster_id string, source_key string")
    got = {r.metric_name: r.value for r in boards.measure_clusters(members).collect()}
    assert got == {
        "cluster.cardinality_total": 4, "cluster.size_over50_count": 1, "cluster.singleton_ratio": 0.5, "cluster.source_diversity_avg": 1.75, "cluster.size_p50": 50,
        "cluster.size_p95": 51, "cluster.size_p99": 51, "cluster.size_max": 51, "cluster.sources_p50": 1, "cluster.sources_p95": 5,
    }
    assert [tuple(r) for r in boards.measure_clusters(members.limit(0)).collect()] == [("cluster.cardinality_total", 0.0)]


def test_sources_follow_the_last_snippet(spark):
    rows = [(1, "t", None, "z"), (1, "t", "b", "a"), (1, "t", "a", "y"), (1, "u", None, "m"), (1, "u", "", "n"), (2, "t", "a", "y")]
    held = spark.createDataFrame(rows, "issue long, title string, snippet string, source_key string").withColumn("extra", F.lit(1))
    assert {tuple(r) for r in details.titles_of(held).collect()} == {(1, "t", "a"), (1, "u", "n"), (2, "t", "y")}
    assert details.titles_of(held, 1).count() == 2
