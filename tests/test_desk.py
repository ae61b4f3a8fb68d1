"""Desk work around issues on single cases, and near vectors within hours."""

import itertools
import math
import random

from pyspark.sql import functions as F

from trendloom.operators import similarity as sim
from trendloom.plans import desk

AT = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"


def test_searches_wait_and_hold_three_keywords_each(spark):
    rows = [(f"k{i:02}", float(i), i != 11) for i in range(12)]
    keywords = spark.createDataFrame(rows, "keyword string, strength double, live boolean").withColumn("expires_at", F.expr(f"{AT} + CASE WHEN live THEN INTERVAL 1 HOUR ELSE INTERVAL '-1' HOUR END"))
    runs = lambda hours, error: spark.createDataFrame([(hours, error)], "h double, error_message string").withColumn("started_at", F.expr(f"{AT} - make_dt_interval(0, cast(h AS INT))"))
    got = lambda r: [(x.search, x.terms) for x in desk.video_search_terms(keywords, r, F.expr(AT)).orderBy("search").collect()]
    due = [(1, "k10|k09|k08"), (2, "k07|k06|k05"), (3, "k04|k03|k02")]
    assert got(runs(3.0, None)) == due
    assert got(runs(1.0, None)) == []
    assert got(runs(1.0, "failed")) == due  # a run that failed doesn't count
    assert got(runs(1.0, None).limit(0)) == due
    assert desk.video_search_terms(keywords.limit(0), runs(3.0, None), F.expr(AT)).count() == 0


def test_share_is_the_value_at_its_place(spark):
    values = [5, 1, 1, 9, 3, 3, 3, 20]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for share in (0.0, 0.5, 0.95, 1.0):
        place = min(len(values) - 1, math.floor(len(values) * share))
        assert desk.at_share(df, "v", share).first().value == sorted(values)[place]
    assert desk.at_share(df.limit(0), "v", 0.5).first().value is None


def test_figures_of_no_issues(spark):
    issues = spark.createDataFrame([], "issue long, score double, posts long, keywords long")
    titled = spark.createDataFrame([], "issue long, id long, title string, view_count long")
    assert {r.metric_name: r.value for r in desk.issue_figures(issues, titled).collect()} == {"issue.total": 0.0, "issue.score_nan_count": 0.0}


def test_figures_count_unknown_scores(spark):
    issues = spark.createDataFrame([(1, 5.0, 2, 0), (2, None, 4, 1), (3, float("nan"), 6, 3)], "issue long, score double, posts long, keywords long")
    titled = spark.createDataFrame([(1, 1, "red apple pie", 5), (1, 2, "green engine room", 4), (1, 3, "blue winter sea", 3), (2, 4, "alone", 1)], "issue long, id long, title string, view_count long")
    got = {r.metric_name: r.value for r in desk.issue_figures(issues, titled).collect()}
    assert got["issue.total"] == 3 and got["issue.score_nan_count"] == 2
    assert got["issue.posts_per_issue_p50"] == 4 and got["issue.matched_kw_count_p95"] == 3
    # three titles without a common word are three labels; an issue of one title isn't counted
    assert got["issue.cross_topic_pairs_total"] == 3 and got["issue.with_cross_topic_count"] == 1 and got["issue.label_count_avg"] == 3


def test_only_authors_change_comments(spark):
    kind = "post_id long, id long, author string, depth long, body string, is_deleted boolean"
    stored = spark.createDataFrame([(1, 1, "a", 0, "one", False), (1, 2, "b", 5, "two", False), (1, 3, "a", 1, "", True), (2, 1, "c", 4, "three", False)], kind)
    edits = spark.createDataFrame([(1, 1, "a", "new"), (1, 2, "a", "stolen"), (1, 3, "a", "raised")], "post_id long, id long, author string, body string")
    deletes = spark.createDataFrame([(1, 2, "x"), (2, 1, "c")], "post_id long, id long, author string")
    replies = spark.createDataFrame([(1, 10, 1, "d", "r"), (1, 11, 2, "d", "too deep"), (1, 12, 9, "d", "no parent"), (2, 13, 1, "d", "r"), (2, 14, None, "d", "top"), (2, 15, 3, "d", "of another post")], "post_id long, id long, parent_id long, author string, body string")
    got = {(r.post_id, r.id): (r.depth, r.body, r.is_deleted) for r in desk.changed_comments(stored, edits, deletes, replies).collect()}
    assert got == {
        (1, 1): (0, "new", False), (1, 2): (5, "two", False), (1, 3): (1, "", True), (2, 1): (4, "", True),
        (1, 10): (1, "r", False), (2, 13): (5, "r", False), (2, 14): (0, "top", False),
    }


def test_nicknames_are_unique_whatever_their_case(spark):
    stored = spark.createDataFrame([(1, "Ann", "x"), (2, "Bob", None), (3, None, None)], "id long, nickname string, avatar_url string")
    wanted = spark.createDataFrame([(1, "ANN", "y"), (2, "ann", "z"), (4, "Cat", None), (5, "cat", None)], "id long, nickname string, avatar_url string")
    got = {r.id: (r.nickname, r.avatar_url) for r in desk.save_profiles(stored, wanted).collect()}
    assert got == {1: ("ANN", "y"), 2: ("Bob", None), 3: (None, None), 4: ("Cat", None)}


def test_quiet_hours(spark):
    got = spark.range(24).select("id", desk.quiet_hours(F.expr("TIMESTAMP_NTZ '2024-01-01 00:30:00' + make_dt_interval(0, cast(id AS INT))")).alias("q")).where("q").collect()
    assert sorted(r.id for r in got) == [17, 18, 19, 20]


def test_pairs_within_hours_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.randrange(60 * 100)) for i in range(300)] + [(900, [0.0] * 4, 5), (901, [1.0] * 4, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, minutes int").withColumn("at", F.expr(f"{AT} + make_dt_interval(0, 0, minutes)"))
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    due = {(a[0], b[0]) for a, b in itertools.combinations(rows[:300], 2) if abs(a[2] - b[2]) <= 720 and cosine(a[1], b[1]) >= 0.5}
    for block in (7, 2000):
        got = [(r.a, r.b) for r in sim.cosine_pairs(df, 0.5, block, hours=12).collect()]
        assert len(got) == len(set(got)) and set(got) == due
    every = {(a[0], b[0]) for a, b in itertools.combinations(rows[:300], 2) if cosine(a[1], b[1]) >= 0.5}
    assert {(r.a, r.b) for r in sim.cosine_pairs(df.where("id < 900"), 0.5, 40).collect()} == every
    assert sim.cosine_pairs(df.limit(0), 0.5, hours=12).count() == 0
