"""Formulas on single cases, with expected values worked out from their definitions."""

import math

import pytest
from pyspark.sql import functions as F

from trendloom.functions import maths, text
from trendloom.model import as_of
from trendloom.operators.scoring import ranked
from trendloom.plans import issues, posts, signals

AT = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokenizers(spark):
    lit = F.lit
    assert value(spark, text.title_tokens(lit("국회에서는 예산안이 통과 2024 관련"))) == ["국회", "예산안", "통과"]
    assert value(spark, text.topic_tokens(lit("[속보] 정부는·예산을 2024 나는"))) == ["정부", "예산", "2024", "나는"]
    assert value(spark, text.hangul_tokens(lit("뉴스 abc 반도체공장 a화재b 불"))) == ["반도체공장", "화재"]
    assert value(spark, text.probe_title(lit("[A] B-c, 다 라!"))) == "bc다라"


def test_velocity_bonuses(spark):
    rate = [F.lit(float(x)) for x in (10, 2, 1)]
    assert value(spark, maths.velocity_bonus(*rate)) == pytest.approx(1 + min((math.log(11) + 2 * math.log(3) + 2.5 * math.log(2)) / 10, 0.5))
    assert value(spark, maths.velocity_bonus(F.lit(1.0), F.lit(0.0), F.lit(0.0))) == pytest.approx(1 + math.log(2) / 10)
    assert value(spark, maths.community_velocity_bonus(F.lit(1.0), F.lit(0.0), F.lit(9.0), F.lit(False))) == pytest.approx(1 + 1.75 * math.log(2) / 8)
    assert value(spark, maths.community_velocity_bonus(*rate, F.lit(True))) == 1.6


def test_trend_match(spark):
    k = spark.createDataFrame([("부동산시장", "a", 0.9, 2), ("부동산", "a", 0.5, 0), ("ai", "b", 1.0, 0), ("gpt", "b", 0.3, 5), ("삼성전자 실적", "c", 0.4, 0)], "keyword string, source_key string, strength double, h int")
    k = k.selectExpr("keyword", "source_key", "strength", f"{AT} - make_dt_interval(0, h, 0, 0) AS at")
    p = spark.createDataFrame([(1, "부동산 시장 급등"), (2, "ai 시대"), (3, "gpt ai 부동산"), (4, "삼성전자 3분기 실적 발표"), (5, "무관한 제목")], "id long, norm string")
    got = {r.id: (r.sources, r.best, r.decay) for r in issues.match_trends(p, k, as_of()).collect()}
    # 1: the strongest of source a, without spaces; 2: too short; 3: two sources; 4: five of the six pairs
    assert got == {1: (1, 0.9, 0.85), 3: (2, 0.5, pytest.approx((1.0 + 0.6) / 2)), 4: (1, 0.4, 1.0)}
    assert value(spark, issues.trend_bonus(F.lit(3), F.lit(1.0), F.lit(1.0))) == 1.6
    assert value(spark, issues.trend_bonus(F.lit(1), F.lit(0.0), F.lit(0.3))) == 1.0


def table(spark, rows):
    df = spark.createDataFrame(rows, "id long, source_key string, category string, title string, m int, view_count long, metadata string, cluster_id string")
    return df.withColumn("scraped_at", F.expr(f"{AT} - make_dt_interval(0, 0, m, 0)"))


def test_breaking(spark):
    p = table(spark, [
        (1, "a", "news", "t", 30, 9, None, "x"), (2, "b", "news", "t", 20, 1, None, "x"), (3, "c", "news", "t", 10, 1, None, "x"),  # three within half an hour
        (4, "a", "news", "u", 60, 9, None, "y"), (5, "b", "news", "u", 20, 1, None, "y"), (6, "c", "news", "u", 10, 1, None, "y"),  # too far apart
        (7, "yna", "news", "[속보] v", 30, 1, None, None), (8, "yna", "news", "v", 30, 1, None, None), (9, "sbs", "news", "속보", 30, 1, None, None), (10, "ytn", "news", "긴급", 150, 1, None, None),
    ])
    got = {r.id: r.bonus for r in posts.breaking_boost(p.drop("cluster_id"), p.select("id", "cluster_id").where("cluster_id IS NOT NULL"), as_of()).collect()}
    assert got == {1: pytest.approx(2.0), 7: pytest.approx(1.5)}


def test_portal(spark):
    p = table(spark, [
        (1, "naver_news_ranking", "portal", "t", 0, 1, '{"rank": 1}', "x"), (2, "zum_news", "portal", "t", 360, 1, '{"rank": 16}', "x"), (3, "sbs", "news", "t", 5, 1, None, "x"),
        (4, "fmkorea", "community", "t", 5, 1, None, "x"), (5, "nate_news", "portal", "u", 0, 1, '{"rank": 99}', None), (6, "sbs", "news", "w", 0, 1, '{"rank": 1}', None), (7, "nate_news", "portal", "u", 1500, 1, '{"rank": 1}', None),
    ])
    got = {r.id: r.score for r in posts.portal_scores(p, p.select("id", "cluster_id").where("cluster_id IS NOT NULL"), as_of()).collect()}
    assert got == {1: pytest.approx(9.0), 2: pytest.approx(9.0 * 0.75), 3: pytest.approx(9.0 * 0.75), 5: pytest.approx(10 * (1 - 29 / 30) * 0.8)}


def test_priority(spark):
    ids = lambda *x: F.array(*[F.lit(i) for i in x]) if x else F.array().cast("array<int>")
    of = lambda summary, before, now: value(spark, issues.priority_of(F.lit(8.0), F.lit(6.0), F.lit(summary), before, now))
    assert of("own", ids(1, 2, 3), ids(1, 2, 3)) == pytest.approx(4.0)
    assert of("[fallback] x", ids(), ids(1, 2)) == pytest.approx(12.0)
    assert of(None, ids(1, 2, 3), ids(1, 2, 4)) == pytest.approx(4.0 * 3 * 1.2)


def test_duplicates_in_time(spark):
    """Links within six hours, also across spans; a hot title is a chain, thumbnails link any category."""
    rows = [(i, 5 * i, "news", "same title again", None) for i in range(40)] + [(100, 24, "news", "alone now", "img"), (101, 29, "video", "other words", "img"), (102, 500, "news", "other words", "img"), (103, 0, "news", "", ""), (104, 0, "news", "", "")]
    rows += [(200, 300, "news", "one two three four five six", None), (201, 305, "news", "six five four three two one", None), (202, 312, "news", "one two three four five seven six", None)]
    p = spark.createDataFrame(rows, "id long, h int, category string, norm string, thumbnail string").withColumn("at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, h, 0, 0)"))
    got = {r.id: r.group for r in issues.cluster_duplicates(p).collect()}
    assert {got[i] for i in range(40)} == {0} and got[101] == 100 and got[102] == 102 and got[104] == 104
    assert (got[200], got[201], got[202]) == (200, 200, 202)


def test_token_gate(spark):
    stats = spark.createDataFrame([("common", 50, 500), ("burst", 50, 100), ("rare", 1, 10)], "token string, df24 long, df long")
    totals = spark.createDataFrame([(1000, 10000)], "n24 long, n long")
    pairs = [(1, ["common", "x"], ["common"]), (2, ["burst"], ["burst"]), (3, ["rare"], ["rare"]), (4, ["new"], ["new"]), (5, [], ["a"]), (6, ["a"], ["b"])]
    got = {r.id: r.passes for r in signals.token_gate(spark.createDataFrame(pairs, "id long, a array<string>, b array<string>"), stats, totals).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: True, 6: False}
    none = signals.token_gate(spark.createDataFrame(pairs[:1], "id long, a array<string>, b array<string>"), stats.where("false"), totals)
    assert none.first().passes


def test_ranked(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    got = [(r.v, r.id) for r in ranked(df.repartition(6), F.desc("v"), F.asc("id")).orderBy("rank").collect()]
    assert got == sorted(((i % 7, i) for i in range(500)), key=lambda x: (-x[0], x[1]))
