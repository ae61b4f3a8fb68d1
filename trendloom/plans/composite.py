"""The older batch score whole: nine factors, six news signals, dampening by source, with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORY_WEIGHT, COMMUNITY_HALF_LIFE, COMMUNITY_WEIGHT, DEFAULT, DEFAULT_SOURCE_WEIGHT, NEWS_HALF_LIFE, SOURCE_WEIGHT, Scoring
from ..functions.maths import age_minutes, clamp, decay, freshness_signal, lookup
from ..functions.text import normalize_title, title_hash
from ..model import AS_OF, POSTS_SQL, as_of, case_of, kept_posts, posts
from ..operators.scoring import half_life
from ..operators.work import work_table
from . import issues
from . import posts as plans
from .posts import NORMAL_SQL, H, dampening

#: What a post without engagement gets of its category's baseline: alone, and as the canonical post of a cluster.
ALONE, TOLD = 0.8, 1.15
#: Titles of pictures aren't scored.
PICTURE = "[사진]"


def trend_signal(bonus: Column) -> Column:
    """A trend bonus of 1 to 1.8 as 0 to 10."""
    return clamp((bonus - 1) / 0.08, 0.0, 10.0)


def news_signal(portal: Column, importance: Column, trend: Column, engagement: Column, freshness: Column, video: Column, c: Scoring = DEFAULT) -> Column:
    """The weighted sum of six signals, 1 at least; a signal that is null counts as 0."""
    sum_ = F.lit(0.0)
    for weight, signal in zip(c.news_signals, (portal, importance, trend, engagement, freshness, video), strict=True):
        sum_ = sum_ + weight * F.coalesce(signal, F.lit(0.0))
    return F.greatest(sum_, F.lit(1.0))


def composite(p: DataFrame, at: Column, signals: DataFrame, c: Scoring = DEFAULT) -> DataFrame:
    """(id, factors, decay, half_life, score, base): the product of nine factors, damped by the source's share of posts.

    ``signals`` has for each id, or null: engagement, portal, importance, trend, news_engagement, video, weight, velocity,
    community_velocity, cluster and breaking. News take the news signal for engagement, their subcategory's weight, no
    velocity, cluster or trend factor, and alone the breaking boost; community posts no cluster, trend or category factor. ``base``
    is the score without decay, for later updates.
    """
    news, community = F.col("category").isin("news", "newsletter", "government", "portal"), F.col("category") == "community"
    one = lambda x: F.coalesce(x, F.lit(1.0))
    df = p.where(~F.col("title").startswith(PICTURE)).join(signals, "id", "left")
    age = age_minutes(F.coalesce("published_at", "scraped_at"), at)
    half = half_life(F.col("source_key"), F.when(news, "news").otherwise(F.col("category")), c)
    none = (F.col("view_count") == 0) & (F.col("comment_count") == 0) & (F.col("like_count") == 0)
    engagement = F.col("engagement") * F.when(none, F.when(F.col("cluster").isNotNull(), TOLD).otherwise(ALONE)).otherwise(1.0)
    signal = news_signal(F.col("portal"), F.col("importance"), trend_signal(one(F.col("trend"))), F.col("news_engagement"), freshness_signal(age), F.col("video"), c)
    factors = {
        "engagement_factor": F.when(news, signal).otherwise(engagement),
        "decay": decay(age, half),
        "source_factor": F.when(community, lookup(F.col("source_key"), c.community_weight, c.community_weight_default)).otherwise(lookup(F.col("source_key"), c.source_weight, DEFAULT_SOURCE_WEIGHT)),
        "category_factor": F.when(news & F.col("weight").isNotNull(), F.col("weight")).when(community, 1.0).otherwise(lookup(F.col("category"), CATEGORY_WEIGHT, 1.0)),
        "velocity_factor": F.when(news, 1.0).when(community, one(F.col("community_velocity"))).otherwise(one(F.col("velocity"))),
        "cluster_factor": F.when(news | community, 1.0).otherwise(one(F.col("cluster"))),
        "trend_factor": F.when(news | community, 1.0).otherwise(one(F.col("trend"))),
        # the subcategory's weight is the news' category factor already
        "subcategory_factor": F.lit(1.0),
        "breaking_factor": F.when(news, one(F.col("breaking"))).otherwise(1.0),
    }
    scored = work_table(df.select("id", "source_key", half.alias("half_life"), *[x.alias(name) for name, x in factors.items()]), "composite")
    damped = dampening(scored.groupBy("source_key").agg(F.count("*").alias("n"))).select("source_key", "dampening")
    base = F.col("dampening")
    for name in factors:
        if name != "decay":
            base = base * F.col(name)
    out = scored.join(F.broadcast(damped), scored["source_key"].eqNullSafe(damped["source_key"])).drop(damped["source_key"])
    return out.withColumn("base", F.when(F.col("decay") > 0, base).otherwise(0.0)).withColumn("score", F.col("base") * F.col("decay"))


def post_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals of posts, each from its own query, one row a post."""
    p = posts(spark, sf_dir)
    members = p.where(normalize_title(F.col("title")) != "").select("id", title_hash(F.col("title")).alias("cluster_id"))
    speed = plans.velocity(spark, sf_dir).select(F.col("post_id").alias("id"), F.col("bonus").alias("velocity"), F.col("community_bonus").alias("community_velocity"))
    parts = (
        issues.normalized_engagement(spark, sf_dir), plans.portal_rank(spark, sf_dir).select("id", F.col("portal_score").alias("portal")),
        members.join(issues.cluster_importance(spark, sf_dir), "cluster_id").select("id", "importance"), issues.trend_match(spark, sf_dir).select("id", F.col("bonus").alias("trend")),
        plans.news_engagement(spark, sf_dir), issues.video_news_signal(spark, sf_dir).select("id", F.col("signal").alias("video")), plans.subcategory_percent_rank(spark, sf_dir).select("id", "weight"),
        speed, plans.cluster_bonus(spark, sf_dir).select("id", F.col("bonus").alias("cluster")), plans.breaking(spark, sf_dir).select("id", F.col("bonus").alias("breaking")),
    )
    out = p.select("id")
    for part in parts:
        out = out.join(part, "id", "left")
    return out


def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    with kept_posts(spark, sf_dir):
        out = composite(posts(spark, sf_dir), as_of(), post_signals(spark, sf_dir))
    return out.select("id", F.round("engagement_factor", 6).alias("engagement_factor"), F.round("category_factor", 6).alias("category_factor"), F.round("cluster_factor", 6).alias("cluster_factor"), "half_life", F.round("base", 4).alias("base"), F.round("score", 6).alias("score"))


def news_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six signals of news and their sum."""
    with kept_posts(spark, sf_dir):
        s = post_signals(spark, sf_dir).join(posts(spark, sf_dir).where("category IN ('news', 'portal')").select("id", "published_at", "scraped_at"), "id")
    fresh = freshness_signal(age_minutes(F.coalesce("published_at", "scraped_at"), as_of()))
    total = news_signal(F.col("portal"), F.col("importance"), trend_signal(F.coalesce("trend", F.lit(1.0))), F.col("news_engagement"), fresh, F.col("video"))
    return s.select("id", "portal", "importance", "trend", "news_engagement", "video", F.round(fresh, 6).alias("freshness"), F.round(total, 6).alias("signal"))


QUERIES = {f.__name__: f for f in (composite_scores, news_signals)}


def _signals_sql() -> str:
    """Each signal from its own query's SQL."""
    sub = lambda module, name: f"({module.ORACLE_SQL[name]})"
    return f"""eng AS MATERIALIZED (SELECT * FROM {sub(issues, "normalized_engagement")}), por AS (SELECT * FROM {sub(plans, "portal_rank")}), imp AS (SELECT * FROM {sub(issues, "cluster_importance")}), tre AS MATERIALIZED (SELECT * FROM {sub(issues, "trend_match")}),
  nen AS (SELECT * FROM {sub(plans, "news_engagement")}), vid AS (SELECT * FROM {sub(issues, "video_news_signal")}), sub AS (SELECT * FROM {sub(plans, "subcategory_percent_rank")}), vel AS (SELECT * FROM {sub(plans, "velocity")}),
  clu AS (SELECT * FROM {sub(plans, "cluster_bonus")}), bre AS (SELECT * FROM {sub(plans, "breaking")}),
  sig AS (SELECT p.*, engagement, portal_score AS portal, importance, tre.bonus AS trend, news_engagement, vid.signal AS video, weight, vel.bonus AS velocity, community_bonus, clu.bonus AS cluster, bre.bonus AS breaking,
    greatest(0.0, date_diff('microsecond', coalesce(published_at, scraped_at), TIMESTAMP '{AS_OF}') / 6e7) AS age
    FROM posts p LEFT JOIN eng USING (id) LEFT JOIN por USING (id) LEFT JOIN imp ON imp.cluster_id = {H} AND {NORMAL_SQL} <> '' LEFT JOIN tre USING (id) LEFT JOIN nen USING (id) LEFT JOIN vid USING (id) LEFT JOIN sub USING (id)
    LEFT JOIN vel ON vel.post_id = p.id LEFT JOIN clu USING (id) LEFT JOIN bre USING (id)),
  s2 AS (SELECT *, CASE WHEN age > 0 THEN 10 * exp(-ln(2) * age / 45) ELSE 10 END AS fresh FROM sig),
  s3 AS (SELECT *, greatest(1.0, {" + ".join(f"{w} * coalesce({x}, 0)" for w, x in zip(DEFAULT.news_signals, ("portal", "importance", "least(10.0, greatest(0.0, (coalesce(trend, 1.0) - 1) / 0.08))", "news_engagement", "fresh", "video"), strict=True))}) AS signal FROM s2)"""


ORACLE_SQL = {
    "news_signals": f"WITH {POSTS_SQL}, {_signals_sql()} SELECT id, portal, importance, trend, news_engagement, video, round(fresh, 6) AS freshness, round(signal, 6) AS signal FROM s3 WHERE category IN ('news', 'portal')",
    "composite_scores": f"""WITH {POSTS_SQL}, {_signals_sql()},
      f AS (SELECT *, category IN ('news', 'portal') AS is_news, category = 'community' AS is_com, CASE WHEN category = 'community' THEN {case_of("source_key", COMMUNITY_HALF_LIFE, DEFAULT.community_half_life_default)}
          WHEN category IN ('news', 'portal') THEN {case_of("source_key", NEWS_HALF_LIFE, DEFAULT.news_half_life_default)} ELSE 360 END::DOUBLE AS half_life FROM s3 WHERE NOT starts_with(title, '{PICTURE}')),
      g AS (SELECT *, CASE WHEN is_news THEN signal ELSE engagement * CASE WHEN view_count = 0 AND comment_count = 0 AND like_count = 0 THEN CASE WHEN cluster IS NULL THEN {ALONE} ELSE {TOLD} END ELSE 1.0 END END AS e,
        CASE WHEN is_com THEN {case_of("source_key", COMMUNITY_WEIGHT, DEFAULT.community_weight_default)} ELSE {case_of("source_key", SOURCE_WEIGHT, DEFAULT_SOURCE_WEIGHT)} END::DOUBLE AS w,
        CASE WHEN is_news AND weight IS NOT NULL THEN weight WHEN is_com THEN 1.0 ELSE {case_of("category", CATEGORY_WEIGHT, 1.0)} END::DOUBLE AS c,
        CASE WHEN is_news THEN 1.0 WHEN is_com THEN coalesce(community_bonus, 1.0) ELSE coalesce(velocity, 1.0) END AS v, CASE WHEN is_news OR is_com THEN 1.0 ELSE coalesce(cluster, 1.0) END AS k,
        CASE WHEN is_news OR is_com THEN 1.0 ELSE coalesce(trend, 1.0) END AS t, CASE WHEN is_news THEN coalesce(breaking, 1.0) ELSE 1.0 END AS b FROM f),
      n AS (SELECT source_key, count(*) AS n FROM g GROUP BY 1), m AS (SELECT list_sort(list(n))[count(*) // 2 + 1] AS median FROM n),
      d AS (SELECT source_key, round(CASE WHEN n > median THEN greatest(0.7, 1 - 0.15 * ln(n / median)) ELSE 1.0 END, 6) AS damp FROM n, m),
      r AS (SELECT g.*, exp(-ln(2) * age / half_life) AS dec, damp * e * w * c * v * k * t * b AS base FROM g JOIN d ON g.source_key IS NOT DISTINCT FROM d.source_key)
      SELECT id, round(e, 6) AS engagement_factor, round(c, 6) AS category_factor, round(k, 6) AS cluster_factor, half_life, round(CASE WHEN dec > 0 THEN base ELSE 0 END, 4) AS base, round(base * dec, 6) AS score FROM r""",
}
