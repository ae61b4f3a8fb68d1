"""Scores of posts: authority, freshness and engagement, normalised per channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANNEL_HALF_LIFE, COMMUNITY_HALF_LIFE, DEFAULT, DEFAULT_SOURCE_WEIGHT, NEWS_HALF_LIFE, Scoring
from ..functions.maths import age_minutes, decay, lookup, squash
from .work import work_table


def channel(category: Column) -> Column:
    """The channel of a category; null for those that aren't scored."""
    return F.when(category.isin("news", "community", "video", "portal"), category)


def authority(source: Column, of: Column, c: Scoring = DEFAULT) -> Column:
    community = F.greatest(F.lit(1.0), 0.5 + lookup(source, c.community_weight, c.community_weight_default))
    return F.when(of == "community", community).otherwise(F.greatest(F.lit(1.0), lookup(source, c.source_weight, DEFAULT_SOURCE_WEIGHT)))


def half_life(source: Column, of: Column, c: Scoring = DEFAULT) -> Column:
    return (
        F.when(of == "community", lookup(source, COMMUNITY_HALF_LIFE, c.community_half_life_default))
        .when(of.isin("news", "portal"), lookup(source, NEWS_HALF_LIFE, c.news_half_life_default))
        .otherwise(lookup(of, CHANNEL_HALF_LIFE, c.half_life_default))
        .cast("double")
    )


def z_by(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the z-score of ``value`` among rows of one ``key`` (population deviation, 0 as 1).

    Grouped sums joined back, not a window: the groups are few and large.
    """
    stats = df.select(key, value.alias("__x")).groupBy(key).agg(F.avg("__x").alias("__mean"), F.stddev_pop("__x").alias("__std"))
    std = F.when(F.col("__std") > 0, F.col("__std")).otherwise(1.0)
    return df.join(stats, key).withColumn(name, (value - F.col("__mean")) / std).drop("__mean", "__std")


def engagement_sum() -> Column:
    return F.log1p(F.col("view_count") + 2 * F.col("comment_count") + 3 * F.col("like_count"))


def topic_importance(size: Column, sources: Column, channels: Column) -> Column:
    grown = 1 + 0.3 * F.log2(1 + size) + 0.25 * F.log2(1 + sources) + 0.25 * (channels - 1)
    return F.when(size <= 1, 1.0).otherwise(F.greatest(F.lit(1.0), grown))


def score_posts(posts: DataFrame, as_of: Column, topics: DataFrame | None = None, echo: DataFrame | None = None, c: Scoring = DEFAULT) -> DataFrame:
    """Adds channel, the five factors, ``raw`` and ``trend_score``; posts of other categories go.

    ``topics`` (id, topic_importance) and ``echo`` (id, echo) default to 1 where they lack a post.
    """
    df = posts.withColumn("channel", channel(F.col("category"))).where("channel IS NOT NULL")
    age = age_minutes(F.coalesce("published_at", "scraped_at"), as_of)
    df = z_by(df, "channel", engagement_sum(), "__z")
    df = df.select(
        "*", authority(F.col("source_key"), F.col("channel"), c).alias("authority"),
        decay(age, half_life(F.col("source_key"), F.col("channel"), c)).alias("freshness"),
        squash(F.col("__z"), c.squash_gain, c.squash_width, c.squash_floor).alias("engagement"),
    ).drop("__z")
    for other, name in ((topics, "topic_importance"), (echo, "echo")):
        df = df.withColumn(name, F.lit(1.0)) if other is None else df.join(other.select("id", name), "id", "left").withColumn(name, F.coalesce(name, F.lit(1.0)))
    df = df.withColumn("raw", F.col("authority") * F.col("freshness") * F.col("engagement") * F.col("topic_importance") * F.col("echo"))
    return z_by(df, "channel", F.log1p("raw"), "__z").withColumn("trend_score", F.greatest(F.lit(0.0), c.score_offset + F.col("__z"))).drop("__z")


def top_per(df: DataFrame, key: str | list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key with their ``rn``; Spark limits each task's groups before it shuffles."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """All rows with their ``rank`` (1, 2 and on) by ``order``, which tells rows apart.

    Rows are dealt into ranges of the order and numbered there; a range's first number is the count of
    the rows in ranges before it. So no task has them all.
    """
    parts = work_table(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # one row a range
    counts = parts.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return parts.withColumn("__own", own).join(F.broadcast(counts), "__range").withColumn("rank", (F.col("__own") + F.col("__before")).cast("long")).drop("__range", "__own", "__before")


def places(df: DataFrame, keys: list[str], *order: Column, name: str = "place") -> DataFrame:
    """All rows with their place (1 and on) among those of one key, by ``order``, which tells a key's rows apart.

    Rows are ranked over ranges of key and order, and a key's first rank is taken off; so a large key is no one task's work.
    """
    # rows are carried whole, as they may have a rank of their own
    rows = df.withColumn("__row", F.struct(*df.columns))
    at = work_table(ranked(rows, *[F.col(k) for k in keys], *order).select("__row", *keys, "rank"), "places")
    first = at.groupBy(*keys).agg(F.min("rank").alias("first"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    joined = at.alias("r").join(first.alias("f"), same)
    return joined.select(*[F.col(f"r.__row.{c}").alias(c) for c in df.columns], (F.col("r.rank") - F.col("f.first") + 1).alias(name))
