"""Listings of posts: filters, pages, rankings, statistics and merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import COMMUNITY_HALF_LIFE, COMMUNITY_WEIGHT, DEFAULT_SOURCE_WEIGHT, NEWS_HALF_LIFE, PORTAL, SOURCE_WEIGHT
from ..functions.maths import clamp, community_velocity_bonus, lookup, velocity_bonus
from ..functions.text import normalize_title, title_hash
from ..model import AS_OF, POSTS_SQL, RUNS_SQL, SNAPSHOTS_SQL, as_of, case_of, posts, read, scraper_runs, snapshots
from ..operators.scoring import engagement_sum, ranked, score_posts, top_per

NORMAL_SQL = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(title, '\[[^\]]*\]', '', 'g'), '[^가-힣a-zA-Z0-9 \t\n\r]', '', 'g'), '[ \t\n\r]+', ' ', 'g')))"
AUTHORITY_SQL = f"greatest(1.0, CASE category WHEN 'community' THEN 0.5 + {case_of('source_key', COMMUNITY_WEIGHT, 1.0)} ELSE {case_of('source_key', SOURCE_WEIGHT, DEFAULT_SOURCE_WEIGHT)} END)::DOUBLE"
SCORED_SQL = f"""ages AS (SELECT *, greatest(0.0, date_diff('microsecond', coalesce(published_at, scraped_at), TIMESTAMP '{AS_OF}') / 6e7) AS age,
    ln(1 + view_count + 2 * comment_count + 3 * like_count) AS eng FROM posts),
  es AS (SELECT category AS k, avg(eng) AS m, stddev_pop(eng) AS sd FROM ages GROUP BY 1),
  factors AS (SELECT ages.*, {AUTHORITY_SQL} AS authority,
    exp(-ln(2) * age / CASE category WHEN 'community' THEN {case_of("source_key", COMMUNITY_HALF_LIFE, 150)} WHEN 'video' THEN 360 ELSE {case_of("source_key", NEWS_HALF_LIFE, 240)} END) AS freshness,
    greatest(0.5, 1 + 0.75 * tanh((eng - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END / 1.5)) AS engagement FROM ages JOIN es ON category = k)"""


def where_posts(df: DataFrame, source=None, category=None, subcategory=None, q: str | None = None, hide: tuple = (), photo_prefix: str | None = "[사진]", since: Column | None = None) -> DataFrame:
    """Posts that meet all conditions given; search ignores case and takes ``%`` and ``_`` as they are."""
    many = lambda x: list(x) if isinstance(x, list | tuple | set) else [x]
    for name, wanted in (("source_key", source), ("category", category), ("subcategory", subcategory)):
        if wanted is not None:
            df = df.where(F.col(name).isin(*many(wanted)))
    if hide:
        df = df.where(F.col("subcategory").isNull() | ~F.col("subcategory").isin(*hide))
    if q:
        df = df.where(F.contains(F.lower("title"), F.lower(F.lit(q))))
    if photo_prefix:
        df = df.where(~F.coalesce(F.col("title").startswith(photo_prefix), F.lit(False)))
    return df if since is None else df.where(F.col("scraped_at") > since)


def title_key(title: str, post: str) -> Column:
    """What duplicates share: the normalised title's hash; posts without a title are each their own."""
    return F.when(normalize_title(F.col(title)) == "", F.concat(F.lit("post "), F.col(post).cast("string"))).otherwise(title_hash(F.col(title)))


def trending(scored: DataFrame, first: int = 30, shown: int = 20) -> DataFrame:
    """The best ``first`` posts, one for each normalised title, of these the best ``shown``."""
    top = scored.orderBy(F.desc("trend_score"), F.desc("id")).limit(first)
    # at most `first` rows from here on
    own = Window.partitionBy(title_key("title", "id")).orderBy(F.desc("trend_score"), F.desc("id"))
    return top.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n").orderBy(F.desc("trend_score"), F.desc("id")).limit(shown)


def trending_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_posts(posts(spark, sf_dir), as_of())
    rounded = scored.withColumn("trend_score", F.round("trend_score", 6))
    return trending(rounded).select("id", "source_key", "category", "title", "trend_score")


def v8_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_posts(posts(spark, sf_dir), as_of())
    return scored.select("id", "category", *[F.round(c, 6).alias(c) for c in ("authority", "freshness", "engagement", "trend_score")])


FINAL_SQL = """raws AS (SELECT *, authority * freshness * engagement AS raw FROM factors),
  rs AS (SELECT category AS k2, avg(ln(1 + raw)) AS m2, stddev_pop(ln(1 + raw)) AS sd2 FROM raws GROUP BY 1),
  scored AS (SELECT raws.*, round(greatest(0, 2.5 + (ln(1 + raw) - m2) / CASE WHEN sd2 > 0 THEN sd2 ELSE 1 END), 6) AS trend_score FROM raws JOIN rs ON category = k2)"""


def posts_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = where_posts(posts(spark, sf_dir), category=["news", "portal"], hide=("sub1",), q="THE", since=as_of("2024-01-21 00:00:00"))
    latest = (F.coalesce("published_at", "scraped_at").desc(), F.desc("id"))
    return df.orderBy(*latest).offset(20).limit(20).select("id", "source_key", "category", "subcategory", "title")


def posts_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.get_json_object("metadata", "$.rank").try_cast("int")
    return posts(spark, sf_dir).withColumn("rank", rank.cast("long")).where("rank IS NOT NULL").orderBy("rank", "id").limit(100).select("id", "rank", "title")


def posts_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct(F.col("view_count").cast("long").alias("v"), F.col("id").alias("i"))
    after = F.struct(F.lit(4000).cast("long").alias("v"), F.lit(500).cast("long").alias("i"))
    return posts(spark, sf_dir).where(key < after).orderBy(F.desc("view_count"), F.desc("id")).limit(25).select("id", F.col("view_count").cast("long").alias("view_count"))


def posts_latest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of their source's last successful batch: not older than two hours before its end."""
    runs = scraper_runs(spark, sf_dir).where("error_message IS NULL").groupBy("source_key").agg(F.max("finished_at").alias("last"))
    df = posts(spark, sf_dir).join(runs, "source_key")
    return df.where("scraped_at >= last - INTERVAL 2 HOUR").groupBy("source_key").agg(F.count("*").alias("posts"), F.max("id").alias("newest"))


def source_engagement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(posts(spark, sf_dir), "source_key")


def channel_engagement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(posts(spark, sf_dir), "category")


def _stats(df: DataFrame, key: str) -> DataFrame:
    """Mean and sample deviation (0.1 at least) of the logs of the counters, of posts with views."""
    aggs = [F.count("*").alias("sample_count")]
    for name in ("view", "comment", "like"):
        x = F.log1p(f"{name}_count")
        aggs += [F.round(F.avg(x), 6).alias(f"mean_{name}"), F.round(F.greatest(F.stddev_samp(x), F.lit(0.1)), 6).alias(f"std_{name}")]
    return df.where("view_count > 0").groupBy(key).agg(*aggs)


def _stats_sql(key: str) -> str:
    cols = ", ".join(f"round(avg(ln(1 + {n}_count)), 6) AS mean_{n}, round(greatest(stddev_samp(ln(1 + {n}_count)), 0.1), 6) AS std_{n}" for n in ("view", "comment", "like"))
    return f"WITH {POSTS_SQL} SELECT {key}, count(*) AS sample_count, {cols} FROM posts WHERE view_count > 0 GROUP BY 1"


def category_median_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).groupBy("category").agg(F.round(F.percentile(F.log1p("view_count"), F.lit(0.5)), 6).alias("median_views"))


def subcategory_percent_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile of each post in its subcategory, as a category weight .8 + .6 p.

    Equal values are counted first, so a window sorts distinct values, not posts.
    """
    df = posts(spark, sf_dir).where("subcategory IS NOT NULL").select("id", "subcategory", F.col("view_count").alias("v"))
    counts = df.groupBy("subcategory", "v").agg(F.count("*").alias("n"))
    below = Window.partitionBy("subcategory").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy("subcategory")
    share = F.when(F.sum("n").over(everyone) > 1, F.coalesce(F.sum("n").over(below), F.lit(0)) / (F.sum("n").over(everyone) - 1)).otherwise(0.0)
    ranks = counts.select("subcategory", "v", share.alias("p"))
    return df.join(ranks, ["subcategory", "v"]).select("id", "subcategory", F.round("p", 6).alias("percentile"), F.round(0.8 + 0.6 * F.col("p"), 6).alias("weight"))


def title_hash_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of posts of one normalised title; the canonical one has most views, then is the latest."""
    df = posts(spark, sf_dir).where(normalize_title(F.col("title")) != "")
    best = F.max_by("id", F.struct("view_count", "scraped_at", -F.col("id")))
    return df.groupBy(title_hash(F.col("title")).alias("title_hash")).agg(F.count("*").alias("members"), F.countDistinct("source_key").alias("sources"), best.alias("canonical_id")).where("members > 1")


def posts_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest post of each title: the first row of a key."""
    df = posts(spark, sf_dir)
    return df.groupBy(title_key("title", "id").alias("k")).agg(F.max_by("id", F.struct("scraped_at", "id")).alias("id"), F.count("*").alias("n")).select("id", "n")


def community_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = posts(spark, sf_dir).where("category IN ('community', 'portal')").where(F.col("scraped_at") > as_of("2024-01-24 00:00:00"))
    nonzero = lambda c: F.avg(F.when(F.col(c) != 0, F.col(c)))
    score = 0.4 * F.coalesce(nonzero("view_count"), F.lit(0)) + 35 * F.coalesce(nonzero("comment_count"), F.lit(0)) + 12.5 * F.coalesce(nonzero("like_count"), F.lit(0))
    return df.groupBy("source_key", "source_name").agg(
        F.count("*").alias("post_count"), F.sum("view_count").cast("long").alias("total_views"), F.sum("comment_count").cast("long").alias("total_comments"),
        F.round(nonzero("view_count"), 4).alias("avg_views"), F.round(score, 4).alias("score"),
    ).orderBy(F.desc("score"), "source_key")


def dampening(counts: DataFrame) -> DataFrame:
    """``counts`` (source_key, n): sources of more posts than the upper median source are damped, to 0.7 at least."""
    median = F.element_at(F.sort_array(F.collect_list("n")), (F.floor(F.count("*") / 2) + 1).cast("int"))
    # one row per source
    total = counts.agg(median.alias("median"))
    damped = F.when(F.col("n") > F.col("median"), F.greatest(F.lit(0.7), 1 - 0.15 * F.log(F.col("n") / F.col("median")))).otherwise(1.0)
    return counts.join(F.broadcast(total)).select("source_key", "n", "median", F.round(damped, 6).alias("dampening"))


def volume_dampening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dampening(posts(spark, sf_dir).groupBy("source_key").agg(F.count("*").alias("n")))


def cluster_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(1 + .3 log2 n)(1 + .1 min(categories - 1, 3)), for 3 news sources or more another 15 % each, 3 at most."""
    df = posts(spark, sf_dir).where(normalize_title(F.col("title")) != "").groupBy(title_hash(F.col("title")).alias("title_hash")).agg(
        F.max_by("id", F.struct("view_count", "scraped_at", -F.col("id"))).alias("id"), F.count("*").alias("n"), F.countDistinct("category").alias("categories"),
        F.countDistinct(F.when(F.col("category") == "news", F.col("source_key"))).alias("news"),
    ).where("n > 1")
    bonus = (1 + 0.3 * F.log2("n")) * (1 + 0.1 * F.least(F.col("categories") - 1, F.lit(3)))
    bonus = bonus * F.when(F.col("news") >= 3, 1 + 0.15 * F.least(F.col("news") - 2, F.lit(5))).otherwise(1.0)
    return df.select("id", "n", F.round(F.least(F.lit(3.0), bonus), 6).alias("bonus"))


# Wire agencies whose own flashes count, and what marks a flash.
WIRES = ("yna", "newsis", "ytn")
FLASH = r"(?i)속보|긴급|flash|breaking"


def breaking_boost(p: DataFrame, members: DataFrame, at: Column, hours: float = 2, spread: float = 30, half_life: float = 30, sources: int = 3) -> DataFrame:
    """(id, bonus): 1 + 2 * 2^(-age / half_life) for a cluster's canonical post if news of ``sources`` or more tell
    it within ``spread`` minutes; 1 + 2^(-age / half_life) for a wire's own flash, unless the first is 2 or more.

    ``members`` has cluster_id and post id; clusters and flashes of the last ``hours`` count.
    """
    age = lambda c: F.timestamp_diff("MICROSECOND", F.col(c), at) / 6e7
    recent = F.col("first") > at - F.make_dt_interval(mins=F.lit(int(hours * 60)))
    g = p.join(members, "id").groupBy("cluster_id").agg(
        F.countDistinct(F.when(F.col("category") == "news", F.col("source_key"))).alias("sources"), F.min("scraped_at").alias("first"),
        F.min(F.when(F.col("category") == "news", F.col("scraped_at"))).alias("a"), F.max(F.when(F.col("category") == "news", F.col("scraped_at"))).alias("z"),
        F.max_by("id", F.struct("view_count", "scraped_at", -F.col("id"))).alias("id"),
    )
    many = g.where(recent & (F.col("sources") >= sources) & (F.timestamp_diff("MICROSECOND", F.col("a"), F.col("z")) / 6e7 < spread))
    many = many.select("id", F.least(F.lit(3.0), 1 + 2 * F.pow(F.lit(2.0), -age("a") / half_life)).alias("x"))
    wire = p.where(F.col("source_key").isin(*WIRES) & F.col("category").isin("news", "portal") & F.col("title").rlike(FLASH))
    wire = wire.withColumnRenamed("scraped_at", "first").where(recent).select("id", F.least(F.lit(2.0), 1 + F.pow(F.lit(2.0), -age("first") / half_life)).alias("y"))
    both = many.join(wire, "id", "full_outer")
    return both.select("id", F.when(F.col("x") >= 2, F.col("x")).otherwise(F.greatest("x", "y")).alias("bonus"))


#: The test tables spread over two weeks, so this query looks back and lets stories spread further than the defaults.
STRETCHED = {"hours": 24 * 7, "spread": 4000, "half_life": 3000}


def breaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    members = p.where(normalize_title(F.col("title")) != "").select("id", title_hash(F.col("title")).alias("cluster_id"))
    return breaking_boost(p, members, as_of(), **STRETCHED, sources=2).select("id", F.round("bonus", 6).alias("bonus"))


def portal_scores(p: DataFrame, members: DataFrame, at: Column, hours: int = 24, longest: int = 30, half_life: float = 6.0) -> DataFrame:
    """(id, score): portal posts of the last ``hours`` by rank (1 to ``longest``) and age, times their source's
    multiplier; news of one cluster take their source's share of it. The best counts.

    ``members`` has cluster_id and post id. Each cluster is reached by its two best shares: a post isn't its own sibling.
    """
    rank = clamp(F.get_json_object("metadata", "$.rank").try_cast("int"), 1, longest)
    age = F.timestamp_diff("MICROSECOND", F.col("scraped_at"), at) / 3.6e9
    own = p.where(F.col("source_key").isin(*PORTAL) & (F.col("scraped_at") > at - F.make_dt_interval(hours=F.lit(hours))) & F.get_json_object("metadata", "$.rank").try_cast("int").isNotNull())
    score = 10 * (1 - (rank - 1) / longest) * F.pow(F.lit(2.0), -age / half_life) * lookup(F.col("source_key"), {k: v[0] for k, v in PORTAL.items()})
    own = own.select("id", score.alias("score"), lookup(F.col("source_key"), {k: v[1] for k, v in PORTAL.items()}).alias("share"))
    shared = own.join(members, "id").select("cluster_id", "id", (F.col("score") * F.col("share")).alias("passed"))
    first = shared.groupBy("cluster_id").agg(F.max(F.struct("passed", "id")).alias("first"))
    second = shared.join(first, "cluster_id").where("id <> first.id").groupBy("cluster_id").agg(F.max("passed").alias("second"))
    best = first.join(second, "cluster_id", "left")
    news = p.where("category IN ('news', 'newsletter', 'portal')").select("id").join(members, "id").join(best, "cluster_id")
    passed = news.select("id", F.when(F.col("id") == F.col("first.id"), F.col("second")).otherwise(F.col("first.passed")).alias("score"))
    return own.select("id", "score").unionByName(passed).where("score IS NOT NULL").groupBy("id").agg(F.max("score").alias("score"))


def portal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    members = p.where(normalize_title(F.col("title")) != "").select("id", title_hash(F.col("title")).alias("cluster_id"))
    return portal_scores(p, members, as_of(), hours=24 * 7).select("id", F.round("score", 6).alias("portal_score"))


def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth per hour between the first and last snapshot of each post, if they span enough time, and the bonus it gives."""
    s = snapshots(spark, sf_dir)
    at = F.struct("captured_at", "id")
    df = s.groupBy("post_id").agg(*[(F.max_by(c, at) - F.min_by(c, at)).alias(c) for c in ("view_count", "comment_count", "like_count")], F.min("captured_at").alias("a"), F.max("captured_at").alias("z"))
    hours = F.timestamp_diff("MICROSECOND", F.col("a"), F.col("z")) / 3.6e9
    df = df.withColumn("hours", hours).where("hours > 0.15")
    rates = [F.col(c) / F.greatest(F.col("hours"), F.lit(0.17)) for c in ("view_count", "comment_count", "like_count")]
    has_likes = F.col("post_id") % 2 == 0
    return df.select(
        "post_id", *[F.round(r, 6).alias(n) for r, n in zip(rates, ("views", "comments", "likes"), strict=True)],
        F.round(velocity_bonus(*rates), 6).alias("bonus"), F.round(community_velocity_bonus(*rates, has_likes), 6).alias("community_bonus"),
    )


def first_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_per(snapshots(spark, sf_dir), "post_id", 20, F.col("captured_at"), F.col("id"))
    return top.select("post_id", F.col("rn").cast("long").alias("rn"), "id", F.col("view_count").cast("long").alias("view_count"))


def token_df_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title words' document frequency in the last day and before it; those that burst."""
    words = F.array_distinct(F.filter(F.split(normalize_title(F.col("title")), " "), lambda w: F.length(w) >= 3))
    df = posts(spark, sf_dir).select("id", (F.col("scraped_at") > as_of("2024-01-30 00:00:00")).alias("recent"), F.explode(words).alias("token"))
    n = posts(spark, sf_dir).agg(F.count_if(F.col("scraped_at") > as_of("2024-01-30 00:00:00")).alias("n24"), F.count("*").alias("n"))
    counts = df.groupBy("token").agg(F.count_if("recent").alias("df24"), F.count("*").alias("df"))
    rate24, rate = F.col("df24") / F.col("n24"), F.col("df") / F.col("n")
    return counts.join(F.broadcast(n)).where((rate24 >= 0.01) & (rate24 >= 2 * rate)).select("token", "df24", "df", F.round(rate24 / rate, 6).alias("burst"))


def keyword_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest words of distinct titles."""
    words = F.explode(F.filter(F.split(normalize_title(F.col("title")), " "), lambda w: F.length(w) >= 4))
    return posts(spark, sf_dir).select("title").distinct().select(words.alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "keyword").limit(10)


def history_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of all posts by trend score."""
    scored = score_posts(posts(spark, sf_dir), as_of()).select("id", F.round("trend_score", 6).alias("score"))
    return ranked(scored, F.desc("score"), F.asc("id")).select("id", F.col("rank").alias("rank_position"), "score")


def news_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clamp((z + 2) 2.5, 0, 10) over ln(1 + V + 3C + 2L) of news posts."""
    df = posts(spark, sf_dir).where("category = 'news'").select("id", F.log1p(F.col("view_count") + 3 * F.col("comment_count") + 2 * F.col("like_count")).alias("x"))
    stats = df.agg(F.avg("x").alias("m"), F.greatest(F.stddev_samp("x"), F.lit(0.1)).alias("s"))
    return df.join(F.broadcast(stats)).select("id", F.round(clamp(((F.col("x") - F.col("m")) / F.col("s") + 2) * 2.5, 0.0, 10.0), 6).alias("news_engagement"))


def best_per_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = posts(spark, sf_dir).withColumn("e", F.round(engagement_sum(), 6))
    return top_per(df, "category", 10, F.desc("e"), F.col("id")).select("category", F.col("rn").cast("long").alias("rn"), "id", "e")


QUERIES = {f.__name__: f for f in (
    trending_top20, v8_base_scores, posts_filtered_page, posts_ranked, posts_keyset_page, posts_latest_batch, source_engagement_stats, channel_engagement_stats,
    category_median_engagement, subcategory_percent_rank, title_hash_clusters, posts_deduplicated, community_ranking, volume_dampening, cluster_bonus, breaking,
    portal_rank, velocity, first_snapshots, token_df_burst, keyword_mining, history_rank, news_engagement, best_per_channel,
)}
H = f"md5({NORMAL_SQL})"
KEY_SQL = f"CASE WHEN {NORMAL_SQL} = '' THEN 'post ' || id ELSE {H} END"
ORACLE_SQL = {
    "trending_top20": f"""WITH {POSTS_SQL}, {SCORED_SQL}, {FINAL_SQL}, top AS (SELECT * FROM scored ORDER BY trend_score DESC, id DESC LIMIT 30),
      one AS (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY trend_score DESC, id DESC) AS n FROM top)
      SELECT id, source_key, category, title, trend_score FROM one WHERE n = 1 ORDER BY trend_score DESC, id DESC LIMIT 20""",
    "v8_base_scores": f"WITH {POSTS_SQL}, {SCORED_SQL}, {FINAL_SQL} SELECT id, category, round(authority::DOUBLE, 6) AS authority, round(freshness, 6) AS freshness, round(engagement, 6) AS engagement, trend_score FROM scored",
    "posts_filtered_page": f"""WITH {POSTS_SQL} SELECT id, source_key, category, subcategory, title FROM posts WHERE category IN ('news', 'portal') AND (subcategory IS NULL OR subcategory NOT IN ('sub1'))
      AND contains(lower(title), 'the') AND title NOT LIKE '[사진]%' AND scraped_at > TIMESTAMP '2024-01-21' ORDER BY coalesce(published_at, scraped_at) DESC, id DESC LIMIT 20 OFFSET 20""",
    "posts_ranked": f"WITH {POSTS_SQL} SELECT id, try_cast(json_extract_string(metadata, '$.rank') AS BIGINT) AS rank, title FROM posts WHERE try_cast(json_extract_string(metadata, '$.rank') AS BIGINT) IS NOT NULL ORDER BY rank, id LIMIT 100",
    "posts_keyset_page": f"WITH {POSTS_SQL} SELECT id, view_count::BIGINT AS view_count FROM posts WHERE view_count < 4000 OR (view_count = 4000 AND id < 500) ORDER BY view_count DESC, id DESC LIMIT 25",
    "posts_latest_batch": f"""WITH {POSTS_SQL}, {RUNS_SQL} SELECT source_key, count(*) AS posts, max(id) AS newest FROM posts p
      WHERE scraped_at >= (SELECT max(finished_at) FROM runs r WHERE r.source_key = p.source_key AND error_message IS NULL) - INTERVAL 2 HOUR GROUP BY 1""",
    "source_engagement_stats": _stats_sql("source_key"),
    "channel_engagement_stats": _stats_sql("category"),
    "category_median_engagement": f"WITH {POSTS_SQL} SELECT category, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY ln(1 + view_count)), 6) AS median_views FROM posts GROUP BY 1",
    "subcategory_percent_rank": f"""WITH {POSTS_SQL}, r AS (SELECT id, subcategory, percent_rank() OVER (PARTITION BY subcategory ORDER BY view_count) AS p FROM posts WHERE subcategory IS NOT NULL)
      SELECT id, subcategory, round(p, 6) AS percentile, round(0.8 + 0.6 * p, 6) AS weight FROM r""",
    "title_hash_clusters": f"""WITH {POSTS_SQL} SELECT {H} AS title_hash, count(*) AS members, count(DISTINCT source_key) AS sources, first(id ORDER BY view_count DESC, scraped_at DESC, id) AS canonical_id
      FROM posts WHERE {NORMAL_SQL} <> '' GROUP BY 1 HAVING count(*) > 1""",
    "posts_deduplicated": f"WITH {POSTS_SQL}, r AS (SELECT id, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY scraped_at DESC, id DESC) AS k, count(*) OVER (PARTITION BY {KEY_SQL}) AS n FROM posts) SELECT id, n FROM r WHERE k = 1",
    "community_ranking": f"""WITH {POSTS_SQL} SELECT source_key, source_name, count(*) AS post_count, sum(view_count)::BIGINT AS total_views, sum(comment_count)::BIGINT AS total_comments, round(avg(nullif(view_count, 0)), 4) AS avg_views,
      round(0.4 * coalesce(avg(nullif(view_count, 0)), 0) + 35 * coalesce(avg(nullif(comment_count, 0)), 0) + 12.5 * coalesce(avg(nullif(like_count, 0)), 0), 4) AS score
      FROM posts WHERE category IN ('community', 'portal') AND scraped_at > TIMESTAMP '2024-01-24' GROUP BY 1, 2 ORDER BY score DESC, source_key""",
    "volume_dampening": f"""WITH {POSTS_SQL}, c AS (SELECT source_key, count(*) AS n FROM posts GROUP BY 1),
      m AS (SELECT list_sort(list(n))[(count(*) // 2) + 1] AS median FROM c)
      SELECT source_key, n, median, round(CASE WHEN n > median THEN greatest(0.7, 1 - 0.15 * ln(n / median)) ELSE 1.0 END, 6) AS dampening FROM c, m""",
    "cluster_bonus": f"""WITH {POSTS_SQL}, g AS (SELECT first(id ORDER BY view_count DESC, scraped_at DESC, id) AS id, count(*) AS n, count(DISTINCT category) AS c, count(DISTINCT CASE WHEN category = 'news' THEN source_key END) AS w
      FROM posts WHERE {NORMAL_SQL} <> '' GROUP BY {H} HAVING count(*) > 1)
      SELECT id, n, round(least(3.0, (1 + 0.3 * log2(n)) * (1 + 0.1 * least(c - 1, 3)) * CASE WHEN w >= 3 THEN 1 + 0.15 * least(w - 2, 5) ELSE 1 END), 6) AS bonus FROM g""",
    "breaking": f"""WITH {POSTS_SQL}, g AS (SELECT count(DISTINCT source_key) FILTER (WHERE category = 'news') AS s, min(scraped_at) AS f, min(scraped_at) FILTER (WHERE category = 'news') AS a, max(scraped_at) FILTER (WHERE category = 'news') AS z,
        first(id ORDER BY view_count DESC, scraped_at DESC, id) AS id FROM posts WHERE {NORMAL_SQL} <> '' GROUP BY {H}),
      m AS (SELECT id, least(3.0, 1 + 2 * pow(2.0, -(date_diff('microsecond', a, TIMESTAMP '{AS_OF}') / 6e7) / {STRETCHED["half_life"]})) AS x FROM g
        WHERE s >= 2 AND f > TIMESTAMP '{AS_OF}' - INTERVAL {STRETCHED["hours"]} HOUR AND date_diff('microsecond', a, z) / 6e7 < {STRETCHED["spread"]}),
      w AS (SELECT id, least(2.0, 1 + pow(2.0, -(date_diff('microsecond', scraped_at, TIMESTAMP '{AS_OF}') / 6e7) / {STRETCHED["half_life"]})) AS y FROM posts
        WHERE source_key IN ('yna', 'newsis', 'ytn') AND category IN ('news', 'portal') AND regexp_matches(title, '(?i)속보|긴급|flash|breaking') AND scraped_at > TIMESTAMP '{AS_OF}' - INTERVAL {STRETCHED["hours"]} HOUR)
      SELECT id, round(CASE WHEN x >= 2 THEN x ELSE greatest(x, y) END, 6) AS bonus FROM m FULL JOIN w USING (id)""",
    "portal_rank": f"""WITH {POSTS_SQL}, r AS (SELECT *, greatest(1, least(30, try_cast(json_extract_string(metadata, '$.rank') AS INT))) AS rank, date_diff('microsecond', scraped_at, TIMESTAMP '{AS_OF}') / 3.6e9 AS hours FROM posts
        WHERE try_cast(json_extract_string(metadata, '$.rank') AS INT) IS NOT NULL AND scraped_at > TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR AND source_key IN ({", ".join(f"'{k}'" for k in PORTAL)})),
      own AS (SELECT id, title, 10 * (1 - (rank - 1) / 30) * pow(2.0, -hours / 6) * {case_of("source_key", {k: v[0] for k, v in PORTAL.items()}, 0.5)}::DOUBLE AS score, {case_of("source_key", {k: v[1] for k, v in PORTAL.items()}, 0.5)}::DOUBLE AS share FROM r),
      o AS (SELECT *, {H} AS h FROM own), p AS (SELECT *, {H} AS h FROM posts WHERE {NORMAL_SQL} <> '' AND category IN ('news', 'portal')),
      u AS (SELECT id, score FROM own UNION ALL SELECT p.id, o.score * o.share FROM p JOIN o ON p.h = o.h AND p.id <> o.id)
      SELECT id, round(max(score), 6) AS portal_score FROM u GROUP BY 1""",
    "velocity": f"""WITH {SNAPSHOTS_SQL}, v AS (SELECT DISTINCT post_id, last_value(view_count) OVER w - first_value(view_count) OVER w AS vc, last_value(comment_count) OVER w - first_value(comment_count) OVER w AS cc,
        last_value(like_count) OVER w - first_value(like_count) OVER w AS lc, date_diff('microsecond', min(captured_at) OVER w, max(captured_at) OVER w) / 3.6e9 AS hours FROM snapshots
        WINDOW w AS (PARTITION BY post_id ORDER BY captured_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
      r AS (SELECT post_id, vc / greatest(hours, 0.17) AS v, cc / greatest(hours, 0.17) AS c, lc / greatest(hours, 0.17) AS l FROM v WHERE hours > 0.15)
      SELECT post_id, round(v, 6) AS views, round(c, 6) AS comments, round(l, 6) AS likes, round(1 + least((ln(1 + v) + 2 * ln(1 + c) + 2.5 * ln(1 + l)) / 10, 0.5), 6) AS bonus,
        round(1 + least(CASE WHEN post_id % 2 = 0 THEN ln(1 + v) + 3 * ln(1 + c) + 3 * ln(1 + l) ELSE 1.75 * (ln(1 + v) + 3 * ln(1 + c)) END / 8, 0.6), 6) AS community_bonus FROM r""",
    "first_snapshots": f"WITH {SNAPSHOTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY captured_at, id) AS rn FROM snapshots) SELECT post_id, rn, id, view_count::BIGINT AS view_count FROM r WHERE rn <= 20",
    "token_df_burst": f"""WITH {POSTS_SQL}, t AS (SELECT DISTINCT id, scraped_at > TIMESTAMP '2024-01-30' AS recent, unnest(string_split({NORMAL_SQL}, ' ')) AS token FROM posts),
      n AS (SELECT count(*) FILTER (WHERE scraped_at > TIMESTAMP '2024-01-30') AS n24, count(*) AS n FROM posts),
      c AS (SELECT token, count(*) FILTER (WHERE recent) AS df24, count(*) AS df FROM t WHERE length(token) >= 3 GROUP BY 1)
      SELECT token, df24, df, round((df24 / n24) / (df / n), 6) AS burst FROM c, n WHERE df24 / n24 >= 0.01 AND df24 / n24 >= 2 * (df / n)""",
    "keyword_mining": f"WITH {POSTS_SQL}, d AS (SELECT DISTINCT title FROM posts), t AS (SELECT unnest(string_split({NORMAL_SQL}, ' ')) AS keyword FROM d) SELECT keyword, count(*) AS n FROM t WHERE length(keyword) >= 4 GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, keyword LIMIT 10",
    "history_rank": f"WITH {POSTS_SQL}, {SCORED_SQL}, {FINAL_SQL} SELECT id, row_number() OVER (ORDER BY trend_score DESC, id) AS rank_position, trend_score AS score FROM scored",
    "news_engagement": f"""WITH {POSTS_SQL}, x AS (SELECT id, ln(1 + view_count + 3 * comment_count + 2 * like_count) AS x FROM posts WHERE category = 'news'), s AS (SELECT avg(x) AS m, greatest(stddev_samp(x), 0.1) AS s FROM x)
      SELECT id, round(least(10.0, greatest(0.0, ((x - m) / s + 2) * 2.5)), 6) AS news_engagement FROM x, s""",
    "best_per_channel": f"WITH {POSTS_SQL}, e AS (SELECT *, round(ln(1 + view_count + 2 * comment_count + 3 * like_count), 6) AS e FROM posts), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY e DESC, id) AS rn FROM e) SELECT category, rn, id, e FROM r WHERE rn <= 10",
}
