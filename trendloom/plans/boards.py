"""Boards: posts of issues by channel, charts as they are listed, rankings by period, answers to votes, sizes of clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from ..model import AS_OF, POSTS_SQL, as_of, posts, read
from ..operators.scoring import top_per
from ..operators.work import work_table
from .details import _HELD, _issues
from .health import size_percentiles
from .posts import NORMAL_SQL

#: Posts of an issue that are listed in each group, and items of a chart.
LISTED, CHART = 10, 5
#: Days of each period of a ranking.
PERIODS = {"today": 1, "7d": 7, "30d": 30}
#: Clusters of more posts than this are counted.
LARGE = 50


def issue_channel_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first posts of each issue among news and portals, videos, and all others: those of most views, then least ids."""
    p, held = _issues(spark, sf_dir)
    group = F.when(F.col("category").isin("news", "portal"), "news").when(F.col("category") == "video", "video").otherwise("community")
    mine = held.select("issue", "id").distinct().join(p.select("id", group.alias("channel_group"), "view_count"), "id")
    best = top_per(mine, ["issue", "channel_group"], LISTED, F.desc("view_count"), F.asc("id"))
    return best.select("issue", "channel_group", F.col("rn").cast("long").alias("place"), "id")


def list_charts(p: DataFrame, most: int = CHART) -> DataFrame:
    """(source_key, unified_rank, id, rank) of posts (id, source_key, title, scraped_at, metadata) with a number as rank.

    Of posts of one normalised title a chart keeps the latest, of equals the least id; items are ordered by
    rank, then as they came, and only the first ``most`` are listed.
    """
    rank = F.get_json_object("metadata", "$.rank").try_cast("double")
    listed = p.select("source_key", "id", "scraped_at", normalize_title(F.col("title")).alias("norm"), rank.alias("rank")).where("rank IS NOT NULL")
    # one of each title, by a grouped maximum
    latest = F.struct(F.coalesce(F.unix_micros(F.col("scraped_at").cast("timestamp")), F.lit(-(1 << 62))).alias("t"), F.negate("id").alias("least"), "rank")
    once = listed.groupBy("source_key", "norm").agg(F.max(latest).alias("m"))
    once = once.select("source_key", F.negate("m.least").alias("id"), "m.rank", "m.t")
    best = top_per(once, "source_key", most, F.asc("rank"), F.desc("t"), F.asc("id"))
    return best.select("source_key", F.col("rn").cast("long").alias("unified_rank"), "id", "rank")


def listed_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's chart."""
    return list_charts(posts(spark, sf_dir))


def rank_communities(p: DataFrame, at, periods: dict = PERIODS) -> DataFrame:
    """Community sources of each period by their mean engagement, without zeros.

    Means and scores are rounded to whole numbers; equal scores are ordered by source. Rows are counted
    once for each period that they fall into and combined before the shuffle; what is ranked is a row a source.
    """
    within = [F.when(F.col("scraped_at") >= at - F.make_dt_interval(F.lit(days)), F.lit(name)) for name, days in periods.items()]
    rows = p.where("category = 'community'").withColumn("period", F.explode(F.filter(F.array(*within), lambda x: x.isNotNull())))
    mean = lambda c: F.coalesce(F.avg(F.nullif(F.col(c), F.lit(0))), F.lit(0.0))
    whole = lambda c: F.round(c).cast("long")
    score = mean("view_count") * 0.4 + mean("comment_count") * 100 * 0.35 + mean("like_count") * 50 * 0.25
    totals = [F.coalesce(F.sum(f"{c}_count"), F.lit(0)).cast("long").alias(f"total_{c}s") for c in ("view", "comment", "like")]
    means = [whole(mean(f"{c}_count")).alias(f"avg_{c}s") for c in ("view", "comment", "like")]
    board = rows.groupBy("period", "source_key", "source_name").agg(F.count("*").alias("post_count"), *totals, *means, whole(score).alias("score"))
    return board.withColumn("rank", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("score"), "source_key", "source_name")).cast("long"))


def community_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_communities(posts(spark, sf_dir), as_of())


def answer_votes(votes: DataFrame) -> DataFrame:
    """(id, is_new, vote_count) of votes (id, post_id, voter, at): whether it is its voter's first on the post, and the post's votes after it.

    Votes without post or voter have no answer; ones without a time come first, equal times go by id. Counts run
    over a post's hours, then within an hour, so that a much voted post isn't one task's.
    """
    named = votes.where("post_id IS NOT NULL AND voter IS NOT NULL").select("id", "post_id", "voter", "at")
    named = work_table(named.withColumn("hour", F.coalesce(F.date_trunc("hour", F.col("at").cast("timestamp")), F.lit("0001-01-01").cast("timestamp"))), "votes")
    firsts = named.groupBy("post_id", "voter").agg(F.min(F.struct("at", "id")).alias("first")).select(F.col("first.id").alias("id"), F.lit(1).alias("new"))
    marked = work_table(named.join(firsts, "id", "left").select("id", "post_id", "at", "hour", F.coalesce("new", F.lit(0)).alias("new")), "votes")
    hours = Window.partitionBy("post_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    before = marked.groupBy("post_id", "hour").agg(F.sum("new").alias("n")).select("post_id", "hour", F.coalesce(F.sum("n").over(hours), F.lit(0)).alias("before"))
    running = Window.partitionBy("post_id", "hour").orderBy(F.asc_nulls_first("at"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.join(before, ["post_id", "hour"]).select("id", (F.col("new") == 1).alias("is_new"), (F.sum("new").over(running) + F.col("before")).alias("vote_count"))


def vote_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_votes(read(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id AS post_id", "props AS voter", "ts AS at"))


def measure_clusters(members: DataFrame) -> DataFrame:
    """(metric_name, value) of clusters' members (cluster_id, source_key): sizes, large and single ones, and their sources.

    Without members there is one row, of no clusters. Equal sizes are counted before percentiles are taken.
    """
    clusters = work_table(members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.countDistinct("source_key").alias("sources")), "clusters")
    both = clusters.select(F.explode(F.array(*[F.struct(F.lit(x).alias("kind"), F.col(x).alias("n")) for x in ("size", "sources")])).alias("x")).select("x.*")
    shares = size_percentiles(both, "kind", "n")
    names = {"size": ("p50", "p95", "p99", "most"), "sources": ("p50", "p95")}
    spread = [F.when(F.col("kind") == kind, F.array(*[F.struct(F.lit(f"cluster.{kind}_{'max' if x == 'most' else x}").alias("metric_name"), F.col(x).cast("double").alias("value")) for x in of])) for kind, of in names.items()]
    found = shares.select(F.explode(F.coalesce(*spread)).alias("m")).select("m.*")
    counts = clusters.agg(F.count("*").alias("total"), F.count_if(F.col("size") > LARGE).alias("large"), F.count_if(F.col("size") == 1).alias("single"), F.avg("sources").alias("sources"))
    rows = {"cardinality_total": F.col("total"), f"size_over{LARGE}_count": F.col("large"), "singleton_ratio": F.try_divide("single", "total"), "source_diversity_avg": F.col("sources")}
    flat = counts.select(F.explode(F.array(*[F.struct(F.lit(f"cluster.{n}").alias("metric_name"), v.cast("double").alias("value")) for n, v in rows.items()])).alias("m"), "total").where("total > 0 OR m.metric_name = 'cluster.cardinality_total'")
    return flat.select("m.*").unionByName(found).select("metric_name", F.round("value", 6).alias("value"))


def cluster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters are posts of one normalised title."""
    return measure_clusters(posts(spark, sf_dir).select(normalize_title(F.col("title")).alias("cluster_id"), "source_key").where("cluster_id <> ''"))


QUERIES = {f.__name__: f for f in (issue_channel_posts, listed_charts, community_boards, vote_answers, cluster_metrics)}
_WHOLE = lambda c: f"coalesce(avg(nullif({c}_count, 0)), 0)"
ORACLE_SQL = {
    "issue_channel_posts": f"""WITH {_HELD}, g AS (SELECT DISTINCT issue, id, view_count, CASE WHEN category IN ('news', 'portal') THEN 'news' WHEN category = 'video' THEN 'video' ELSE 'community' END AS channel_group FROM j),
      r AS (SELECT issue, channel_group, row_number() OVER (PARTITION BY issue, channel_group ORDER BY view_count DESC, id) AS place, id FROM g) SELECT * FROM r WHERE place <= {LISTED}""",
    "listed_charts": f"""WITH {POSTS_SQL}, n AS (SELECT source_key, id, scraped_at, {NORMAL_SQL} AS norm, try_cast(json_extract_string(metadata, '$.rank') AS DOUBLE) AS rank FROM posts),
      o AS (SELECT *, row_number() OVER (PARTITION BY source_key, norm ORDER BY scraped_at DESC, id) AS rn FROM n WHERE rank IS NOT NULL),
      r AS (SELECT source_key, row_number() OVER (PARTITION BY source_key ORDER BY rank, scraped_at DESC, id) AS unified_rank, id, rank FROM o WHERE rn = 1) SELECT * FROM r WHERE unified_rank <= {CHART}""",
    "community_boards": f"""WITH {POSTS_SQL}, d AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {d})" for n, d in PERIODS.items())}) t(period, days)),
      b AS (SELECT period, source_key, source_name, count(*) AS post_count, sum(view_count)::BIGINT AS total_views, sum(comment_count)::BIGINT AS total_comments, sum(like_count)::BIGINT AS total_likes,
        round({_WHOLE("view")})::BIGINT AS avg_views, round({_WHOLE("comment")})::BIGINT AS avg_comments, round({_WHOLE("like")})::BIGINT AS avg_likes,
        round({_WHOLE("view")} * 0.4 + {_WHOLE("comment")} * 100 * 0.35 + {_WHOLE("like")} * 50 * 0.25)::BIGINT AS score
        FROM posts JOIN d ON scraped_at >= TIMESTAMP '{AS_OF}' - to_days(days::INT) WHERE category = 'community' GROUP BY 1, 2, 3)
      SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, source_key, source_name) AS rank FROM b""",
    "vote_answers": """WITH v AS (SELECT event_id AS id, user_id AS post_id, ts AS happened, row_number() OVER (PARTITION BY user_id, props ORDER BY ts NULLS FIRST, event_id) = 1 AS is_new FROM events WHERE user_id IS NOT NULL AND props IS NOT NULL)
      SELECT id, is_new, (count(*) FILTER (WHERE is_new) OVER (PARTITION BY post_id ORDER BY happened NULLS FIRST, id ROWS UNBOUNDED PRECEDING))::BIGINT AS vote_count FROM v""",
    "cluster_metrics": f"""WITH {POSTS_SQL}, c AS (SELECT {NORMAL_SQL} AS k, count(*) AS size, count(DISTINCT source_key) AS sources FROM posts WHERE {NORMAL_SQL} <> '' GROUP BY 1),
      a AS (SELECT list_sort(list(size)) AS sizes, list_sort(list(sources)) AS srcs, count(*) AS n, count(*) FILTER (WHERE size > {LARGE}) AS large, count(*) FILTER (WHERE size = 1) AS single, avg(sources) AS mean FROM c),
      m AS (SELECT unnest([{", ".join(f"{{'metric_name': 'cluster.{n}', 'value': {v}::DOUBLE}}" for n, v in (
        ("cardinality_total", "n"), (f"size_over{LARGE}_count", "large"), ("singleton_ratio", "single / n"), ("source_diversity_avg", "mean"), ("size_max", "sizes[n]"),
        *[(f"{kind}_p{round(p * 100)}", f"{of}[least(n - 1, floor(n * {p}))::BIGINT + 1]") for kind, of, shares in (("size", "sizes", (0.5, 0.95, 0.99)), ("sources", "srcs", (0.5, 0.95))) for p in shares],
      ))}]) AS m FROM a WHERE n > 0) SELECT m.metric_name, round(m.value, 6) AS value FROM m""",
}
