"""Quality and health: source health, metrics, audits and comments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_title, probe_title
from ..model import AS_OF, POSTS_SQL, RUNS_SQL, SNAPSHOTS_SQL, as_of, comments, metrics, posts, read, scraper_runs, snapshots
from .posts import NORMAL_SQL, H


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by source: counts, success rate, means, the last error and the last run."""
    r = scraper_runs(spark, sf_dir)
    ok = F.col("error_message").isNull()
    return r.groupBy("source_key").agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("ok"), F.round(100 * F.count_if(ok) / F.count("*"), 4).alias("success_pct"),
        F.round(F.avg(F.when(ok, F.col("posts_saved"))), 4).alias("avg_saved"), F.max("finished_at").alias("last_run"),
        F.max_by("error_message", F.when(~ok, F.struct("started_at", "id"))).alias("last_error"),
    )


def common_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's commonest error; of equals the least. Counted first, so no list of all errors."""
    counts = scraper_runs(spark, sf_dir).where("error_message IS NOT NULL").groupBy("source_key", "error_message").agg(F.count("*").alias("n"))
    return counts.groupBy("source_key").agg(F.min_by("error_message", F.struct(-F.col("n"), "error_message")).alias("mode"), F.sum("n").cast("long").alias("errors"))


def sources_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources with their posts and runs; those without either have zeros."""
    p = posts(spark, sf_dir).groupBy("source_key").agg(F.count("*").alias("posts"), F.max("scraped_at").alias("last_post"))
    r = scraper_runs(spark, sf_dir).groupBy("source_key").agg(F.count("*").alias("runs"), F.count_if(F.col("error_message").isNull()).alias("ok"))
    out = p.join(r, "source_key", "full_outer")
    return out.select("source_key", F.coalesce("posts", F.lit(0)).cast("long").alias("posts"), F.coalesce("runs", F.lit(0)).cast("long").alias("runs"), F.round(F.coalesce(100 * F.col("ok") / F.nullif("runs", F.lit(0)), F.lit(0.0)), 4).alias("success_pct"), "last_post")


def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with runs but without posts in the last day."""
    recent = posts(spark, sf_dir).where(F.col("scraped_at") > as_of("2024-01-30 23:00:00")).select("source_key")
    return scraper_runs(spark, sf_dir).select("source_key").distinct().join(recent, "source_key", "left_anti")


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir)
    stats = m.groupBy("metric_name").agg(F.count("*").alias("n"), *[F.round(f("value"), 6).alias(f"{n}_value") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])
    last = m.groupBy("metric_name").agg(F.round(F.max_by("value", F.struct("computed_at", "id")), 6).alias("last_value"))
    return stats.join(last, "metric_name")


def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means and running day counts of each metric."""
    m = metrics(spark, sf_dir).groupBy("metric_name", F.date_trunc("hour", "computed_at").alias("hour")).agg(F.round(F.avg("value"), 6).alias("avg_value"), F.count("*").alias("n"))
    day = Window.partitionBy("metric_name", F.to_date("hour")).orderBy("hour").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.select("metric_name", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "avg_value", "n", F.sum("n").over(day).cast("long").alias("n_today"))


def size_percentiles(sizes: DataFrame, key: str, n: str, shares: tuple = (0.5, 0.95, 0.99)) -> DataFrame:
    """Floor-index percentiles of ``n`` for each ``key``, and the most. Equal sizes are counted first, so that no
    list of all values is made: the value at place floor(count p) is the first whose running count is beyond it."""
    counts = sizes.groupBy(key, n).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(key).orderBy(n).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("total", F.sum("c").over(Window.partitionBy(key)))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(p))), F.col(n)))
    return ranked.groupBy(key).agg(*[at(p).alias(f"p{round(100 * p)}") for p in shares], F.max(n).alias("most"))


def percentiles_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of users' events, one value a user."""
    return size_percentiles(read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")), "event_type", "n")


def cluster_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of title groups: percentiles, singletons, sources per group. Equal sizes are counted first."""
    g = posts(spark, sf_dir).where(normalize_title(F.col("title")) != "").groupBy(normalize_title(F.col("title")).alias("k")).agg(F.count("*").alias("n"), F.countDistinct("source_key").alias("s"))
    sizes = g.groupBy("n").agg(F.count("*").alias("c"), F.sum("s").alias("s"))
    below = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sizes.withColumn("upto", F.sum("c").over(below)).withColumn("total", F.sum("c").over(Window.partitionBy()))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(p))), F.col("n")))
    return ranked.agg(
        at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("n").alias("most"), F.round(F.sum(F.when(F.col("n") == 1, F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("singletons"),
        F.round(F.sum("s") / F.sum("c"), 6).alias("sources"),
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness and range of each source's posts, with the worst severity of the rules it breaks."""
    p = posts(spark, sf_dir)
    share = lambda c: F.round(100 * F.count_if(c) / F.count("*"), 4)
    a = p.groupBy("source_key").agg(
        F.count("*").alias("n"), share(F.col("published_at").isNull()).alias("no_date_pct"), share(F.col("view_count") == 0).alias("no_views_pct"),
        F.count_if(F.col("title").rlike("^[0-9]+$")).alias("numeric_titles"), F.count_if(~F.col("url").rlike("^https?://")).alias("bad_urls"),
        F.count_if(F.col("title").rlike("&[a-z]+;")).alias("entities"), F.count_if(F.col("published_at") > F.col("scraped_at")).alias("future"),
    )
    severity = F.greatest(
        F.when(F.col("bad_urls") > 0, 3).otherwise(0), F.when(F.col("no_date_pct") > 15, 2).otherwise(0), F.when(F.col("no_views_pct") > 30, 2).otherwise(0),
        F.when(F.col("entities") > 0, 1).otherwise(0), F.when(F.col("numeric_titles") > 0, 1).otherwise(0),
    )
    return a.withColumn("severity", severity.cast("long"))


def watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rule: its value and whether it holds."""
    p = posts(spark, sf_dir)
    age = F.timestamp_diff("MICROSECOND", F.max("scraped_at"), as_of()) / 6e7
    fresh = p.agg(F.round(age, 4).alias("value")).select(F.lit("max_age_min").alias("rule"), "value", (F.col("value") <= 15).alias("ok"))
    top = p.orderBy(F.desc("view_count"), "id").limit(15).groupBy(probe_title(F.col("title")).alias("t")).agg(F.count("*").alias("n"))
    twice = top.agg(F.count_if((F.col("n") > 1) & (F.length("t") >= 8)).cast("double").alias("value")).select(F.lit("duplicate_titles").alias("rule"), "value", (F.col("value") == 0).alias("ok"))
    null_part = p.agg(F.round(F.count_if(F.col("subcategory").isNull()) / F.count("*"), 6).alias("value")).select(F.lit("null_share").alias("rule"), "value", (F.col("value") < 0.5).alias("ok"))
    failing = source_health(spark, sf_dir).agg(F.count_if(F.col("success_pct") < 75).cast("double").alias("value")).select(F.lit("failing_sources").alias("rule"), "value", (F.col("value") < 5).alias("ok"))
    return fresh.unionByName(twice).unionByName(null_part).unionByName(failing)


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of each category's newest post in seconds, and whether it breaks the objective of 900."""
    p = posts(spark, sf_dir).groupBy("category").agg(F.max("scraped_at").alias("newest"))
    age = F.timestamp_diff("SECOND", F.col("newest"), as_of())
    return p.select("category", age.alias("age_s"), (age > 900).alias("stale"))


def comment_tree(spark: SparkSession, sf_dir: str, deepest: int = 5) -> DataFrame:
    """Comments with their depth: how many answers stand above them, ``deepest`` at most.

    Levels are joined one by one, ``deepest`` joins at most, on both keys. Orphans are roots.
    """
    c = comments(spark, sf_dir)
    keys = c.select("post_id", F.col("id").alias("up"), F.col("parent_id").alias("next"))
    at = c.select("post_id", "id", "author", F.col("parent_id").alias("up"), F.lit(0).alias("depth"))
    for _ in range(deepest):
        found = at.join(keys, ["post_id", "up"], "left")
        at = found.select("post_id", "id", "author", F.col("next").alias("up"), (F.col("depth") + F.when(F.col("up").isNotNull() & F.col("next").isNotNull(), 1).otherwise(0)).alias("depth"))
    return at.select("post_id", "id", "author", F.col("depth").cast("long").alias("depth"))


def comment_tree_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comment_tree(spark, sf_dir)


def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with large orders and none urgent: a semi and an anti join."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    df = c.join(o.where("o_totalprice > 150000"), c.c_custkey == o.o_custkey, "left_semi").join(o.where("o_orderpriority = '1-URGENT'"), c.c_custkey == o.o_custkey, "left_anti")
    return df.select("c_custkey", "c_mktsegment")


def posts_with_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and their vote counts where they have any; the viewer's own votes are joined after a filter."""
    p = posts(spark, sf_dir).select("id", "category")
    votes = read(spark, sf_dir, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("votes"))
    mine = read(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("id"), F.lit(True).alias("mine")).distinct()
    return p.join(votes, "id", "left").join(mine, "id", "left").select("id", "category", F.coalesce("votes", F.lit(0)).cast("long").alias("votes"), F.coalesce("mine", F.lit(False)).alias("mine"))


def engagement_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each post's last counters by day: the latest row of a key, pre-aggregated."""
    s = snapshots(spark, sf_dir)
    last = F.max_by("view_count", F.struct("captured_at", "id"))
    return s.groupBy("post_id", F.to_date("captured_at").alias("day")).agg(last.cast("long").alias("views"), F.count("*").alias("snapshots"))


QUERIES = {f.__name__: f for f in (
    source_health, common_errors, sources_overview, missing_sources, metric_summary, metric_series, percentiles_by_type, cluster_health, audit, watchdog, freshness, semi_anti, posts_with_scores, engagement_by_day,
)} | {"comment_tree": comment_tree_fixture}
_HEALTH = f"""{RUNS_SQL}, h AS (SELECT source_key, count(*) AS runs, count(*) FILTER (WHERE error_message IS NULL) AS ok, round(100 * count(*) FILTER (WHERE error_message IS NULL) / count(*), 4) AS success_pct,
  round(avg(posts_saved) FILTER (WHERE error_message IS NULL), 4) AS avg_saved, max(finished_at) AS last_run, first(error_message ORDER BY started_at DESC, id DESC) FILTER (WHERE error_message IS NOT NULL) AS last_error FROM runs GROUP BY 1)"""
ORACLE_SQL = {
    "source_health": f"WITH {_HEALTH} SELECT * FROM h",
    "common_errors": f"""WITH {RUNS_SQL}, c AS (SELECT source_key, error_message, count(*) AS n FROM runs WHERE error_message IS NOT NULL GROUP BY 1, 2)
      SELECT source_key, first(error_message ORDER BY n DESC, error_message) AS mode, sum(n)::BIGINT AS errors FROM c GROUP BY 1""",
    "sources_overview": f"""WITH {POSTS_SQL}, {RUNS_SQL}, p AS (SELECT source_key, count(*) AS posts, max(scraped_at) AS last_post FROM posts GROUP BY 1), r AS (SELECT source_key, count(*) AS runs, count(*) FILTER (WHERE error_message IS NULL) AS ok FROM runs GROUP BY 1)
      SELECT source_key, coalesce(posts, 0) AS posts, coalesce(runs, 0) AS runs, round(coalesce(100 * ok / nullif(runs, 0), 0.0), 4) AS success_pct, last_post FROM p FULL JOIN r USING (source_key)""",
    "missing_sources": f"WITH {POSTS_SQL}, {RUNS_SQL} SELECT DISTINCT source_key FROM runs WHERE source_key NOT IN (SELECT source_key FROM posts WHERE scraped_at > TIMESTAMP '2024-01-30 23:00:00')",
    "metric_summary": """SELECT event_type AS metric_name, count(*) AS n, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(avg(value), 6) AS avg_value, round(first(value ORDER BY ts DESC, event_id DESC), 6) AS last_value FROM events GROUP BY 1""",
    "metric_series": """WITH m AS (SELECT event_type AS metric_name, date_trunc('hour', ts) AS h, round(avg(value), 6) AS avg_value, count(*) AS n FROM events GROUP BY 1, 2)
      SELECT metric_name, strftime(h, '%Y-%m-%d %H') AS hour, avg_value, n, (sum(n) OVER (PARTITION BY metric_name, h::DATE ORDER BY h))::BIGINT AS n_today FROM m""",
    "percentiles_by_type": """WITH u AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type, user_id), l AS (SELECT event_type, list_sort(list(n)) AS l, count(*) AS c, max(n) AS most FROM u GROUP BY 1)
      SELECT event_type, l[least(c - 1, floor(c * 0.5)::BIGINT) + 1] AS p50, l[least(c - 1, floor(c * 0.95)::BIGINT) + 1] AS p95, l[least(c - 1, floor(c * 0.99)::BIGINT) + 1] AS p99, most FROM l""",
    "cluster_health": f"""WITH {POSTS_SQL}, g AS (SELECT count(*) AS n, count(DISTINCT source_key) AS s FROM posts WHERE {NORMAL_SQL} <> '' GROUP BY {H}), l AS (SELECT list_sort(list(n)) AS l, count(*) AS c, max(n) AS most, avg((n = 1)::INT) AS one, avg(s) AS s FROM g)
      SELECT l[least(c - 1, floor(c * 0.5)::BIGINT) + 1] AS p50, l[least(c - 1, floor(c * 0.95)::BIGINT) + 1] AS p95, l[least(c - 1, floor(c * 0.99)::BIGINT) + 1] AS p99, most, round(one, 6) AS singletons, round(s, 6) AS sources FROM l""",
    "audit": f"""WITH {POSTS_SQL}, a AS (SELECT source_key, count(*) AS n, round(100 * count(*) FILTER (WHERE published_at IS NULL) / count(*), 4) AS no_date_pct, round(100 * count(*) FILTER (WHERE view_count = 0) / count(*), 4) AS no_views_pct,
        count(*) FILTER (WHERE regexp_matches(title, '^[0-9]+$')) AS numeric_titles, count(*) FILTER (WHERE NOT regexp_matches(url, '^https?://')) AS bad_urls, count(*) FILTER (WHERE regexp_matches(title, '&[a-z]+;')) AS entities,
        count(*) FILTER (WHERE published_at > scraped_at) AS future FROM posts GROUP BY 1)
      SELECT *, greatest(CASE WHEN bad_urls > 0 THEN 3 ELSE 0 END, CASE WHEN no_date_pct > 15 THEN 2 ELSE 0 END, CASE WHEN no_views_pct > 30 THEN 2 ELSE 0 END, CASE WHEN entities > 0 THEN 1 ELSE 0 END, CASE WHEN numeric_titles > 0 THEN 1 ELSE 0 END)::BIGINT AS severity FROM a""",
    "watchdog": f"""WITH {POSTS_SQL}, {_HEALTH}, top AS (SELECT * FROM posts ORDER BY view_count DESC, id LIMIT 15), t AS (SELECT regexp_replace(regexp_replace(lower(title), '\\[[^\\]]*\\]', '', 'g'), '[\\s\\p{{P}}\\p{{S}}]+', '', 'g') AS t, count(*) AS n FROM top GROUP BY 1),
      v AS (SELECT 'max_age_min' AS rule, round(date_diff('microsecond', max(scraped_at), TIMESTAMP '{AS_OF}') / 6e7, 4)::DOUBLE AS value, 15 AS lim FROM posts
        UNION ALL SELECT 'duplicate_titles', (count(*) FILTER (WHERE n > 1 AND length(t) >= 8))::DOUBLE, 0 FROM t
        UNION ALL SELECT 'null_share', round(count(*) FILTER (WHERE subcategory IS NULL) / count(*), 6), 0 FROM posts UNION ALL SELECT 'failing_sources', (count(*) FILTER (WHERE success_pct < 75))::DOUBLE, 0 FROM h)
      SELECT rule, value, CASE rule WHEN 'max_age_min' THEN value <= 15 WHEN 'duplicate_titles' THEN value = 0 WHEN 'null_share' THEN value < 0.5 ELSE value < 5 END AS ok FROM v""",
    "freshness": f"WITH {POSTS_SQL} SELECT category, date_diff('second', max(scraped_at), TIMESTAMP '{AS_OF}') AS age_s, date_diff('second', max(scraped_at), TIMESTAMP '{AS_OF}') > 900 AS stale FROM posts GROUP BY 1",
    "semi_anti": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "posts_with_scores": f"""WITH {POSTS_SQL}, v AS (SELECT user_id, count(*) AS votes FROM events WHERE event_type = 'click' GROUP BY 1), m AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
      SELECT id, category, coalesce(votes, 0) AS votes, m.user_id IS NOT NULL AS mine FROM posts LEFT JOIN v ON v.user_id = id LEFT JOIN m ON m.user_id = id""",
    "engagement_by_day": f"WITH {SNAPSHOTS_SQL} SELECT post_id, captured_at::DATE AS day, first(view_count ORDER BY captured_at DESC, id DESC)::BIGINT AS views, count(*) AS snapshots FROM snapshots GROUP BY 1, 2",
    "comment_tree": """WITH RECURSIVE c AS (SELECT conv_id AS post_id, turn::BIGINT AS id, turn::BIGINT - 1 AS parent_id, role AS author FROM conversations),
      t AS (SELECT post_id, id, author, 0 AS depth FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.post_id = c.post_id AND p.id = c.parent_id)
        UNION ALL SELECT c.post_id, c.id, c.author, t.depth + 1 FROM c JOIN t ON c.post_id = t.post_id AND c.parent_id = t.id)
      SELECT post_id, id, author, least(depth, 5)::BIGINT AS depth FROM t""",
}
