"""Streaming jobs over the events table, with SQL for what they hold at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from ..model import POSTS_SQL, SNAPSHOTS_SQL, posts, posts_of, snapshots
from ..operators import sinks
from ..operators.scoring import top_per
from ..streaming import jobs, state
from .issues import ORACLE_SQL as ISSUE_SQL


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.closed_windows(jobs.arrivals(spark, sf_dir), "1 hour")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.closed_windows(jobs.arrivals(spark, sf_dir), "12 hours", "6 hours")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sessions(jobs.arrivals(spark, sf_dir))


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_to_table(jobs.first_seen(jobs.arrivals(spark, sf_dir), ["user_id", "event_type"]), "first-seen")


def last_events(events: DataFrame, name: str = "last-events", path: str | None = None) -> DataFrame:
    """Each user's number of events and last event, kept up to date by batches."""
    empty = events.sparkSession.createDataFrame([], "user_id long, n long, last struct<ts:timestamp,event_id:long,event_type:string>")

    def merge(table: DataFrame, batch: DataFrame) -> DataFrame:
        new = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
        return sinks.merge(table, new, ["user_id"], {"n": lambda x, y: x + y, "last": F.greatest})

    return jobs.run_upserts(events, name, empty, merge, path)


def stream_last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_events(jobs.arrivals(spark, sf_dir)).select("user_id", "n", F.col("last.event_id").alias("last_id"), F.col("last.event_type").alias("last_type"))


def stream_dedup_clusters(spark: SparkSession, sf_dir: str, path: str | None = None, delay: float = 24.0 * 365) -> DataFrame:
    """Clusters of duplicates, put together post by post; posts may come ``delay`` hours out of order."""
    p = posts_of(jobs.arrivals(spark, sf_dir, "documents"))
    thumbnail = F.when(F.col("id") % 10 < 2, F.concat(F.lit("https://img.test/"), F.floor(F.col("id") / 10).cast("string")))
    titled = p.select("id", F.col("scraped_at").alias("at"), "category", normalize_title(F.col("title")).alias("norm"), thumbnail.alias("thumbnail"), F.col("view_count").cast("long").alias("view_count"))
    job = state.cluster_job(spark, state.job_folder(spark, "dedup-stream", path), delay=delay)
    return state.clusters_of(job.run(titled))


def stream_velocity(spark: SparkSession, sf_dir: str, path: str | None = None, idle: str = "3650 days", delay: str = "3650 days") -> DataFrame:
    """Growth per hour of each post from its first and last snapshot, kept as they come; those that span enough time."""
    path = state.job_folder(spark, "velocity", path)
    updates = state.velocity_updates(jobs.arrivals_of(snapshots(spark, sf_dir), f"{path}/snapshots", files=1000), idle, delay)
    last = state.latest_rows(updates, path, ["post_id"]).where("hours > 0.15")
    return last.select("post_id", *[F.round(c, 6).alias(c) for c in ("views", "comments", "likes")])


def issue_ticks(spark: SparkSession, sf_dir: str, top: int = 10, days: int = 3) -> DataFrame:
    """(tick, rank, stable_id, members) by day: issues are a source's posts of a category of the last days, members their most viewed."""
    p = posts(spark, sf_dir).where("source_key IS NOT NULL AND category IS NOT NULL")
    day = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_format(F.date_add(F.to_date("scraped_at"), i), "yyyy-MM-dd")))
    dealt = p.select("id", "view_count", F.concat_ws(":", "source_key", "category").alias("stable_id"), day.alias("tick"))
    best = top_per(dealt.withColumn("k", F.concat_ws("|", "tick", "stable_id")), "k", top, F.desc("view_count"), F.col("id"))
    issues = best.groupBy("tick", "stable_id").agg(F.sum("view_count").alias("views"), F.transform(F.array_sort(F.collect_list(F.struct(-F.col("view_count"), "id"))), lambda x: x["id"]).alias("members"))
    return top_per(issues, "tick", 500, F.desc("views"), F.col("stable_id")).select("tick", F.col("rn").cast("long").alias("rank"), "stable_id", "members")


def stream_novelty(spark: SparkSession, sf_dir: str, path: str | None = None, most: int = 500) -> DataFrame:
    """How far each issue changed since its last tick, and the factor its priority gets."""
    path = state.job_folder(spark, "novelty", path)
    job = state.novelty_job(spark, path, most).run(jobs.arrivals_of(issue_ticks(spark, sf_dir).coalesce(1), f"{path}/ticks", files=1000))
    factor = F.when(F.col("change") >= 0.3, 1.2).otherwise(1.0)
    return job.output("changes").select("tick", "stable_id", F.round("change", 6).alias("change"), factor.alias("factor"))


def stream_live_windows(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Hours of each kind of event that the watermark, a day behind the latest event, has passed."""
    counts = state.live_windows(jobs.arrivals(spark, sf_dir, files=1000), "1 hour", "1 day", "event_type")
    return state.run_append(counts, state.job_folder(spark, "live-windows", path))[0]


def stream_live_sessions(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    counts = state.live_sessions(jobs.arrivals(spark, sf_dir, files=1000), "30 minutes", "1 day", "user_id")
    return state.run_append(counts, state.job_folder(spark, "live-sessions", path))[0]


def kept_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots' raw events after clean-up: kinds are kept for a time of their own, others for two weeks."""
    from ..model import as_of, read

    kept = state.expire(read(spark, sf_dir, "events"), "ts", as_of(), {"view": 1.25, "click": 7, "purchase": 30}, "event_type", 14)
    return kept.select("event_id", "event_type")


QUERIES = {f.__name__: f for f in (stream_hourly, stream_sliding, stream_sessions, stream_first_seen, stream_last_events, stream_dedup_clusters, stream_velocity, stream_novelty, stream_live_windows, stream_live_sessions, kept_snapshots)}
_PASSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
ORACLE_SQL = {
    "stream_hourly": f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
      FROM events GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_PASSED}""",
    "stream_sliding": f"""WITH e AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - to_hours(6 * k) AS s FROM events, (VALUES (0), (1)) AS v(k))
      SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY s, event_type HAVING s + INTERVAL 12 HOUR <= {_PASSED}""",
    "stream_sessions": f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_PASSED}""",
    "stream_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_last_events": "SELECT user_id, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_id, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1",
    "stream_dedup_clusters": ISSUE_SQL["dedup_clusters"],
    "stream_velocity": f"""WITH {SNAPSHOTS_SQL}, v AS (SELECT post_id, arg_max(view_count, (captured_at, id)) - arg_min(view_count, (captured_at, id)) AS vc, arg_max(comment_count, (captured_at, id)) - arg_min(comment_count, (captured_at, id)) AS cc,
        arg_max(like_count, (captured_at, id)) - arg_min(like_count, (captured_at, id)) AS lc, date_diff('microsecond', min(captured_at), max(captured_at)) / 3.6e9 AS hours FROM snapshots GROUP BY 1)
      SELECT post_id, round(vc / greatest(hours, 0.17), 6) AS views, round(cc / greatest(hours, 0.17), 6) AS comments, round(lc / greatest(hours, 0.17), 6) AS likes FROM v WHERE hours > 0.15""",
    "stream_novelty": f"""WITH {POSTS_SQL}, d AS (SELECT id, view_count, source_key || ':' || category AS stable_id, strftime(CAST(scraped_at AS DATE) + CAST(i AS INT), '%Y-%m-%d') AS tick FROM posts, range(3) t(i) WHERE source_key IS NOT NULL AND category IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY tick, stable_id ORDER BY view_count DESC, id) AS rn FROM d),
      g AS (SELECT tick, stable_id, list(id) AS now FROM r WHERE rn <= 10 GROUP BY 1, 2), l AS (SELECT *, lag(now) OVER (PARTITION BY stable_id ORDER BY tick) AS was FROM g),
      c AS (SELECT tick, stable_id, CASE WHEN was IS NULL THEN 0.0 ELSE 1 - len(list_intersect(was, now)) / len(list_distinct(list_concat(was, now))) END AS change FROM l)
      SELECT tick, stable_id, round(change, 6) AS change, CASE WHEN change >= 0.3 THEN 1.2::DOUBLE ELSE 1.0 END AS factor FROM c""",
    "stream_live_windows": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
      FROM events GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 DAY""",
    "stream_live_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 DAY""",
    "kept_snapshots": """SELECT event_id, event_type FROM events WHERE date_diff('microsecond', ts, TIMESTAMP '2024-01-31')
      <= CASE event_type WHEN 'view' THEN 1.25 WHEN 'click' THEN 7 WHEN 'purchase' THEN 30 ELSE 14 END * 86400000000""",
}
