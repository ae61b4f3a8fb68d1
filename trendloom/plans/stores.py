"""Kept tables and settings over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings
from ..functions.text import topic_tokens
from ..model import AS_OF, POSTS_SQL, as_of, posts, read
from ..operators import stores
from ..operators.scoring import top_per
from ..streaming.state import job_folder
from .issues import topic_tokens_sql


def stored_sources(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """A folder by source after two batches: sources of the second hold only its posts, all others the first's."""
    path = job_folder(spark, "stored-sources", path)
    p = posts(spark, sf_dir).select("id", "source_key", "view_count")
    stores.replace_partitions(p, path, "source_key")
    again = p.where("id % 3 = 0 AND source_key IN ('yna', 'clien', 'youtube')").withColumn("view_count", F.col("view_count") + 1)
    stores.replace_partitions(again, path, "source_key")
    return spark.read.schema("id long, view_count long, source_key string").parquet(path).select("id", "source_key", "view_count")


def stored_history(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ranks of sources by views, taken on ten days, of which seven are kept; the last one is taken twice."""
    path = job_folder(spark, "stored-history", path)
    p = posts(spark, sf_dir).where("source_key IS NOT NULL").select("source_key", "view_count", "scraped_at")
    for back in (*range(9, -1, -1), 0):
        at = as_of() - F.expr(f"INTERVAL {back} DAY")
        sums = p.where(F.col("scraped_at") <= at).groupBy("source_key").agg(F.sum("view_count").cast("long").alias("views"))
        # one row a source
        rank = top_per(sums.withColumn("all", F.lit(0)), "all", 30, F.desc("views"), F.col("source_key")).select("source_key", F.col("rn").cast("long").alias("rank_position"), "views", at.alias("at"))
        stores.append_days(rank, path, "at", keep=7)
    kept = stores.read_days(spark, path, "source_key string, rank_position long, views long, at timestamp_ntz")
    return kept.select("day", "source_key", "rank_position", "views")


def stored_pages(spark: SparkSession, sf_dir: str, path: str | None = None, size: int = 20) -> DataFrame:
    """JSON pages of the best posts of the last 6, 12 and 24 hours, a partition each window, each replaced alone."""
    path = job_folder(spark, "stored-pages", path)
    p = posts(spark, sf_dir).select("id", "view_count", "scraped_at")
    for hours in (6, 12, 24, 12):
        best = top_per(p.where(F.col("scraped_at") > as_of() - F.expr(f"INTERVAL {hours} HOUR")).withColumn("all", F.lit(0)), "all", 100, F.desc("view_count"), F.col("id"))
        pages = best.groupBy((F.floor((F.col("rn") - 1) / size) + 1).cast("long").alias("page")).agg(F.count("*").alias("items"), F.to_json(F.array_sort(F.collect_list(F.struct(F.col("rn").alias("rank"), "id")))).alias("body"))
        stores.replace_partitions(pages.withColumn("hours", F.lit(hours)), path, "hours")
    return spark.read.schema("page long, items long, body string, hours int").parquet(path).select("hours", "page", "items", "body")


def token_statistics(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, df24, df) of titles' words, and the one row of their totals, of posts (title, scraped_at)."""
    words = p.select((F.col("scraped_at") >= as_of("2024-01-30 00:00:00")).alias("recent"), topic_tokens(F.col("title")).alias("ws")).where("size(ws) > 0")
    stats = words.select("recent", F.explode("ws").alias("token")).groupBy("token").agg(F.count_if("recent").alias("df24"), F.count("*").alias("df"))
    return stats, words.agg(F.count_if("recent").alias("n24"), F.count("*").alias("n"))


def token_stats(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Word statistics with their totals, loaded beside the old ones and swapped in; a load of half the posts comes first."""
    path = job_folder(spark, "token-stats", path)
    p = posts(spark, sf_dir).select("id", "title", "scraped_at")
    for some in (p.where("id % 2 = 0"), p):
        stats, meta = token_statistics(some)
        stores.swap_in(spark, path, {"stats": stats, "meta": meta})
    return stores.current(spark, path, "stats").crossJoin(F.broadcast(stores.current(spark, path, "meta")))


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of settings as events bring them: numbers within and beyond the bounds, words, unknown fields, records and lists, resets."""
    keys = [(g, k) for g, k, kind, *_ in settings.bound_rows() if kind == "number"]
    at = (F.col("event_id") % len(keys) + 1).cast("int")
    of = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in keys]), at)
    n = F.col("event_id") % 11
    value = F.round(F.pmod(F.col("event_id") * 37, F.lit(700)) / 100, 2).cast("string")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("batch"),
        F.when(n == 8, "channel_half_lives").when(n == 9, "trend_signal").when(n == 10, F.when(F.col("event_id") % 2 == 0, "nothing").otherwise(of(0))).otherwise(of(0)).alias("group"),
        F.when(n == 8, "values").when(n == 9, "BASE_BONUS_BY_COUNT").when(n == 10, F.when(F.col("event_id") % 4 == 1, "no_field")).otherwise(of(1)).alias("key"),
        F.when(n == 7, F.lit('"many"')).when(n == 8, F.concat(F.lit('{"news":'), F.pmod(F.col("event_id") * 13, F.lit(1600)).cast("string"), F.lit(',"sns":true}'))).when(n == 9, F.concat(F.lit("[1.5,"), value, F.lit("]")))
        .when((n == 10) & (F.col("event_id") % 4 == 3), None).otherwise(value).alias("value"),
    )


def checked_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.check_changes(_proposals(spark, sf_dir))


def current_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All settings after the changes that could be made and the resets."""
    none = spark.createDataFrame([], "group string, key string, value string")
    out = settings.settings(spark, settings.apply_changes(none, _proposals(spark, sf_dir)))
    return out.where("kind = 'number'").select("group", "key", F.col("value").cast("double").alias("value"), "changed")


QUERIES = {f.__name__: f for f in (stored_sources, stored_history, stored_pages, token_stats, checked_settings, current_settings)}


def _bounds_sql() -> str:
    rows = ", ".join(f"('{g}', '{k}', '{kind}', '{d}', {low}, {high})" for g, k, kind, d, low, high, _ in settings.bound_rows())
    return f"b(\"group\", key, kind, dflt, least, greatest) AS (VALUES {rows})"


def _proposals_sql() -> str:
    keys = [(g, k) for g, k, kind, *_ in settings.bound_rows() if kind == "number"]
    of = lambda i: "[" + ", ".join(f"'{k[i]}'" for k in keys) + f"][event_id % {len(keys)} + 1]"
    value = "CAST(round(((event_id * 37) % 700) / 100, 2) AS VARCHAR)"
    return f"""c AS (SELECT event_id AS batch, CASE event_id % 11 WHEN 8 THEN 'channel_half_lives' WHEN 9 THEN 'trend_signal' WHEN 10 THEN CASE WHEN event_id % 2 = 0 THEN 'nothing' ELSE {of(0)} END ELSE {of(0)} END AS "group",
      CASE event_id % 11 WHEN 8 THEN 'values' WHEN 9 THEN 'BASE_BONUS_BY_COUNT' WHEN 10 THEN CASE WHEN event_id % 4 = 1 THEN 'no_field' END ELSE {of(1)} END AS key,
      CASE WHEN event_id % 11 = 7 THEN '"many"' WHEN event_id % 11 = 8 THEN '{{"news":' || (event_id * 13) % 1600 || ',"sns":true}}' WHEN event_id % 11 = 9 THEN '[1.5,' || {value} || ']'
        WHEN event_id % 11 = 10 AND event_id % 4 = 3 THEN NULL ELSE {value} END AS value, (event_id * 13) % 1600 AS news, round(((event_id * 37) % 700) / 100, 2) AS x FROM events)"""


_OUT = lambda name, x: f"CASE WHEN {x} < b.least THEN {name} || ': below ' || CAST(b.least AS DOUBLE) WHEN {x} > b.greatest THEN {name} || ': above ' || CAST(b.greatest AS DOUBLE) END"
_CHECKED = f"""{_bounds_sql()}, {_proposals_sql()},
  f AS (SELECT c.batch, c."group", c.key, c.value, x, CASE WHEN c."group" NOT IN (SELECT "group" FROM b) THEN 'unknown group ' || c."group" WHEN b.kind IS NULL THEN 'unknown field ' || coalesce(c.key, '')
    WHEN b.kind = 'number' THEN CASE WHEN c.value = '"many"' THEN c.key || ': not a number' ELSE {_OUT("c.key", "x")} END
    WHEN b.kind = 'record' THEN concat_ws('; ', {_OUT("'values.news'", "news")}, 'values.sns: not a number') ELSE {_OUT("'BASE_BONUS_BY_COUNT[1]'", "x")} END AS fault
    FROM c LEFT JOIN b ON b."group" = c."group" AND b.key = c.key)"""
ORACLE_SQL = {
    "stored_sources": f"""WITH {POSTS_SQL}, s AS (SELECT id, source_key, view_count FROM posts), n AS (SELECT id, source_key, view_count + 1 AS view_count FROM s WHERE id % 3 = 0 AND source_key IN ('yna', 'clien', 'youtube'))
      SELECT * FROM s WHERE source_key NOT IN (SELECT source_key FROM n) OR source_key IS NULL UNION ALL SELECT * FROM n""",
    "stored_history": f"""WITH {POSTS_SQL}, d AS (SELECT TIMESTAMP '{AS_OF}' - to_days(CAST(b AS INT)) AS taken FROM range(7) t(b)),
      s AS (SELECT taken, source_key, CAST(sum(view_count) AS BIGINT) AS views FROM posts JOIN d ON scraped_at <= taken WHERE source_key IS NOT NULL GROUP BY 1, 2)
      SELECT strftime(taken, '%Y-%m-%d') AS day, source_key, row_number() OVER (PARTITION BY taken ORDER BY views DESC, source_key) AS rank_position, views FROM s QUALIFY rank_position <= 30""",
    "stored_pages": f"""WITH {POSTS_SQL}, h(hours) AS (VALUES (6), (12), (24)), r AS (SELECT hours, id, row_number() OVER (PARTITION BY hours ORDER BY view_count DESC, id) AS rn FROM posts JOIN h ON scraped_at > TIMESTAMP '{AS_OF}' - to_hours(hours))
      SELECT CAST(hours AS INT) AS hours, (rn - 1) // 20 + 1 AS page, count(*) AS items, '[' || string_agg('{{"rank":' || rn || ',"id":' || id || '}}', ',' ORDER BY rn) || ']' AS body FROM r WHERE rn <= 100 GROUP BY 1, 2""",
    "token_stats": f"""WITH {POSTS_SQL}, w AS (SELECT scraped_at >= TIMESTAMP '2024-01-30' AS recent, {topic_tokens_sql("title")} AS ws FROM posts), k AS (SELECT * FROM w WHERE len(ws) > 0),
      n AS (SELECT count(*) FILTER (WHERE recent) AS n24, count(*) AS n FROM k), t AS (SELECT recent, unnest(ws) AS token FROM k)
      SELECT token, count(*) FILTER (WHERE recent) AS df24, count(*) AS df, any_value(n24) AS n24, any_value(n) AS n FROM t, n GROUP BY 1""",
    "checked_settings": f"""WITH {_CHECKED} SELECT batch, "group", key, value, nullif(fault, '') AS fault FROM f""",
    "current_settings": f"""WITH {_CHECKED}, r AS (SELECT "group", max(batch) AS since FROM f WHERE key IS NULL AND value IS NULL AND "group" IN (SELECT "group" FROM b) GROUP BY 1),
      s AS (SELECT f."group", f.key, arg_max(x, batch) AS x FROM f LEFT JOIN r USING ("group") WHERE nullif(fault, '') IS NULL AND f.key IS NOT NULL AND (since IS NULL OR batch > since) GROUP BY 1, 2)
      SELECT b."group", b.key, CAST(coalesce(s.x, try_cast(b.dflt AS DOUBLE)) AS DOUBLE) AS value, s.x IS NOT NULL AS changed FROM b LEFT JOIN s ON s."group" = b."group" AND s.key = b.key WHERE kind = 'number'""",
}
