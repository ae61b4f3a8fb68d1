"""The data model's relations, as views over the test tables."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.work import work_root

#: All plans take the time they look back from; this one suits the test tables.
AS_OF = "2024-01-31 00:00:00"


#: The test tables' sources src0, src1 and on stand for these, so that tables of weights are reached.
SOURCES = (
    "yna", "naver_news_ranking", "sbs", "khan", "daum_news", "google_news_kr", "bigkinds_issues", "nate_news", "zum_news", "newsis",
    "ytn", "theqoo", "clien", "dcinside", "mlbpark", "inven", "youtube", "chosun", "mk", "unlisted",
)
#: Titles of the test tables get some of these, so that Hangul words are there to be compared.
PHRASES = ("정부는 예산안을 발표", "국회에서 예산안 통과", "날씨가 추운 서울", "서울에서 열린 축제", "반도체 수출이 증가", "반도체 공장에서 화재", "축구 대표팀의 승리", "부동산 시장은 안정")
_LIST = lambda items: ", ".join(f"'{x}'" for x in items)


def as_of(at: str = AS_OF):
    return F.expr(f"TIMESTAMP_NTZ '{at}'")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Of a folder of tables, the work table of its posts and their schema.
_KEPT: contextvars.ContextVar[dict] = contextvars.ContextVar("kept_posts", default={})  # noqa: B039


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts from documents: one row each."""
    if sf_dir in _KEPT.get():
        path, schema = _KEPT.get()[sf_dir]
        return spark.read.schema(schema).parquet(path)
    return posts_of(read(spark, sf_dir, "documents"))


@contextlib.contextmanager
def kept_posts(spark: SparkSession, sf_dir: str) -> Iterator[None]:
    """Within it, ``posts`` of this folder are a work table: a query of many steps reads the texts once."""
    made, path = posts(spark, sf_dir), f"{work_root(spark)}/posts-{uuid.uuid4().hex}"
    made.write.parquet(path)
    token = _KEPT.set(_KEPT.get() | {sf_dir: (path, made.schema)})
    try:
        yield
    finally:
        _KEPT.reset(token)


def posts_of(documents: DataFrame) -> DataFrame:
    """The same of documents that come as a stream; a null text is as an empty one."""
    return documents.selectExpr(
        "doc_id AS id", f"coalesce(try_element_at(array({_LIST(SOURCES)}), try_cast(substring(source, 4) AS INT) + 1), source) AS source_key", "upper(source) AS source_name",
        "CASE lang WHEN 'en' THEN 'news' WHEN 'fr' THEN 'community' WHEN 'es' THEN 'video' ELSE 'portal' END AS category",
        "CASE WHEN doc_id % 4 <> 0 THEN concat('sub', doc_id % 6) END AS subcategory",
        f"""CASE WHEN doc_id % 31 = 0 THEN '' ELSE concat(CASE WHEN doc_id % 17 = 0 THEN '[속보] ' WHEN doc_id % 23 = 0 THEN '[사진] ' ELSE '' END,
          coalesce(substring(split_part(text, chr(10), 1), 1, 120), ''), CASE WHEN doc_id % 5 = 1 THEN concat(' ', element_at(array({_LIST(PHRASES)}), cast((doc_id div 5) % 8 AS INT) + 1)) ELSE '' END) END AS title""",
        "concat('https://ex.test/', doc_id) AS url",
        "CASE WHEN doc_id % 5 = 0 THEN 0 ELSE (doc_id * 7919) % 5003 END AS view_count",
        "CASE WHEN doc_id % 5 = 0 THEN 0 ELSE (doc_id * 104729) % 97 END AS comment_count",
        "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (doc_id * 1299709) % 53 END AS like_count",
        f"TIMESTAMP_NTZ '{AS_OF}' - make_dt_interval(0, 0, cast((doc_id * 7) % 20160 AS INT), 0) AS scraped_at",
        f"CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP_NTZ '{AS_OF}' - make_dt_interval(0, 0, cast((doc_id * 7) % 20160 + doc_id % 90 AS INT), 0) END AS published_at",
        "CASE WHEN doc_id % 10 = 0 THEN '{\"rank\": \"none\"}' WHEN doc_id % 3 = 0 THEN concat('{\"rank\": ', doc_id % 50 + 1, '}') END AS metadata",
    )


#: The same relation for DuckDB, as the head of a WITH clause.
POSTS_SQL = f"""posts AS (SELECT doc_id AS id, coalesce([{_LIST(SOURCES)}][try_cast(substring(source, 4) AS INT) + 1], source) AS source_key, upper(source) AS source_name,
  CASE lang WHEN 'en' THEN 'news' WHEN 'fr' THEN 'community' WHEN 'es' THEN 'video' ELSE 'portal' END AS category,
  CASE WHEN doc_id % 4 <> 0 THEN 'sub' || (doc_id % 6) END AS subcategory,
  CASE WHEN doc_id % 31 = 0 THEN '' ELSE concat(CASE WHEN doc_id % 17 = 0 THEN '[속보] ' WHEN doc_id % 23 = 0 THEN '[사진] ' ELSE '' END, substring(split_part(text, chr(10), 1), 1, 120),
    CASE WHEN doc_id % 5 = 1 THEN ' ' || [{_LIST(PHRASES)}][(doc_id // 5) % 8 + 1] ELSE '' END) END AS title, 'https://ex.test/' || doc_id AS url,
  CASE WHEN doc_id % 5 = 0 THEN 0 ELSE (doc_id * 7919) % 5003 END AS view_count,
  CASE WHEN doc_id % 5 = 0 THEN 0 ELSE (doc_id * 104729) % 97 END AS comment_count,
  CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (doc_id * 1299709) % 53 END AS like_count,
  TIMESTAMP '{AS_OF}' - to_minutes((doc_id * 7) % 20160) AS scraped_at,
  CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '{AS_OF}' - to_minutes((doc_id * 7) % 20160 + doc_id % 90) END AS published_at,
  CASE WHEN doc_id % 10 = 0 THEN '{{"rank": "none"}}' WHEN doc_id % 3 = 0 THEN '{{"rank": ' || (doc_id % 50 + 1) || '}}' END AS metadata
  FROM documents)"""


def case_of(key: str, table: dict, default) -> str:
    """``table[key]`` or the default as a SQL expression."""
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement snapshots from events: running counts of each post's views, comments and likes."""
    return snapshots_of(read(spark, sf_dir, "events"))


def snapshots_of(events: DataFrame) -> DataFrame:
    """The same of given events.

    Counts run in two steps, over a post's hours and within an hour, so that no task sorts all events
    of a post. Events without a time come before all others; those without a post count as one post's.
    """
    from pyspark.sql import Window

    kinds = {"view_count": "view", "comment_count": "click", "like_count": "purchase"}
    flags = [(F.col("event_type") == kind).cast("int").alias(name) for name, kind in kinds.items()]
    rows = events.where(F.col("event_type").isin(*kinds.values())).select("event_id", "user_id", "ts", F.date_trunc("hour", "ts").alias("hour"), *flags)
    hours = Window.partitionBy("user").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(F.col("user_id").alias("user"), F.col("hour").alias("at")).agg(*[F.sum(name).alias(name) for name in kinds])
    before = before.select("user", "at", *[F.coalesce(F.sum(name).over(hours), F.lit(0)).alias(f"before_{name}") for name in kinds])
    running = Window.partitionBy("user_id", "hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(before, F.col("user_id").eqNullSafe(F.col("user")) & F.col("hour").eqNullSafe(F.col("at")))
    return placed.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("post_id"), F.col("ts").alias("captured_at"),
        *[(F.sum(name).over(running) + F.col(f"before_{name}")).alias(name) for name in kinds],
    )


SNAPSHOTS_SQL = """snapshots AS (SELECT event_id AS id, user_id AS post_id, ts AS captured_at,
  sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS view_count,
  sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS comment_count,
  sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS like_count
  FROM events WHERE event_type IN ('view', 'click', 'purchase')
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


def scraper_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS id", f"element_at(array({_LIST(SOURCES)}), cast(user_id % 20 AS INT) + 1) AS source_key", "ts AS started_at", "ts + INTERVAL 1 MINUTE AS finished_at",
        "cast(floor(value) AS BIGINT) AS posts_saved", "CASE WHEN event_type = 'error' THEN concat('E', event_id % 3) END AS error_message",
    )


RUNS_SQL = f"""runs AS (SELECT event_id AS id, [{_LIST(SOURCES)}][user_id % 20 + 1] AS source_key, ts AS started_at, ts + INTERVAL 1 MINUTE AS finished_at,
  cast(floor(value) AS BIGINT) AS posts_saved, CASE WHEN event_type = 'error' THEN 'E' || (event_id % 3) END AS error_message FROM events)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("metric_name"), F.col("ts").alias("computed_at"), "value")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments from conversations: each turn answers the one before."""
    return read(spark, sf_dir, "conversations").selectExpr("conv_id AS post_id", "cast(turn AS BIGINT) AS id", "cast(turn AS BIGINT) - 1 AS parent_id", "role AS author", "text AS body")
