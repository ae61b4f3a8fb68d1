"""What tables hold after writes: sanitized, merged, replaced, counted and expired rows, and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AS_OF, POSTS_SQL, SNAPSHOTS_SQL, as_of, posts, read, snapshots
from ..operators import sinks

#: The stored posts end and the next batch begins here, so that some urls are in both.
STORED_UNTIL, BATCH_FROM = "2024-01-30 12:00:00", "2024-01-30 06:00:00"
PAGES = ("/", "/issues", "/news", "/community", "/video", "/about")


def stored_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = posts(spark, sf_dir).withColumn("content_snippet", F.when(F.col("id") % 3 == 0, F.col("title")))
    batch = p.where(F.col("scraped_at") >= as_of(BATCH_FROM)).withColumns({
        "view_count": F.col("view_count") - 100, "comment_count": F.col("comment_count") + 5, "category": F.upper("category"),
        "metadata": F.when(F.col("id") % 2 == 0, F.col("metadata")), "content_snippet": F.lit("new"),
    })
    return p.where(F.col("scraped_at") < as_of(STORED_UNTIL)), batch


_BATCHES = f"""{POSTS_SQL}, p AS (SELECT *, CASE WHEN id % 3 = 0 THEN title END AS content_snippet FROM posts),
  o AS (SELECT * FROM p WHERE scraped_at < TIMESTAMP '{STORED_UNTIL}'),
  n AS (SELECT * REPLACE (view_count - 100 AS view_count, comment_count + 5 AS comment_count, upper(category) AS category,
    CASE WHEN id % 2 = 0 THEN metadata END AS metadata, 'new' AS content_snippet) FROM p WHERE scraped_at >= TIMESTAMP '{BATCH_FROM}')"""


def sanitized_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir).withColumns({"title": F.concat(F.lit(" <b>"), "title", F.lit("</b> ")), "thumbnail": F.concat(F.lit(" //img.test/"), "id"), "view_count": F.expr("nullif(view_count, 0)")})
    return sinks.sanitize(p).select("id", "title", "url", "thumbnail", "view_count")


def upserted_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sinks.upsert_posts(*stored_and_batch(spark, sf_dir), as_of())
    return out.select("id", "url", "view_count", "comment_count", "like_count", "category", "metadata", "content_snippet", F.date_format("scraped_at", "yyyy-MM-dd HH:mm").alias("scraped"))


def replaced_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = stored_and_batch(spark, sf_dir)
    return sinks.replace_sources(old, new, ("VIDEO",)).select("id", "source_key", "category", "view_count")


def appended_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = stored_and_batch(spark, sf_dir)
    return sinks.new_snapshots(old, new, as_of()).drop("captured_at")


def inserted_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of ids beyond those that are stored."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("post_id"))
    return sinks.insert_absent(posts(spark, sf_dir).where(F.col("scraped_at") < as_of(STORED_UNTIL)).select(F.col("id").alias("post_id")), e, ["post_id"])


def retained_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.kept_posts(posts(spark, sf_dir), as_of(), days=3, ranked=("video",)).groupBy("category").agg(F.count("*").alias("n"), F.min("id").alias("least_id"))


def retained_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.kept_since(snapshots(spark, sf_dir), "captured_at", as_of(), 30).select("id", "post_id", "view_count")


def vote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.count_votes(read(spark, sf_dir, "events").selectExpr("user_id AS post_id", "props AS voter"))


def comment_vote_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = read(spark, sf_dir, "events").selectExpr("user_id AS comment_id", "props AS voter", "CASE event_type WHEN 'error' THEN -1 WHEN 'signup' THEN 0 ELSE 1 END AS vote", "ts AS at", "event_id AS id")
    return sinks.comment_votes(votes)


def feed_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.feed_document(posts(spark, sf_dir), "Trends & issues", "https://ex.test/")


def sitemap_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sitemap_document(posts(spark, sf_dir), "https://ex.test", PAGES, as_of())


QUERIES = {f.__name__: f for f in (sanitized_posts, upserted_posts, replaced_sources, appended_snapshots, inserted_absent, retained_posts, retained_snapshots, vote_counts, comment_vote_scores, feed_xml, sitemap_xml)}


def _upsert(c: str, both: str) -> str:
    return f"CASE WHEN o.url IS NOT NULL AND n.url IS NOT NULL THEN {both} WHEN n.url IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}"


def _escaped(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


_COUNTED = ", ".join(_upsert(c, f"greatest(o.{c}, n.{c})") for c in sinks.COUNTERS)
ORACLE_SQL = {
    "sanitized_posts": rf"""WITH {POSTS_SQL} SELECT id, substring(trim(regexp_replace(regexp_replace(' <b>' || title || '</b> ', '<[^>]*>', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')), 1, 300) AS title, url,
      'https://img.test/' || id AS thumbnail, view_count FROM posts""",
    "upserted_posts": f"""WITH {_BATCHES} SELECT coalesce(o.id, n.id) AS id, coalesce(o.url, n.url) AS url, {_COUNTED}, {_upsert("category", "n.category")}, {_upsert("metadata", "coalesce(n.metadata, o.metadata)")},
      {_upsert("content_snippet", "coalesce(o.content_snippet, n.content_snippet)")},
      strftime(CASE WHEN o.url IS NOT NULL AND n.url IS NOT NULL THEN TIMESTAMP '{AS_OF}' WHEN n.url IS NOT NULL THEN n.scraped_at ELSE o.scraped_at END, '%Y-%m-%d %H:%M') AS scraped FROM o FULL JOIN n ON o.url = n.url""",
    "replaced_sources": f"""WITH {_BATCHES} SELECT id, source_key, category, view_count FROM o WHERE source_key NOT IN (SELECT source_key FROM n WHERE category = 'VIDEO')
      UNION ALL SELECT id, source_key, category, view_count FROM n WHERE category = 'VIDEO'""",
    "appended_snapshots": f"""WITH {_BATCHES} SELECT o.id AS post_id, n.view_count, n.comment_count, n.like_count FROM n JOIN o USING (url) WHERE n.view_count > 0 OR n.comment_count > 0 OR n.like_count > 0""",
    "inserted_absent": f"WITH {POSTS_SQL} SELECT vec_id AS post_id FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM posts WHERE id = vec_id AND scraped_at < TIMESTAMP '{STORED_UNTIL}')",
    "retained_posts": f"""WITH {POSTS_SQL} SELECT category, count(*) AS n, min(id) AS least_id FROM posts
      WHERE scraped_at >= TIMESTAMP '{AS_OF}' - CASE WHEN category = 'video' THEN INTERVAL 7 DAY ELSE INTERVAL 3 DAY END GROUP BY 1""",
    "retained_snapshots": f"WITH {SNAPSHOTS_SQL} SELECT id, post_id, view_count::BIGINT AS view_count FROM snapshots WHERE captured_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 HOUR",
    "vote_counts": "SELECT user_id AS post_id, count(DISTINCT props) AS vote_count FROM events GROUP BY 1",
    "comment_vote_scores": """WITH l AS (SELECT user_id AS comment_id, CASE event_type WHEN 'error' THEN -1 WHEN 'signup' THEN 0 ELSE 1 END AS vote FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id, props ORDER BY ts DESC, event_id DESC) = 1)
      SELECT comment_id, count(*) FILTER (WHERE vote > 0) AS upvotes, count(*) FILTER (WHERE vote < 0) AS downvotes, count(*) FILTER (WHERE vote > 0) - count(*) FILTER (WHERE vote < 0) AS vote_score FROM l GROUP BY 1""",
    "feed_xml": f"""WITH {POSTS_SQL}, t AS (SELECT * FROM posts ORDER BY scraped_at DESC, id DESC LIMIT 50)
      SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0"><channel><title>Trends &amp; issues</title><link>https://ex.test/</link>' || chr(10)
        || string_agg('<item><title>' || {_escaped("coalesce(title, '')")} || '</title><link>' || url || '</link><guid>' || url || '</guid><pubDate>'
        || strftime(coalesce(published_at, scraped_at), '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate><category>' || category || '</category></item>', chr(10) ORDER BY scraped_at DESC, id DESC) || chr(10) || '</channel></rss>' AS body FROM t""",
    "sitemap_xml": f"""WITH {POSTS_SQL}, t AS (SELECT * FROM posts WHERE scraped_at > TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY ORDER BY scraped_at DESC, id DESC LIMIT 2000)
      SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) || {" || chr(10) || ".join(f"'<url><loc>https://ex.test{p}</loc></url>'" for p in PAGES)} || chr(10)
        || string_agg('<url><loc>https://ex.test/issue/' || id || '</loc><lastmod>' || strftime(scraped_at, '%Y-%m-%d') || '</lastmod></url>', chr(10) ORDER BY scraped_at DESC, id DESC) || chr(10) || '</urlset>' AS body FROM t""",
}
