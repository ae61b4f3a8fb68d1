"""Forms of texts, addresses, counts and answers over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.maths import containment, cosine
from ..model import POSTS_SQL, posts, read
from ..operators.scoring import top_per
from ..operators.work import spread, work_table
from ..sources import feeds
from . import issues
from .feeds import CATEGORIES
from .posts import NORMAL_SQL


def keyword_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as keywords, as probes for equal titles, and as keys by which charts are merged."""
    title = F.concat(F.col("title"), F.lit(" (Feat. X) – 1!"))
    return posts(spark, sf_dir).select("id", text.normalize_keyword(title).alias("keyword"), text.probe_title(title).alias("probe"), text.rank_key(title, F.col("source_name")).alias("rank_key"))


def plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long pages are without markup, and a hash of what is left."""
    plain = text.strip_html(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.length(plain).alias("length"), F.md5(plain).alias("md5"))


def visitor_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hashed address: how many each visitor has."""
    ip = F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    return read(spark, sf_dir, "events").groupBy(text.ip_hash(ip).alias("visitor")).agg(F.count("*").alias("n"))


def count_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as short labels, and read again from how search trends write them."""
    n = F.col("view_count") * F.when(F.col("id") % 3 == 0, 1000).otherwise(1)
    trend = F.when(F.col("id") % 3 == 0, F.concat(F.col("view_count").cast("string"), F.lit("K+"))).when(F.col("id") % 3 == 1, F.concat((F.col("view_count") % 9).cast("string"), F.lit(".5M"))).otherwise(F.call_function("format_number", F.col("view_count"), F.lit("#,##0")))
    return posts(spark, sf_dir).select("id", text.short_count(n).alias("label"), text.traffic(trend).alias("traffic"))


def host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages a host's rule covers: the host itself and what is below it."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", text.host_matches(F.col("url"), "example.org").alias("org"), text.host_matches(F.col("url"), "example.com").alias("com"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score out of answers that come bare, in a list, or fenced."""
    body = F.to_json(F.struct(F.col("id"), (F.col("id") % 5).alias("score")))
    n = F.col("id") % 4
    answer = F.when(n == 0, body).when(n == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 2, F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.lit("sorry"))
    return posts(spark, sf_dir).select("id", F.get_json_object(text.json_answer(answer), "$.score").try_cast("int").alias("score"))


def title_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which share of the next title's pairs of characters a title has."""
    # titles travel, and are normalised once: within the grams each of them would normalise its title again
    p = work_table(posts(spark, sf_dir).select("id", text.normalize_title(F.col("title")).alias("norm")), "titles")
    following = p.select((F.col("id") - 1).alias("id"), F.col("norm").alias("next"))
    grams = spread(p.join(following, "id"), "id").select("id", text.bigrams(F.col("norm")).alias("grams"), text.bigrams(F.col("next")).alias("other"))
    return grams.select("id", F.round(containment(F.col("grams"), F.col("other")), 6).alias("share"))


def label_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vector label, the 95th percentile of ids as monitoring takes it: the element at floor(n p)."""
    counts = read(spark, sf_dir, "embeddings").groupBy("label", (F.col("vec_id") % 1000).alias("v")).agg(F.count("*").alias("k"))
    # different values are counted first, so a window sorts these, not rows
    upto, all_ = Window.partitionBy("label").orderBy("v"), Window.partitionBy("label")
    at = counts.select("label", "v", F.sum("k").over(upto).alias("upto"), F.sum("k").over(all_).alias("n"))
    return at.where(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(0.95)))).groupBy("label", "n").agg(F.min("v").alias("p95"))


def vector_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector and the next one; of different lengths 0."""
    v = issues.vectors(spark, sf_dir)
    following = v.select(F.col("id").alias("next"), "v").select((F.col("next") - 1).alias("id"), F.when(F.col("next") % 10 == 0, F.slice("v", 1, 8)).otherwise(F.col("v")).alias("w"))
    return v.join(following, "id").select("id", F.round(cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


def forecast_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest temperatures of cities by day."""
    kind = F.when(F.col("event_type") == "view", "TMN").when(F.col("event_type") == "click", "TMX").otherwise("POP")
    items = read(spark, sf_dir, "events").select(F.concat(F.lit("city"), F.col("user_id") % 20).alias("city"), F.date_trunc("hour", "ts").alias("hour"), kind.alias("category"), F.col("value").cast("string").alias("value"))
    return feeds.daily_extremes(items).select("city", F.date_format("day", "yyyy-MM-dd").alias("day"), "min", "max")


def search_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of search trends by source; the answers are made of the sources' most viewed posts."""
    best = top_per(posts(spark, sf_dir).where("source_key IS NOT NULL").select("source_key", "id", "view_count"), "source_key", 20, F.desc("view_count"), F.col("id"))
    item = F.concat(F.lit("<item><title> topic "), F.col("id").cast("string"), F.lit(" </title><ht:approx_traffic>"), (F.col("view_count") % 300).cast("string"), F.lit("K+</ht:approx_traffic></item>"))
    listed = best.groupBy("source_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", item.alias("x")))), lambda r: r["x"]).alias("items"))
    body = F.concat(F.lit('<rss xmlns:ht="https://trends.google.com/trending/rss"><channel>'), F.array_join("items", ""), F.lit("</channel></rss>"))
    return feeds.trend_items(listed.select("source_key", body.alias("body"))).select("source_key", "keyword", F.round("signal_strength", 6).alias("signal_strength"), "rank_position")


def api_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of answers in JSON and XML, some of a single item in place of a list; the answers are made of orders by customer."""
    o = top_per(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", 5, F.col("o_orderkey"))
    of = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("rn", x.alias("x")))), lambda r: r["x"])
    g = o.groupBy("o_custkey").agg(of(F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))).alias("json"), of(F.concat(F.lit("<item><key>"), F.col("o_orderkey").cast("string"), F.lit("</key><status>"), F.col("o_orderstatus"), F.lit("</status></item>"))).alias("xml"))
    listed = F.when(F.size("json") == 1, F.get("json", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("json", ","), F.lit("]")))
    body = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit('{"response":{"body":{"items":{"item":'), listed, F.lit("}}}}"))).otherwise(F.concat(F.lit("<response><body><items>"), F.array_join("xml", ""), F.lit("</items></body></response>")))
    return feeds.items_of(g.select(F.col("o_custkey").alias("source_key"), body.alias("body")), "key long, status string").withColumnRenamed("source_key", "customer")


QUERIES = {f.__name__: f for f in (keyword_forms, plain_pages, visitor_hashes, count_labels, host_rules, model_answers, title_shares, label_percentiles, vector_cosines, forecast_extremes, search_trends, api_items)}
_STRIPPED = "regexp_replace(html, '<[^>]*>', '', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _STRIPPED = f"replace({_STRIPPED}, '{_a}', '{_b}')"
_GRAMS = f"list_distinct(list_transform(range(1, greatest(1, length({NORMAL_SQL}))), lambda i: substring({NORMAL_SQL}, i, 2)))"
_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '')"
ORACLE_SQL = {
    "keyword_forms": f"""WITH {POSTS_SQL}, t AS (SELECT id, source_name, title || ' (Feat. X) – 1!' AS t FROM posts)
      SELECT id, trim(regexp_replace(lower(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')), '\\s+', ' ', 'g')) AS keyword, regexp_replace(regexp_replace(lower(t), '\\[[^\\]]*\\]', '', 'g'), '[\\s\\p{{P}}\\p{{S}}]+', '', 'g') AS probe,
        regexp_replace(regexp_replace(lower(t), '\\([^)]*\\)', '', 'g'), '[^\\p{{L}}\\p{{N}}]', '', 'g') || '||' || regexp_replace(lower(source_name), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS rank_key FROM t""",
    "plain_pages": f"WITH p AS (SELECT page_id, trim(regexp_replace({_STRIPPED}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS t FROM pages) SELECT page_id, length(t) AS length, md5(t) AS md5 FROM p",
    "visitor_hashes": "SELECT substring(sha256('10.0.' || (user_id // 256) || '.' || (user_id % 256)), 1, 16) AS visitor, count(*) AS n FROM events GROUP BY 1",
    "count_labels": f"""WITH {POSTS_SQL}, n AS (SELECT id, view_count AS v, view_count * CASE WHEN id % 3 = 0 THEN 1000 ELSE 1 END AS n FROM posts)
      SELECT id, CASE WHEN n >= 1000000 THEN format('{{:.1f}}', n / 1000000) || 'M' WHEN n >= 1000 THEN format('{{:.1f}}', n / 1000) || 'K' ELSE n::VARCHAR END AS label,
        CASE id % 3 WHEN 0 THEN v * 1000.0 WHEN 1 THEN (v % 9 + 0.5) * 1000000 ELSE v END::DOUBLE AS traffic FROM n""",
    "host_rules": f"WITH h AS (SELECT page_id, {_HOST} AS h FROM pages) SELECT page_id, h = 'example.org' OR h LIKE '%.example.org' AS org, h = 'example.com' OR h LIKE '%.example.com' AS com FROM h",
    "model_answers": f"WITH {POSTS_SQL} SELECT id, CASE WHEN id % 4 < 3 THEN CAST(id % 5 AS INT) END AS score FROM posts",
    "title_shares": f"""WITH {POSTS_SQL}, g AS MATERIALIZED (SELECT id, {_GRAMS} AS g FROM posts)
      SELECT a.id, round(CASE WHEN len(b.g) > 0 THEN len(list_intersect(a.g, b.g)) / len(b.g) ELSE 0 END, 6) AS share FROM g a JOIN g b ON b.id = a.id + 1""",
    "label_percentiles": "SELECT label, count(*) AS n, list_sort(list(vec_id % 1000))[least(count(*) - 1, floor(count(*) * 0.95))::INT + 1] AS p95 FROM embeddings GROUP BY 1",
    "vector_cosines": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)
      SELECT a.id, round(CASE WHEN b.id % 10 = 0 THEN 0 ELSE list_cosine_similarity(a.v, b.v) END, 6) AS cosine FROM v a JOIN v b ON b.id = a.id + 1""",
    "forecast_extremes": f"""SELECT 'city' || (user_id % 20) AS city, strftime(ts, '%Y-%m-%d') AS day, min(value) FILTER (WHERE event_type = '{dict((v, k) for k, v in CATEGORIES.items())["TMP"]}') AS min, max(value) FILTER (WHERE event_type = '{dict((v, k) for k, v in CATEGORIES.items())["SKY"]}') AS max FROM events GROUP BY 1, 2""",
    "search_trends": f"""WITH {POSTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY view_count DESC, id) AS rn FROM posts WHERE source_key IS NOT NULL)
      SELECT source_key, 'topic ' || id AS keyword, round(least((view_count % 300) * 1000 / 100000, 1.0), 6) AS signal_strength, rn AS rank_position FROM r WHERE rn <= 20""",
    "api_items": """SELECT o_custkey AS customer, o_orderkey AS key, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5""",
}
