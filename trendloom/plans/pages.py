"""Whole views and pages: issues with their posts, posts with cluster and history, windows with cursors, orders of comments, states of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_title, title_hash, xml_escape
from ..model import AS_OF, POSTS_SQL, RUNS_SQL, SNAPSHOTS_SQL, as_of, comments, posts, read, scraper_runs, snapshots
from ..operators.scoring import places, ranked, top_per
from ..operators.sinks import merge
from ..operators.work import work_table
from ..sources import feeds
from . import details, issues
from .posts import NORMAL_SQL, H
from .signals import DELETED, SOURCE_CLASSES, URL_CLASSES, _classes_sql, first_class

#: Posts of a list in an issue's view; snapshots in a post's.
LISTED, HISTORY = 20, 24
#: Hours of issue windows (the test tables spread over two weeks), and issues of a page.
WINDOWS, PAGE = (24, 72, 168), 20
#: Failures in a row that open a source's circuit, and minutes until it may be tried again.
FAILURES, COOLDOWN = 5, 60


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).where(normalize_title(F.col("title")) != "").withColumn("cluster_id", title_hash(F.col("title")))


def _list_of(category: Column) -> Column:
    return F.when(category.isin("news", "portal"), "news").when(category == "video", "video").otherwise("community")


def issue_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues as one view: rank by the number of better ones, each list of posts by views, tags of the channels that have posts."""
    cards = work_table(issues.issue_cards(spark, sf_dir).select("cluster_id", "title", "issue_score"), "views")
    # the rank of the first of equal scores counts the better ones
    better = ranked(cards.select("cluster_id", "issue_score"), F.desc("issue_score"), F.asc("cluster_id")).groupBy("issue_score").agg(F.min("rank").alias("current_rank"))
    members = _titled(spark, sf_dir).join(cards.select("cluster_id"), "cluster_id").select("cluster_id", _list_of(F.col("category")).alias("list"), "id", "view_count")
    counts = members.groupBy("cluster_id").pivot("list", ["news", "community", "video"]).count()
    best = top_per(members, ["cluster_id", "list"], LISTED, F.desc("view_count"), F.col("id"))
    listed = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("rn", "id")))), lambda x: x["id"].cast("string")), ",").alias(f"{name}_posts")
    lists = best.groupBy("cluster_id").agg(listed("news"), listed("community"), listed("video"))
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    tags = F.concat_ws(",", F.when(has("news") | has("video"), "news"), F.when(has("community"), "community"))
    out = cards.join(better, "issue_score").join(counts, "cluster_id").join(lists, "cluster_id")
    return out.select("cluster_id", "title", "issue_score", "current_rank", *[F.coalesce(c, F.lit(0)).cast("long").alias(f"{c}_count") for c in ("news", "community", "video")], "news_posts", "community_posts", "video_posts", tags.alias("tags"))


def issue_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each window by pages, with the cursor (score, id) that the next page begins after; none after a page that isn't full."""
    hours = F.explode(F.array(*[F.lit(h) for h in WINDOWS]))
    p = _titled(spark, sf_dir).select("cluster_id", "id", "view_count", "scraped_at", hours.alias("hours"))
    p = p.where(F.timestamp_diff("MICROSECOND", F.col("scraped_at"), as_of()) < F.col("hours") * 3_600_000_000)
    found = p.groupBy("hours", "cluster_id").agg(F.sum("view_count").cast("long").alias("score"), F.min("id").alias("id"), F.count("*").alias("posts"))
    at = places(found, ["hours"], F.desc("score"), F.desc("id"), name="rank").withColumn("page", (F.floor((F.col("rank") - 1) / PAGE) + 1).cast("long"))
    at = work_table(at, "windows")
    # a page holds few rows
    last = at.groupBy("hours", "page").agg(F.count("*").alias("n"), F.min(F.struct("score", "id")).alias("last"))
    cursor = F.when(F.col("n") == PAGE, F.concat(F.col("last.score").cast("string"), F.lit(":"), F.col("last.id").cast("string")))
    return at.join(last, ["hours", "page"]).select("hours", "page", "rank", "id", "score", "posts", cursor.alias("next_cursor"))


def after_cursor(found: DataFrame, score: int, id_: int, n: int = PAGE) -> DataFrame:
    """The ``n`` issues (score, id) after a cursor; of equal scores those of smaller ids come after."""
    return found.where((F.col("score") < score) | ((F.col("score") == score) & (F.col("id") < id_))).orderBy(F.desc("score"), F.desc("id")).limit(n)


def post_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as one view: cluster, last snapshots, and what is popular beside it."""
    s = top_per(snapshots(spark, sf_dir), "post_id", HISTORY, F.desc("captured_at"), F.desc("id"))
    history = s.groupBy(F.col("post_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "view_count"))), lambda x: x["view_count"].cast("string")), ",").alias("history"))
    p = posts(spark, sf_dir).select("id", "source_key", "category", "view_count")
    out = p.join(details.cluster_lookup(spark, sf_dir), "id", "left").join(history, "id", "left").join(details.post_popular(spark, sf_dir), "id", "left")
    return out.select("id", "source_key", "category", "view_count", "cluster_id", "member_count", F.coalesce("history", F.lit("")).alias("history"), F.coalesce("popular", F.lit("")).alias("popular"))


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members of each cluster of two or more, by views."""
    p = work_table(_titled(spark, sf_dir).select("cluster_id", "id", "view_count"), "members")
    many = p.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1").select("cluster_id")
    return places(p.join(many, "cluster_id"), ["cluster_id"], F.desc("view_count"), F.col("id"))


def comment_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each comment's place among those of its post and depth, in the orders best, new and old."""
    c = comments(spark, sf_dir).select("post_id", "id", F.when(F.col("parent_id") > 0, 1).otherwise(0).alias("depth"), ((F.col("post_id") * 31 + F.col("id") * 17) % 23 - 5).cast("long").alias("score"), ((F.col("post_id") + F.col("id")) % 9 == 0).alias("deleted"))
    keys = ["post_id", "depth"]
    out = places(c, keys, F.desc("score"), F.col("id"), name="best")
    out = places(out, keys, F.desc("id"), name="new")
    out = places(out, keys, F.col("id"), name="old")
    return out.select("post_id", "id", "depth", F.when(F.col("deleted"), DELETED).alias("mask"), "best", "new", "old")


def channel_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ten best posts of each cluster, the sums of their views by channel."""
    best = top_per(_titled(spark, sf_dir).select("cluster_id", "id", "category", "view_count"), "cluster_id", 10, F.desc("view_count"), F.col("id"))
    part = lambda name: F.coalesce(F.sum(F.when(_list_of(F.col("category")) == name, F.col("view_count"))), F.lit(0)).cast("long").alias(f"{name}_sum")
    return best.groupBy("cluster_id").agg(part("news"), part("community"), part("video"), F.count("*").alias("posts"))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each source as rows to append: mean and deviation of views (0 for under two posts), and how many deviations the mean is; what isn't finite is 0."""
    s = posts(spark, sf_dir).groupBy("source_key").agg(F.count("*").alias("n"), F.coalesce(F.avg("view_count"), F.lit(0.0)).alias("mean"), F.stddev_pop("view_count").alias("std"))
    s = s.withColumn("std", F.when(F.col("n") < 2, 0.0).otherwise(F.col("std")))
    s = s.withColumn("ratio", F.when(F.col("std") == 0, float("inf")).otherwise(F.col("mean") / F.nullif("std", F.lit(0.0))))
    long = s.unpivot("source_key", ["mean", "std", "ratio"], "metric_name", "value")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return long.select("source_key", "metric_name", F.round(F.when(finite, F.col("value")).otherwise(0.0), 6).alias("value"))


def cosine_or_null(a: Column, b: Column) -> Column:
    """Cosine over the length of the shorter vector; null if either is zero there."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norms = dot(x, x), dot(y, y)
    return F.when((norms[0] > 0) & (norms[1] > 0), dot(x, y) / (F.sqrt(norms[0]) * F.sqrt(norms[1])))


def short_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector beside the next one, which is cut short, and every tenth is zero."""
    v = issues.vectors(spark, sf_dir)
    cut = F.transform(F.slice("v", F.lit(1), (F.col("next") % 60 + 1).cast("int")), lambda x: F.when(F.col("next") % 10 == 0, 0.0).otherwise(x))
    following = v.select(F.col("id").alias("next"), "v").select((F.col("next") - 1).alias("id"), cut.alias("b"))
    both = v.select("id", F.col("v").alias("a")).join(following, "id")
    return both.select("id", F.round(cosine_or_null(F.col("a"), F.col("b")), 6).alias("cosine"))


def subcategory_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subcategories of news that had none: of business papers by source, else by address."""
    sections = F.array(*[F.lit(x) for x in ("sports", "econo", "TECH", "world")])
    url = F.when(F.col("id") % 8 == 0, F.concat(F.lit("https://ex.test/"), F.element_at(sections, (F.floor(F.col("id") / 8) % 4 + 1).cast("int")), F.lit("/1"))).otherwise(F.col("url"))
    p = posts(spark, sf_dir).where("category = 'news' AND subcategory IS NULL")
    papers = [k for k, v in SOURCE_CLASSES.items() if k in ("hankyung", "mk")]
    return p.select("id", F.when(F.col("source_key").isin(*papers), SOURCE_CLASSES["mk"]).otherwise(first_class(url, URL_CLASSES[:8])).alias("subcategory"))


def page_view_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most read pages of each day as keywords; the answers are made of events, some of pages that are no topics."""
    n = read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("source_key"), "user_id").agg(F.count("*").alias("n"))
    name = F.concat(F.when(F.col("user_id") % 7 == 0, feeds.NO_TOPICS[1]).when(F.col("user_id") % 7 == 1, feeds.NO_TOPICS[0]).otherwise(""), F.lit("page_"), F.col("user_id").cast("string"))
    name = F.when(F.col("user_id") % 11 == 0, feeds.ALWAYS).otherwise(name)
    best = top_per(n, "source_key", 60, F.desc("n"), F.col("user_id"))
    item = F.struct(F.col("rn").cast("long").alias("rank"), name.alias("article"), (F.col("n") * 9_000).alias("views"))
    body = best.groupBy("source_key").agg(F.to_json(F.struct(F.array(F.struct(F.array_sort(F.collect_list(item)).alias("articles"))).alias("items"))).alias("body"))
    out = feeds.page_views(body)
    return out.select("source_key", "keyword", F.round("signal_strength", 6).alias("signal_strength"), "rank_position", "views")


def city_crowds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of how crowded areas are; the answers are made of events by user, every ninth without a record."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    low, high = F.col("n") * 137, F.col("n") * 171
    record = F.concat(
        F.lit("<LIVE_PPLTN_STTS><LIVE_PPLTN_STTS><AREA_CONGEST_LVL>"), F.when(F.col("n") % 2 == 0, "여유").otherwise("붐빔"), F.lit("</AREA_CONGEST_LVL><AREA_PPLTN_MIN>"), low.cast("string"), F.lit("</AREA_PPLTN_MIN><AREA_PPLTN_MAX>"), high.cast("string"),
        F.lit("</AREA_PPLTN_MAX></LIVE_PPLTN_STTS></LIVE_PPLTN_STTS>"),
    )
    body = F.concat(F.lit("<SeoulRtd.citydata><CITYDATA><AREA_NM>a</AREA_NM>"), F.when(F.col("user_id") % 9 == 0, "").otherwise(record), F.lit("</CITYDATA></SeoulRtd.citydata>"))
    return feeds.city_records(e.select(F.concat(F.lit("area "), F.col("user_id").cast("string")).alias("area"), body.alias("body"))).select("area", "level", "least", "most", "title")


def recent_vectors(spark: SparkSession, sf_dir: str, hours: int = 168, most: int = 5000) -> DataFrame:
    """Vectors to be loaded again: the newest 5,000 of the last hours, as the feature has it; of equal times the greater id."""
    p = posts(spark, sf_dir).select("id", "scraped_at").where(F.timestamp_diff("MICROSECOND", F.col("scraped_at"), as_of()) < hours * 3_600_000_000)
    newest = p.join(issues.vectors(spark, sf_dir), "id").orderBy(F.desc("scraped_at"), F.desc("id")).limit(most)
    return newest.select("id", F.size("v").alias("length"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def circuits(runs: DataFrame, at: Column, failures: int = FAILURES, cooldown: int = COOLDOWN) -> DataFrame:
    """(source_key, failures, opened_at, wait_minutes) after runs (source_key, started_at, id, error_message): failures since the
    last success; ``failures`` in a row or more open the circuit for ``cooldown`` minutes from the last one."""
    last = runs.where("error_message IS NULL").groupBy("source_key").agg(F.max(F.struct("started_at", "id")).alias("ok"))
    since = runs.where("error_message IS NOT NULL").join(last, "source_key", "left").where(F.col("ok").isNull() | (F.struct("started_at", "id") > F.col("ok")))
    counts = since.groupBy("source_key").agg(F.count("*").alias("failures"), F.max("started_at").alias("last"))
    out = runs.select("source_key").distinct().join(counts, "source_key", "left").select("source_key", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), "last")
    opened = F.when(F.col("failures") >= failures, F.col("last"))
    wait = F.greatest(F.lit(0.0), cooldown - F.timestamp_diff("MICROSECOND", opened, at) / 6e7)
    return out.select("source_key", "failures", opened.alias("opened_at"), F.coalesce(wait, F.lit(0.0)).alias("wait_minutes"))


def _failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs; those of some sources failed for the last days."""
    bad = F.col("source_key").isin("clien", "mk", "sbs") & (F.col("started_at") > as_of("2024-01-29 00:00:00"))
    return scraper_runs(spark, sf_dir).withColumn("error_message", F.when(bad, F.lit("E9")).otherwise(F.col("error_message")))


def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with override, circuit and their last five runs of a day, as an administrator sees them."""
    runs = work_table(_failing(spark, sf_dir), "runs")
    changes = runs.where("posts_saved % 7 = 0").groupBy("source_key").agg(F.max_by(F.col("id") % 2 == 0, F.struct("started_at", "id")).alias("enabled"))
    first = runs.where("posts_saved % 5 = 0").select("source_key").distinct().withColumn("enabled", F.lit(True))
    overrides = merge(first, changes, ["source_key"])
    recent = top_per(runs.where(F.timestamp_diff("MICROSECOND", F.col("started_at"), as_of()) < 86_400_000_000), "source_key", 5, F.desc("started_at"), F.desc("id"))
    lists = recent.groupBy("source_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "posts_saved"))), lambda x: x["posts_saved"].cast("string")), ",").alias("recent"))
    c = circuits(runs, as_of())
    out = c.join(overrides, "source_key", "left").join(lists, "source_key", "left")
    return out.select("source_key", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.col("enabled").isNotNull().alias("overridden"), "failures", F.col("opened_at").isNotNull().alias("open"), F.round("wait_minutes", 4).alias("wait_minutes"), F.coalesce("recent", F.lit("")).alias("recent"))


def page_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of posts' pages for readers without scripts: title, description and picture, escaped; of each category the 30 best of two days are listed."""
    p = posts(spark, sf_dir)
    title = xml_escape(F.substring(F.when(F.length(F.trim("title")) > 0, F.trim("title")).otherwise(feeds.NO_TITLE), 1, 70))
    head = F.concat(F.lit("<title>"), title, F.lit('</title><meta property="og:title" content="'), title, F.lit('"/><meta name="description" content="'), xml_escape(F.concat_ws(" · ", "source_name", "category")), F.lit('"/>'))
    recent = p.where(F.timestamp_diff("MICROSECOND", F.col("scraped_at"), as_of()) < 2 * 86_400_000_000)
    listed = top_per(recent.select("id", "category", "view_count"), "category", 30, F.desc("view_count"), F.desc("id")).select("id", F.lit(True).alias("listed"))
    return p.select("id", head.alias("head")).join(listed, "id", "left").select("id", F.md5("head").alias("head"), F.coalesce("listed", F.lit(False)).alias("listed"))


def issue_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each category's shown issues were last calculated, and how many pages of 20 its posts fill."""
    p = posts(spark, sf_dir)
    return p.groupBy("category").agg(F.date_format(F.max("scraped_at"), "yyyy-MM-dd HH:mm:ss").alias("calculated_at"), F.count("*").alias("posts"), F.ceil(F.count("*") / 20).cast("long").alias("pages"))


def ranking_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked posts of each source as a table: one row a title, that of the best rank, in order of rank and title."""
    rank = F.get_json_object("metadata", "$.rank").try_cast("int")
    p = posts(spark, sf_dir).where(rank.isNotNull()).select("source_key", normalize_title(F.col("title")).alias("name"), rank.alias("rank"), "id").where("name <> ''")
    one = p.groupBy("source_key", "name").agg(F.min(F.struct("rank", "id")).alias("r")).select("source_key", "name", "r.rank", "r.id")
    return places(one, ["source_key"], F.col("rank"), F.col("name")).select("source_key", "place", "rank", "id")


QUERIES = {f.__name__: f for f in (
    issue_views, issue_windows, post_views, cluster_members, comment_orders, channel_sums, metric_rows, short_cosines, subcategory_backfill, page_view_trends, city_crowds, recent_vectors,
    source_status, page_heads, issue_versions, ranking_table,
)}
_T = f"t AS (SELECT *, {H} AS cluster_id, CASE WHEN category IN ('news', 'portal') THEN 'news' WHEN category = 'video' THEN 'video' ELSE 'community' END AS l FROM posts WHERE {NORMAL_SQL} <> '')"
_DEEP = "c AS (SELECT conv_id AS post_id, turn::BIGINT AS id, CASE WHEN turn > 1 THEN 1 ELSE 0 END AS depth, ((conv_id * 31 + turn * 17) % 23 - 5)::BIGINT AS score, (conv_id + turn) % 9 = 0 AS deleted FROM conversations)"
_PEOPLE = lambda n: f"CASE WHEN {n} >= 10000 THEN regexp_replace(format('{{:.1f}}', floor({n} / 1000 + 0.5) / 10), '\\.0$', '') || '만' ELSE format('{{:,}}', {n}) END"
_ESCAPED = lambda x: f"replace(replace(replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
ORACLE_SQL = {
    "issue_views": f"""WITH {POSTS_SQL}, {_T}, cards AS MATERIALIZED (SELECT cluster_id, title, issue_score FROM ({issues.ORACLE_SQL["issue_cards"]})),
      m AS (SELECT t.cluster_id, l, id, row_number() OVER (PARTITION BY t.cluster_id, l ORDER BY view_count DESC, id) AS rn FROM t JOIN cards USING (cluster_id)),
      g AS (SELECT cluster_id, {", ".join(f"count(*) FILTER (WHERE l = '{x}') AS {x}_count, coalesce(string_agg(id::VARCHAR, ',' ORDER BY rn) FILTER (WHERE l = '{x}' AND rn <= {LISTED}), '') AS {x}_posts" for x in ("news", "community", "video"))} FROM m GROUP BY 1)
      SELECT cluster_id, title, issue_score, rank() OVER (ORDER BY issue_score DESC) AS current_rank, news_count, community_count, video_count, news_posts, community_posts, video_posts,
        concat_ws(',', CASE WHEN news_count + video_count > 0 THEN 'news' END, CASE WHEN community_count > 0 THEN 'community' END) AS tags FROM cards JOIN g USING (cluster_id)""",
    "issue_windows": f"""WITH {POSTS_SQL}, {_T}, h(hours) AS (VALUES {", ".join(f"({h})" for h in WINDOWS)}),
      g AS (SELECT hours, cluster_id, sum(view_count)::BIGINT AS score, min(id) AS id, count(*) AS posts FROM t JOIN h ON date_diff('microsecond', scraped_at, TIMESTAMP '{AS_OF}') < hours * 3600000000 GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY hours ORDER BY score DESC, id DESC) AS rank FROM g), p AS (SELECT *, (rank - 1) // {PAGE} + 1 AS page FROM r)
      SELECT hours, page, rank, id, score, posts, CASE WHEN count(*) OVER w = {PAGE} THEN last_value(score) OVER w || ':' || last_value(id) OVER w END AS next_cursor FROM p WINDOW w AS (PARTITION BY hours, page ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "post_views": f"""WITH {POSTS_SQL}, {SNAPSHOTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY captured_at DESC, id DESC) AS rn FROM snapshots), h AS (SELECT post_id, string_agg(view_count::BIGINT::VARCHAR, ',' ORDER BY rn) AS history FROM r WHERE rn <= {HISTORY} GROUP BY 1)
      SELECT p.id, source_key, category, p.view_count, cluster_id, member_count, coalesce(history, '') AS history, coalesce(popular, '') AS popular FROM posts p LEFT JOIN ({details.ORACLE_SQL["cluster_lookup"]}) c ON c.id = p.id LEFT JOIN h ON post_id = p.id LEFT JOIN ({details.ORACLE_SQL["post_popular"]}) o ON o.id = p.id""",
    "cluster_members": f"WITH {POSTS_SQL}, {_T} SELECT cluster_id, id, view_count, row_number() OVER (PARTITION BY cluster_id ORDER BY view_count DESC, id) AS place FROM t QUALIFY count(*) OVER (PARTITION BY cluster_id) > 1",
    "comment_orders": f"""WITH {_DEEP} SELECT post_id, id, depth, CASE WHEN deleted THEN '{DELETED}' END AS mask, row_number() OVER (PARTITION BY post_id, depth ORDER BY score DESC, id) AS best,
      row_number() OVER (PARTITION BY post_id, depth ORDER BY id DESC) AS "new", row_number() OVER (PARTITION BY post_id, depth ORDER BY id) AS "old" FROM c""",
    "channel_sums": f"""WITH {POSTS_SQL}, {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY view_count DESC, id) AS rn FROM t)
      SELECT cluster_id, {", ".join(f"coalesce(sum(view_count) FILTER (WHERE l = '{x}'), 0)::BIGINT AS {x}_sum" for x in ("news", "community", "video"))}, count(*) AS posts FROM r WHERE rn <= 10 GROUP BY 1""",
    "metric_rows": f"""WITH {POSTS_SQL}, s AS (SELECT source_key, avg(view_count) AS m, CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(view_count) END AS sd FROM posts GROUP BY 1)
      SELECT source_key, 'mean' AS metric_name, round(m, 6) AS value FROM s UNION ALL SELECT source_key, 'std', round(sd, 6) FROM s UNION ALL SELECT source_key, 'ratio', CASE WHEN sd = 0 THEN 0 ELSE round(m / sd, 6) END FROM s""",
    "short_cosines": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT id - 1 AS id, CASE WHEN id % 10 = 0 THEN NULL ELSE v[1 : id % 60 + 1] END AS b FROM v)
      SELECT id, round(CASE WHEN b IS NOT NULL THEN list_cosine_similarity(v[1 : len(b)], b) END, 6) AS cosine FROM v JOIN b USING (id)""",
    "subcategory_backfill": f"""WITH {POSTS_SQL}, p AS (SELECT *, CASE WHEN id % 8 = 0 THEN 'https://ex.test/' || ['sports', 'econo', 'TECH', 'world'][(id // 8) % 4 + 1] || '/1' ELSE url END AS address FROM posts WHERE category = 'news' AND subcategory IS NULL)
      SELECT id, CASE WHEN source_key IN ('hankyung', 'mk') THEN '경제' ELSE {_classes_sql("address", URL_CLASSES[:8])} END AS subcategory FROM p""",
    "page_view_trends": f"""WITH n AS (SELECT strftime(ts, '%Y-%m-%d') AS d, user_id, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY n DESC, user_id) AS rn FROM n QUALIFY rn <= 60),
      k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY rn) AS nth FROM r WHERE user_id % 11 <> 0 AND user_id % 7 > 1)
      SELECT d AS source_key, 'page ' || user_id AS keyword, round(least(n * 9000 / 100000, 1.0), 6) AS signal_strength, rn AS rank_position, n * 9000 AS views FROM k WHERE nth <= 30""",
    "city_crowds": f"""WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING user_id % 9 <> 0), c AS (SELECT 'area ' || user_id AS area, CASE WHEN n % 2 = 0 THEN '여유' ELSE '붐빔' END AS level, n * 137 AS a, n * 171 AS z FROM e)
      SELECT area, level, a AS least, z AS most, area || ': ' || level || ' (인구 약 ' || {_PEOPLE("a")} || '~' || {_PEOPLE("z")} || '명)' AS title FROM c""",
    "recent_vectors": f"""WITH {POSTS_SQL} SELECT id, len(embedding)::INT AS length, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM posts JOIN embeddings ON vec_id = id
      WHERE date_diff('microsecond', scraped_at, TIMESTAMP '{AS_OF}') < 168 * 3600000000 ORDER BY scraped_at DESC, id DESC LIMIT 5000""",
    "source_status": f"""WITH {RUNS_SQL}, f AS (SELECT * REPLACE (CASE WHEN source_key IN ('clien', 'mk', 'sbs') AND started_at > TIMESTAMP '2024-01-29' THEN 'E9' ELSE error_message END AS error_message) FROM runs),
      o AS (SELECT source_key, arg_max(id % 2 = 0, (started_at, id)) AS enabled FROM f WHERE posts_saved % 7 = 0 GROUP BY 1), o2 AS (SELECT DISTINCT source_key FROM f WHERE posts_saved % 5 = 0),
      ok AS (SELECT source_key, max((started_at, id)) AS ok FROM f WHERE error_message IS NULL GROUP BY 1),
      c AS (SELECT f.source_key, count(*) AS n, max(started_at) AS last FROM f LEFT JOIN ok USING (source_key) WHERE error_message IS NOT NULL AND (ok IS NULL OR (started_at, id) > ok) GROUP BY 1),
      r AS (SELECT source_key, posts_saved, row_number() OVER (PARTITION BY source_key ORDER BY started_at DESC, id DESC) AS rn FROM f WHERE date_diff('microsecond', started_at, TIMESTAMP '{AS_OF}') < 86400000000),
      l AS (SELECT source_key, string_agg(posts_saved::VARCHAR, ',' ORDER BY rn) AS recent FROM r WHERE rn <= 5 GROUP BY 1)
      SELECT s.source_key, coalesce(o.enabled, true) AS enabled, o.source_key IS NOT NULL OR o2.source_key IS NOT NULL AS overridden, coalesce(n, 0) AS failures, coalesce(n, 0) >= {FAILURES} AS open,
        round(CASE WHEN n >= {FAILURES} THEN greatest(0.0, {COOLDOWN} - date_diff('microsecond', last, TIMESTAMP '{AS_OF}') / 6e7) ELSE 0.0 END, 4) AS wait_minutes, coalesce(recent, '') AS recent
      FROM (SELECT DISTINCT source_key FROM f) s LEFT JOIN o USING (source_key) LEFT JOIN o2 ON o2.source_key = s.source_key LEFT JOIN c ON c.source_key = s.source_key LEFT JOIN l ON l.source_key = s.source_key""",
    "page_heads": f"""WITH {POSTS_SQL}, p AS (SELECT *, {_ESCAPED(f"substring(CASE WHEN length(trim(title)) > 0 THEN trim(title) ELSE '{feeds.NO_TITLE}' END, 1, 70)")} AS e FROM posts),
      l AS (SELECT id FROM posts WHERE date_diff('microsecond', scraped_at, TIMESTAMP '{AS_OF}') < 2 * 86400000000 QUALIFY row_number() OVER (PARTITION BY category ORDER BY view_count DESC, id DESC) <= 30)
      SELECT p.id, md5('<title>' || e || '</title><meta property="og:title" content="' || e || '"/><meta name="description" content="' || {_ESCAPED("concat_ws(' · ', source_name, category)")} || '"/>') AS head, l.id IS NOT NULL AS listed FROM p LEFT JOIN l USING (id)""",
    "issue_versions": f"WITH {POSTS_SQL} SELECT category, strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS calculated_at, count(*) AS posts, ceil(count(*) / 20)::BIGINT AS pages FROM posts GROUP BY 1",
    "ranking_table": f"""WITH {POSTS_SQL}, p AS (SELECT source_key, {NORMAL_SQL} AS name, try_cast(json_extract_string(metadata, '$.rank') AS INT) AS rank, id FROM posts),
      o AS (SELECT source_key, name, min((rank, id)) AS r FROM p WHERE rank IS NOT NULL AND name <> '' GROUP BY 1, 2) SELECT source_key, row_number() OVER (PARTITION BY source_key ORDER BY r[1], name) AS place, r[1] AS rank, r[2] AS id FROM o""",
}
