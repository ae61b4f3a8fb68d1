"""Views of single posts and issues, the stores behind them, and their quality figures, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.maths import change_rate
from ..functions.text import normalize_title, video_id
from ..model import AS_OF, POSTS_SQL, as_of, posts, read
from ..operators.scoring import score_posts, top_per
from ..operators.sinks import merge
from ..operators.work import work_table
from .issues import _CARDS, H, issue_cards, title_members
from .posts import FINAL_SQL, NORMAL_SQL, SCORED_SQL
from .signals import ISSUE_CLASSES, ISSUE_DEFAULT, _classes_sql, first_class

#: Mark of a summary that stands in until a real one is written.
FALLBACK = "[fallback]"
#: Cached summaries of issues whose top posts changed by this share are out of date.
CHANGED = 0.3
#: Titles that a summary is made from.
TITLES = 15


def stale(summary: Column) -> Column:
    """Whether a summary is missing or only stands in."""
    return F.coalesce((summary == "") | summary.startswith(FALLBACK), F.lit(True))


def clusters_of(p: DataFrame) -> DataFrame:
    """(cluster, cluster_id, canonical_id, member_count) of posts by ``cluster``: the canonical one has most views, then is the latest."""
    best = F.struct("view_count", "scraped_at", F.negate("id"))
    return p.groupBy("cluster").agg(F.min("id").alias("cluster_id"), F.max_by("id", best).alias("canonical_id"), F.count("*").alias("member_count"))


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).withColumn("cluster", F.nullif(normalize_title(F.col("title")), F.lit("")))


def cluster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each post's cluster, its canonical post and size; null for posts without title."""
    p = work_table(_clustered(spark, sf_dir).select("id", "cluster", "view_count", "scraped_at"), "lookup")
    return p.join(clusters_of(p.where("cluster IS NOT NULL")), "cluster", "left").select("id", "cluster_id", "canonical_id", "member_count")


def popular_elsewhere(p: DataFrame, since: Column, n: int = 5) -> DataFrame:
    """(id, popular) of posts (id, category, cluster, score, scraped_at): the ``n`` best ids of the category since then, none of the post's own cluster.

    Only clusters with a post among a category's best have another list than the category's own, and these are ``n``
    a category at most; so candidates are ranked once for each of them, and the lists are small.
    """
    recent = p.where(F.col("scraped_at") > since).select("id", "category", "cluster", "score")
    listed = lambda df, *keys: top_per(df, list(keys), n, F.desc("score"), F.col("id")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.negate("score").alias("s"), "id"))), lambda x: x.id).alias("best"))
    best = work_table(listed(recent, "category"), "popular")
    hot = recent.join(best.select("category", F.explode("best").alias("id")), ["category", "id"]).select("category", F.col("cluster").alias("own")).distinct()
    hot = work_table(hot, "popular-hot")
    others = listed(recent.join(F.broadcast(hot), "category").where("cluster <> own"), "category", "own")
    without = hot.join(others, ["category", "own"], "left").select("category", F.col("own").alias("cluster"), F.coalesce("best", F.array().cast("array<bigint>")).alias("without"))
    found = p.select("id", "category", "cluster").join(without, ["category", "cluster"], "left").join(best, "category", "left")
    return found.select("id", F.coalesce("without", "best").alias("popular"))


def post_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each post the five best others of its category and day, as a list of ids."""
    p = score_posts(posts(spark, sf_dir), as_of()).select("id", "category", "title", "scraped_at", F.round("trend_score", 6).alias("score"))
    norm = normalize_title(F.col("title"))
    p = p.withColumn("cluster", F.when(norm == "", F.concat(F.lit("post "), F.col("id").cast("string"))).otherwise(norm))
    found = popular_elsewhere(work_table(p.drop("title"), "scores"), as_of("2024-01-30 00:00:00"))
    return found.select("id", F.coalesce(F.array_join(F.col("popular").cast("array<string>"), ","), F.lit("")).alias("popular"))


def store_issues(old: DataFrame, cards: DataFrame) -> DataFrame:
    """The store after a run: rows of this run's ``stable_id`` only; title, summary and label stay where a real summary was written.

    A run without cards leaves the store as it is.
    """
    if cards.isEmpty():
        return old
    was = old.where("stable_id IS NOT NULL").alias("o")
    kept = F.col("o.stable_id").isNotNull() & ~stale(F.col("o.summary"))
    own = [F.when(kept, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in ("title", "summary", "category_label")]
    rest = [F.col(f"n.{c}") for c in cards.columns if c not in ("title", "summary", "category_label")]
    return cards.alias("n").join(was, F.col("n.stable_id") == F.col("o.stable_id"), "left").select(*own, *rest)


def issue_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards stored over older rows of all title groups, a third each with a summary, a stand-in and none."""
    groups = title_members(spark, sf_dir).groupBy("cluster_id").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    summary = F.when(F.col("first") % 3 == 0, f"{FALLBACK} x").when(F.col("first") % 3 == 1, "a summary")
    old = groups.select(F.col("cluster_id").alias("stable_id"), F.concat(F.lit("old "), F.col("first").cast("string")).alias("title"), summary.alias("summary"), F.lit("old").alias("category_label"))
    label = first_class(F.lower("title"), ISSUE_CLASSES, ISSUE_DEFAULT)
    cards = issue_cards(spark, sf_dir).select(F.col("cluster_id").alias("stable_id"), "title", F.concat(F.lit(f"{FALLBACK} "), F.col("title")).alias("summary"), label.alias("category_label"), "issue_score", "posts")
    return store_issues(old, work_table(cards, "store"))


def score_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after an upsert: new ones with their undecayed base; posts that aren't scored again keep theirs."""
    scored = score_posts(posts(spark, sf_dir), as_of()).select("id", "scraped_at", "freshness", F.round("trend_score", 6).alias("score"))
    scored = work_table(scored, "scores")
    new = scored.where(F.col("scraped_at") > as_of("2024-01-24 00:00:00")).select(F.col("id").alias("post_id"), F.col("score").alias("trend_score"), F.round(F.when(F.col("freshness") > 1e-6, F.col("score") / F.col("freshness")).otherwise(F.col("score")), 4).alias("trend_score_base"))
    old = scored.where(F.col("scraped_at") <= as_of("2024-01-26 00:00:00")).select(F.col("id").alias("post_id"), F.lit(1.0).alias("trend_score"), F.lit(2.0).alias("trend_score_base"))
    return merge(old, new, ["post_id"])


def issue_posts(issues: DataFrame, members: DataFrame) -> DataFrame:
    """(issue, id), once each, of issues (issue, cluster_ids, post_ids) and the clusters' ``members`` (cluster_id, id)."""
    by_cluster = issues.select("issue", F.explode("cluster_ids").alias("cluster_id")).join(members, "cluster_id").select("issue", "id")
    return by_cluster.unionByName(issues.select("issue", F.explode("post_ids").alias("id"))).distinct()


def _issues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Issues of one cluster and the two posts after its first one, and their posts."""
    p = work_table(_clustered(spark, sf_dir).select("id", "cluster", "title", "category", "source_key", "view_count", "scraped_at"), "issues")
    members = p.where("cluster IS NOT NULL").join(clusters_of(p.where("cluster IS NOT NULL")).where("member_count > 1").select("cluster", "cluster_id"), "cluster").select("cluster_id", "id")
    issues = members.select("cluster_id").distinct().select(F.col("cluster_id").alias("issue"), F.array("cluster_id").alias("cluster_ids"), F.array(F.col("cluster_id") + 1, F.col("cluster_id") + 2).alias("post_ids"))
    return p, issue_posts(issues, members)


def issue_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of each issue by category: how many, their views, the best one."""
    p, held = _issues(spark, sf_dir)
    return held.join(p, "id").groupBy("issue", "category").agg(F.count("*").alias("posts"), F.sum("view_count").cast("long").alias("views"), F.max_by("id", F.struct("view_count", F.negate("id"))).alias("best_id"))


def rule_summary(title: Column, lead: Column, n: Column) -> Column:
    """A summary without a model: the title and the first other title, or how many posts there are."""
    lead = F.trim(lead)
    none = F.coalesce((lead == "") | (lead == title), F.lit(True))
    clipped = F.when(F.length(lead) > 80, F.concat(F.substring(lead, 1, 80), F.lit("…"))).otherwise(lead)
    return F.when(none, F.concat(F.substring(title, 1, 80), F.lit(" — 관련 보도 "), n.cast("string"), F.lit("건"))).otherwise(F.concat(title, F.lit(" — "), clipped))


def shown_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues with news, all if none has any; a missing or stand-in summary is made by rule from the news of most views."""
    p, held = _issues(spark, sf_dir)
    joined, news = held.join(p, "id"), F.col("category") == "news"
    i = joined.groupBy("issue").agg(
        F.min_by("title", "id").alias("title"), F.count_if(news).alias("n_news"), F.max_by(F.when(news, F.col("title")), F.when(news, F.struct("view_count", F.negate("id")))).alias("lead"))
    i = work_table(i, "shown")
    summary = F.when(F.col("issue") % 3 == 0, f"{FALLBACK} x").when(F.col("issue") % 3 == 1, "a summary")
    some = i.agg(F.bool_or(F.col("n_news") > 0).alias("some"))
    kept = i.join(F.broadcast(some)).where("n_news > 0 OR NOT some")
    return kept.select("issue", F.when(stale(summary), rule_summary(F.col("title"), F.col("lead"), F.col("n_news"))).otherwise(summary).alias("summary"), "n_news")


def titles_of(held: DataFrame, n: int = TITLES) -> DataFrame:
    """The first ``n`` titles of each issue of posts (issue, title, snippet, source_key), each with the source of its last snippet.

    Snippets are ordered as text, missing ones as empty; of equals the greatest source.
    """
    one = held.groupBy("issue", "title").agg(F.max(F.struct(F.coalesce("snippet", F.lit("")).alias("snippet"), "source_key")).alias("last"))
    return top_per(one, "issue", n, F.col("title")).select("issue", "title", F.col("last.source_key").alias("source_key"))


def summary_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summary of each issue is made from. Two of three posts have a snippet."""
    p, held = _issues(spark, sf_dir)
    snippet = F.when(F.col("id") % 3 > 0, F.concat(F.lit("about "), F.pmod(F.col("id") * 7, F.lit(11)).cast("string")))
    return titles_of(held.join(p, "id").withColumn("snippet", snippet))


def cached_summaries(cache: DataFrame, issues: DataFrame) -> DataFrame:
    """Hits of issues (fingerprint, top_ids) in the cache (fingerprint, cached_ids, hit_count): their change and count after the hit."""
    change = change_rate(F.col("cached_ids"), F.col("top_ids"))
    hit = cache.join(issues, "fingerprint").withColumn("change", change).where(F.col("change") < CHANGED)
    return hit.select("fingerprint", F.round("change", 6).alias("change"), (F.col("hit_count") + 1).alias("hit_count"))


def summary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues whose five least ids changed little in the last half day."""
    p = _clustered(spark, sf_dir).where("cluster IS NOT NULL").select("cluster", "id", "scraped_at")
    least = lambda df, name: top_per(df, "cluster", 5, F.col("id")).groupBy(F.col("cluster").alias("fingerprint")).agg(F.collect_list("id").alias(name))
    cache = least(p.where(F.col("scraped_at") <= as_of("2024-01-30 12:00:00")), "cached_ids").withColumn("hit_count", F.lit(1).cast("long"))
    hits = cached_summaries(cache, least(p, "top_ids"))
    return hits.select(F.md5(F.encode("fingerprint", "UTF-8")).alias("fingerprint"), "change", "hit_count")


def cohesion(vectors: DataFrame) -> DataFrame:
    """(cluster, n, cohesion): the mean cosine of all pairs of a cluster's vectors (cluster, id, v); null below two.

    Unit vectors' cosines sum to (|their sum|² - n) / 2, so no pairs are made. Zero and null vectors take no part;
    vectors of one cluster have one length.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.withColumn("norm", norm).where("norm > 0").select("cluster", F.posexplode(F.transform("v", lambda x: x / F.col("norm"))).alias("i", "x"))
    parts = unit.groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return parts.groupBy("cluster").agg(F.max("n").alias("n"), F.sum(F.col("x") * F.col("x")).alias("q")).select("cluster", "n", F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("cohesion"))


def label_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("v"))
    return cohesion(v).select(F.col("cluster").alias("label"), "n", F.round("cohesion", 6).alias("cohesion"))


def judged(results: DataFrame) -> DataFrame:
    """One row of results (coherence, title_quality, outliers, cost): upper median and mean of coherence (null: 0), how many are low
    (null isn't), the mean title quality and the share with outliers. Values are counted first: the median is of few rows."""
    counted = results.groupBy(F.coalesce("coherence", F.lit(0)).alias("x")).agg(F.count("*").alias("k"))
    running = counted.select("x", F.sum("k").over(Window.orderBy("x")).alias("upto"), F.sum("k").over(Window.partitionBy(F.lit(1))).alias("all"))
    middle = running.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("x").alias("coherence_p50"))
    rest = results.agg(
        F.count("*").alias("count"), F.round(F.avg(F.coalesce("coherence", F.lit(0))), 6).alias("coherence_avg"), F.count_if(F.col("coherence") < 6).alias("low_count"),
        F.round(F.avg(F.coalesce("title_quality", F.lit(0))), 6).alias("title_avg"), F.round(F.avg((F.col("outliers") > 0).cast("double")), 6).alias("outlier_ratio"), F.round(F.sum("cost"), 6).alias("cost"))
    return rest.join(F.broadcast(middle))


def judge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements of all labelled documents, as one row."""
    i = F.col("doc_id")
    return judged(read(spark, sf_dir, "labels").select(F.when(i % 7 != 0, i % 11).alias("coherence"), F.when(i % 5 != 0, F.col("quality") * 10).alias("title_quality"), (i % 3 - 1).alias("outliers"), (i % 10 / 1000).alias("cost")))


def video_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of video posts after a look-up by video: each only grows; whether a snapshot is taken."""
    i, p = F.col("id"), posts(spark, sf_dir).where("category = 'video'")
    name = F.lpad((i % 40).cast("string"), 11, "0")
    url = F.element_at(F.array(F.concat(F.lit("https://t.test/watch?x=1&v="), name), F.concat(F.lit("https://youtu.be/"), name), F.concat(F.lit("https://t.test/embed/"), name), F.col("url")), (i % 4 + 1).cast("int"))
    found = spark.range(40).select(F.lpad(F.col("id").cast("string"), 11, "0").alias("video"), (F.col("id") * 100).alias("vc"), F.col("id").alias("cc"), (F.col("id") * 2).alias("lc"))
    j = p.select("id", "view_count", "comment_count", "like_count", video_id(url).alias("video")).join(F.broadcast(found), "video")
    most = [F.greatest(c, n).alias(c) for c, n in (("view_count", "vc"), ("comment_count", "cc"), ("like_count", "lc"))]
    return j.select("id", "video", *most, (F.greatest("vc", "cc", "lc") > 0).alias("snapshot"))


def time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long ago each post came, as a label."""
    m = F.floor(F.timestamp_diff("MINUTE", F.col("scraped_at"), as_of()))
    h = F.floor(m / 60)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return posts(spark, sf_dir).select("id", F.when(m < 1, "방금 전").when(m < 60, said(m, "분 전")).when(h < 24, said(h, "시간 전")).otherwise(said(F.floor(h / 24), "일 전")).alias("ago"))


QUERIES = {f.__name__: f for f in (
    cluster_lookup, post_popular, issue_store, score_store, issue_detail, shown_issues, summary_sources, summary_hits, label_cohesion, judge_metrics, video_statistics, time_labels,
)}

_NORM = f"n AS (SELECT *, {NORMAL_SQL} AS norm FROM posts)"
_HELD = f"""{POSTS_SQL}, {_NORM}, c AS (SELECT norm, min(id) AS issue FROM n WHERE norm <> '' GROUP BY 1 HAVING count(*) > 1),
  held AS (SELECT issue, id FROM n JOIN c USING (norm) UNION SELECT issue, issue + 1 FROM c UNION SELECT issue, issue + 2 FROM c), j AS (SELECT issue, p.* FROM held JOIN posts p USING (id))"""
_STALE = "(s IS NULL OR s = '' OR s LIKE '[fallback]%')"
ORACLE_SQL = {
    "cluster_lookup": f"""WITH {POSTS_SQL}, {_NORM}, c AS (SELECT norm, min(id) AS cluster_id, first(id ORDER BY view_count DESC, scraped_at DESC, id) AS canonical_id, count(*) AS member_count FROM n WHERE norm <> '' GROUP BY 1)
      SELECT id, cluster_id, canonical_id, member_count FROM n LEFT JOIN c USING (norm)""",
    "post_popular": f"""WITH {POSTS_SQL}, {SCORED_SQL}, {FINAL_SQL}, k AS MATERIALIZED (SELECT id, category, trend_score, scraped_at, CASE WHEN {NORMAL_SQL} = '' THEN 'post ' || id ELSE {NORMAL_SQL} END AS key FROM scored),
      r AS (SELECT p.id, c.id AS other, row_number() OVER (PARTITION BY p.id ORDER BY c.trend_score DESC, c.id) AS rn FROM k p JOIN k c ON c.category = p.category AND c.key <> p.key AND c.scraped_at > TIMESTAMP '2024-01-30')
      SELECT k.id, coalesce(string_agg(other::VARCHAR, ',' ORDER BY rn), '') AS popular FROM k LEFT JOIN r ON r.id = k.id AND rn <= 5 GROUP BY 1""",
    "issue_store": f"""WITH {POSTS_SQL}, {SCORED_SQL}, {FINAL_SQL}, {_CARDS}, g AS (SELECT {H} AS sid, min(id) AS f FROM posts WHERE {NORMAL_SQL} <> '' GROUP BY 1 HAVING count(*) > 1),
      o AS (SELECT sid, 'old ' || f AS t, CASE f % 3 WHEN 0 THEN '[fallback] x' WHEN 1 THEN 'a summary' END AS s FROM g)
      SELECT cluster_id AS stable_id, CASE WHEN {_STALE} THEN title ELSE t END AS title, CASE WHEN {_STALE} THEN '[fallback] ' || title ELSE s END AS summary,
        CASE WHEN {_STALE} THEN {_classes_sql("lower(title)", ISSUE_CLASSES, ISSUE_DEFAULT)} ELSE 'old' END AS category_label, issue_score, posts FROM cards LEFT JOIN o ON sid = cluster_id""",
    "score_store": f"""WITH {POSTS_SQL}, {SCORED_SQL}, {FINAL_SQL} SELECT id AS post_id, CASE WHEN scraped_at > TIMESTAMP '2024-01-24' THEN trend_score ELSE 1.0 END AS trend_score,
      CASE WHEN scraped_at <= TIMESTAMP '2024-01-24' THEN 2.0 ELSE round(CASE WHEN freshness > 1e-6 THEN trend_score / freshness ELSE trend_score END, 4) END AS trend_score_base FROM scored""",
    "issue_detail": f"WITH {_HELD} SELECT issue, category, count(*) AS posts, sum(view_count)::BIGINT AS views, first(id ORDER BY view_count DESC, id) AS best_id FROM j GROUP BY 1, 2",
    "shown_issues": f"""WITH {_HELD}, i AS (SELECT issue, first(title ORDER BY id) AS title, count(*) FILTER (WHERE category = 'news') AS n_news, trim(first(title ORDER BY view_count DESC, id) FILTER (WHERE category = 'news')) AS lead,
        CASE issue % 3 WHEN 0 THEN '[fallback] x' WHEN 1 THEN 'a summary' END AS s FROM j GROUP BY 1)
      SELECT issue, CASE WHEN NOT {_STALE} THEN s WHEN coalesce(lead, '') IN ('', title) THEN substring(title, 1, 80) || ' — 관련 보도 ' || n_news || '건'
        ELSE title || ' — ' || substring(lead, 1, 80) || CASE WHEN length(lead) > 80 THEN '…' ELSE '' END END AS summary, n_news FROM i WHERE n_news > 0 OR (SELECT max(n_news) FROM i) = 0""",
    "summary_sources": f"""WITH {_HELD}, s AS (SELECT *, CASE WHEN id % 3 > 0 THEN 'about ' || (id * 7) % 11 ELSE '' END AS snippet FROM j),
      o AS (SELECT issue, title, first(source_key ORDER BY snippet DESC, source_key DESC) AS source_key FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY title) AS rn FROM o)
      SELECT issue, title, source_key FROM r WHERE rn <= {TITLES}""",
    "summary_hits": f"""WITH {POSTS_SQL}, {_NORM}, g AS (SELECT norm, list_slice(list_sort(list(id)), 1, 5) AS b, list_slice(list_sort(list(id) FILTER (WHERE scraped_at <= TIMESTAMP '2024-01-30 12:00:00')), 1, 5) AS a FROM n WHERE norm <> '' GROUP BY 1),
      d AS (SELECT norm, 1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS change FROM g WHERE a IS NOT NULL)
      SELECT md5(norm) AS fingerprint, round(change, 6) AS change, 2::BIGINT AS hit_count FROM d WHERE change < {CHANGED}""",
    "label_cohesion": """WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.label, avg(list_cosine_similarity(a.v, b.v)) AS c FROM v a JOIN v b ON a.label = b.label AND a.id < b.id GROUP BY 1)
      SELECT v.label, count(*) AS n, round(max(c), 6) AS cohesion FROM v LEFT JOIN p ON v.label = p.label GROUP BY 1""",
    "judge_metrics": """WITH r AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id % 11 END AS c, CASE WHEN doc_id % 5 <> 0 THEN quality * 10 END AS t, doc_id % 3 - 1 AS o, doc_id % 10 / 1000 AS k FROM labels)
      SELECT list_sort(list(coalesce(c, 0)))[count(*) // 2 + 1] AS coherence_p50, count(*) AS count, round(avg(coalesce(c, 0)), 6) AS coherence_avg, count(*) FILTER (WHERE c < 6) AS low_count,
        round(avg(coalesce(t, 0)), 6) AS title_avg, round(avg((o > 0)::INT), 6) AS outlier_ratio, round(sum(k), 6) AS cost FROM r""",
    "video_statistics": f"""WITH {POSTS_SQL} SELECT id, lpad((id % 40)::VARCHAR, 11, '0') AS video, greatest(view_count, id % 40 * 100) AS view_count, greatest(comment_count, id % 40) AS comment_count,
      greatest(like_count, id % 40 * 2) AS like_count, id % 40 > 0 AS snapshot FROM posts WHERE category = 'video' AND id % 4 < 3""",
    "time_labels": f"""WITH {POSTS_SQL}, m AS (SELECT id, date_diff('microsecond', scraped_at, TIMESTAMP '{AS_OF}') // 60000000 AS m FROM posts)
      SELECT id, CASE WHEN m < 1 THEN '방금 전' WHEN m < 60 THEN m || '분 전' WHEN m < 1440 THEN (m // 60) || '시간 전' ELSE (m // 1440) || '일 전' END AS ago FROM m""",
}
