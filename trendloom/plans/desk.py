"""Desk work around issues: video searches, samples for judges, quality of issues, comments, profiles and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AS_OF, POSTS_SQL, RUNS_SQL, as_of, comments, posts, read, scraper_runs
from ..operators.scoring import ranked, top_per
from ..operators.work import work_table
from .details import _HELD, _issues
from .issues import label_topics, topic_tokens_sql
from .posts import NORMAL_SQL

#: Keywords that searches are made from, keywords of a search, and hours between rounds of searches.
KEYWORDS, PER_SEARCH, COOLDOWN = 10, 3, 2
#: Issues that are sampled from each window, titles of an issue, and characters of a title.
SAMPLED, MEMBERS, TITLE = 10, 10, 120
WINDOWS = (6, 12, 24)
#: Issues whose topics are labelled for the figures, and posts of each.
LABELLED_ISSUES, LABELLED_POSTS = 30, 50
#: Answers to a comment of this depth are refused.
DEEPEST = 5


def video_search_terms(keywords: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """(search, terms) from the strongest live keywords (keyword, strength, expires_at), ``PER_SEARCH`` in each.

    No rows if the source's last good run (started_at, error_message) began ``COOLDOWN`` hours ago or later.
    Keywords beyond three searches are left out, as the feature has it.
    """
    last = runs.where("error_message IS NULL").agg(F.max("started_at").alias("last"))
    due = last.where(F.col("last").isNull() | (F.col("last") < now - F.expr(f"INTERVAL {COOLDOWN} HOURS")))
    top = top_per(keywords.where(F.col("expires_at") > now).withColumn("one", F.lit(1)), "one", min(KEYWORDS, 3 * PER_SEARCH), F.desc("strength"), F.col("keyword"))
    dealt = top.groupBy((F.floor((F.col("rn") - 1) / PER_SEARCH) + 1).cast("long").alias("search")).agg(F.array_sort(F.collect_list(F.struct("rn", "keyword"))).alias("k"))
    return dealt.join(F.broadcast(due), F.lit(True), "left_semi").select("search", F.array_join("k.keyword", "|").alias("terms"))  # ``due`` is one row or none


def video_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "events").groupBy(F.concat_ws(" ", "event_type", (F.col("user_id") % 40).cast("string")).alias("keyword"), (F.col("user_id") % 40).alias("k"))
    keywords = found.agg(F.max("value").alias("strength")).withColumn("expires_at", as_of() + F.make_dt_interval(hours=(F.col("k") - 10).cast("int")))
    return video_search_terms(keywords, scraper_runs(spark, sf_dir).where("source_key = 'youtube'"), as_of())


def judge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best issues of each window with some of their titles, for a judge. Titles are told apart whole and cut then."""
    p, held = _issues(spark, sf_dir)
    joined = work_table(held.join(p.select("id", "title", "view_count"), "id"), "judged")
    window = F.element_at(F.array(*[F.lit(w) for w in WINDOWS]), (F.col("issue") % 3 + 1).cast("int")).cast("long")
    scored = joined.groupBy("issue").agg(F.sum("view_count").alias("score")).withColumn("window_hours", window)
    best = top_per(scored, "window_hours", SAMPLED, F.desc("score"), F.col("issue")).select("issue", "window_hours", F.col("rn").cast("long").alias("rank"))
    # a few issues, however many there are
    titles = joined.join(F.broadcast(best), "issue").groupBy("issue", "window_hours", "rank", "title").agg(F.min("id").alias("id"))
    titles = top_per(titles, "issue", MEMBERS, F.col("title"))
    listed = titles.groupBy("issue", "window_hours", "rank").agg(F.array_sort(F.collect_list(F.struct("rn", "id", F.substring("title", 1, TITLE).alias("t")))).alias("m"))
    return listed.select("window_hours", "rank", "issue", F.array_join(F.transform("m", lambda x: x["id"].cast("string")), ",").alias("ids"), F.array_join("m.t", "|").alias("titles"))


def at_share(values: DataFrame, column: str, share: float) -> DataFrame:
    """(value): the one at floor(n * share) in order, from counts of equal values."""
    counts = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    place = F.least(F.floor(F.sum("n") * F.lit(share)), F.sum("n") - 1)
    return counts.agg(F.expr("array_sort(collect_list(struct(value, n)))").alias("all"), place.alias("place")).select(
        F.expr("aggregate(all, struct(cast(NULL AS BIGINT) AS value, 0L AS seen), (a, x) -> struct(if(a.seen <= place, x.value, a.value) AS value, a.seen + x.n AS seen)).value").alias("value")
    )


def issue_figures(issues: DataFrame, titled: DataFrame) -> DataFrame:
    """(metric_name, value) of issues (issue, score, posts, keywords) whose posts are ``titled`` (issue, id, title, view_count).

    Topics are labelled for the best issues only, and for those of their posts that have most views, as the
    feature has it; all other figures are over all issues. Percentiles count equal values first, and
    sizes of issues are few. Without issues only the first two figures are there.
    """
    bad = F.col("score").isNull() | F.isnan("score")
    total = issues.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    best = top_per(issues.withColumn("one", F.lit(1)), "one", LABELLED_ISSUES, F.desc(F.when(~bad, F.col("score")).otherwise(0)), F.col("issue")).select("issue")
    several = label_topics(titled.join(F.broadcast(best), "issue"), LABELLED_POSTS).where("titles >= 2")
    topics = several.agg(F.sum("cross_pairs").alias("c"), F.count_if(F.col("labels") >= 3).alias("w"), F.avg("labels").alias("a"))
    row = lambda df, *pairs: df.select(F.explode(F.array(*[F.struct(F.lit(f"issue.{n}").alias("metric_name"), F.coalesce(v.cast("double"), F.lit(0.0)).alias("value")) for n, v in pairs])).alias("m")).select("m.*")
    out = row(total, ("total", F.col("n")), ("score_nan_count", F.col("bad")))
    for name, column in (("posts_per_issue", "posts"), ("matched_kw_count", "keywords")):
        for share, label in ((0.5, "p50"), (0.95, "p95")):
            out = out.unionByName(row(at_share(issues, column, share).where("value IS NOT NULL"), (f"{name}_{label}", F.col("value"))))
    some = topics.join(F.broadcast(total.where("n > 0")), F.lit(True), "left_semi")  # one row each, or none
    return out.unionByName(row(some, ("cross_topic_pairs_total", F.col("c")), ("with_cross_topic_count", F.col("w")), ("label_count_avg", F.round("a", 6))))


def issue_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, held = _issues(spark, sf_dir)
    joined = work_table(held.join(p.select("id", "title", "view_count"), "id"), "quality")
    score = F.when(F.col("issue") % 13 == 0, F.lit(float("nan"))).otherwise(F.sum("view_count").cast("double"))
    issues = work_table(joined.groupBy("issue").agg(score.alias("score"), F.count("*").alias("posts")).withColumn("keywords", F.col("issue") % 4), "issues")
    return issue_figures(issues, joined)


def changed_comments(stored: DataFrame, edits: DataFrame, deletes: DataFrame, replies: DataFrame) -> DataFrame:
    """``stored`` (post_id, id, author, depth, body, is_deleted) after edits, deletions and replies.

    Only the author changes a comment, and only one that isn't deleted; an edit comes before a deletion.
    A reply (post_id, id, parent_id, author, body) needs a parent of its post, at most ``DEEPEST`` - 1 deep;
    one without parent_id starts a thread. ``edits`` and ``deletes`` (post_id, id, author) have each key once.
    """
    e = edits.select("post_id", "id", F.col("author").alias("editor"), F.col("body").alias("new_body"))
    d = deletes.select("post_id", "id", F.col("author").alias("deleter"))
    both = stored.join(e, ["post_id", "id"], "left").join(d, ["post_id", "id"], "left")
    own = lambda who: F.coalesce((F.col(who) == F.col("author")) & ~F.col("is_deleted"), F.lit(False))
    body = F.when(own("deleter"), "").when(own("editor"), F.col("new_body")).otherwise(F.col("body"))
    kept = both.select("post_id", "id", "author", "depth", body.alias("body"), (F.col("is_deleted") | own("deleter")).alias("is_deleted"))
    parents = stored.select("post_id", F.col("id").alias("parent_id"), (F.col("depth") + 1).alias("below"))
    placed = replies.join(parents, ["post_id", "parent_id"], "left").where("parent_id IS NULL OR below IS NOT NULL").withColumn("depth", F.coalesce("below", F.lit(0)))
    new = placed.where(F.col("depth") <= DEEPEST).select("post_id", "id", "author", F.col("depth").cast("long"), "body", F.lit(False).alias("is_deleted"))
    return kept.unionByName(new)


def edited_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = comments(spark, sf_dir)
    k = F.col("post_id") + F.col("id")
    stored = c.select("post_id", "id", "author", F.col("id").alias("depth"), F.substring("body", 1, 20).alias("body"), (k % 11 == 0).alias("is_deleted"))
    edits = c.where(k % 5 == 0).select("post_id", "id", F.when(k % 10 == 0, "nobody").otherwise(F.col("author")).alias("author"), F.lit("edited").alias("body"))
    deletes = c.where(k % 7 == 0).select("post_id", "id", F.when(k % 2 == 0, "nobody").otherwise(F.col("author")).alias("author"))
    replies = c.where(k % 4 == 1).select("post_id", (F.col("id") + 1000).alias("id"), F.when(k % 3 > 0, F.col("id") + F.when(k % 3 == 1, 0).otherwise(500)).alias("parent_id"), "author", F.lit("reply").alias("body"))
    return changed_comments(stored, edits, deletes, replies)


def save_profiles(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """``stored`` (id, nickname, avatar_url) after the requests ``wanted``, of which each id has one.

    Refused is a nickname, whatever its case, that another id had before, or that a lesser id asks for too.
    """
    owner = stored.groupBy(F.lower("nickname").alias("nick")).agg(F.min("id").alias("owner"), F.max("id").alias("owner_too"))
    first = wanted.groupBy(F.lower("nickname").alias("nick")).agg(F.min("id").alias("first"))
    checked = wanted.withColumn("nick", F.lower("nickname")).join(owner, "nick", "left").join(first, "nick")
    free = F.col("owner").isNull() | ((F.col("owner") == F.col("id")) & (F.col("owner_too") == F.col("id")))
    new = checked.where(free).where("first = id").select("id", F.col("nickname").alias("n"), F.col("avatar_url").alias("a"), F.lit(True).alias("saved"))
    both = stored.join(new, "id", "full")
    pick = lambda new, old: F.when(F.col("saved"), F.col(new)).otherwise(F.col(old))
    return both.select("id", pick("n", "nickname").alias("nickname"), pick("a", "avatar_url").alias("avatar_url"))


def saved_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir).select("id", "url")
    stored = p.where("id % 2 = 0").select("id", F.concat(F.lit("Nick"), F.col("id").cast("string")).alias("nickname"), F.col("url").alias("avatar_url"))
    wanted = p.where("id % 3 = 0").select("id", F.concat(F.lit("NICK"), (F.col("id") + F.col("id") % 5).cast("string")).alias("nickname"), F.lit(None).cast("string").alias("avatar_url"))
    return save_profiles(stored, wanted)


def event_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on, ahead and over, in this order and then by their first day."""
    start = F.date_add(F.to_date("scraped_at"), (F.col("id") % 21).cast("int"))
    e = posts(spark, sf_dir).select("id", start.alias("start"), F.date_add(start, (F.col("id") % 9).cast("int")).alias("end"))
    today = F.to_date(as_of())
    status = F.when(today < F.col("start"), "upcoming").when(today > F.col("end"), "ended").otherwise("ongoing")
    order = F.when(F.col("status") == "ongoing", 0).when(F.col("status") == "upcoming", 1).otherwise(2)
    return ranked(e.withColumn("status", status).withColumn("o", order), F.asc("o"), F.asc("start"), F.asc("id")).select("rank", "id", "status")


def quiet_hours(at: Column) -> Column:
    """From 2 to 6 in the morning, at UTC+9."""
    return ((F.hour(at) + 9) % 24).between(2, 5)


def quiet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources' runs in and out of the quiet hours."""
    quiet = quiet_hours(F.col("started_at"))
    return scraper_runs(spark, sf_dir).groupBy("source_key").agg(F.count_if(quiet).alias("quiet"), F.count_if(~quiet).alias("busy"))


QUERIES = {f.__name__: f for f in (video_searches, judge_samples, issue_quality, edited_comments, saved_profiles, event_status, quiet_runs)}

_JUDGED = f"""{_HELD}, scored AS (SELECT issue, [6, 12, 24][issue % 3 + 1]::BIGINT AS window_hours, sum(view_count) AS score FROM j GROUP BY 1),
  best AS (SELECT *, row_number() OVER (PARTITION BY window_hours ORDER BY score DESC, issue) AS rank FROM scored)"""
_AT = lambda c, share: f"list_sort(list({c}))[least(floor(count(*) * {share}), count(*) - 1)::BIGINT + 1]"
ORACLE_SQL = {
    "video_searches": f"""WITH {RUNS_SQL}, k AS (SELECT event_type || ' ' || (user_id % 40) AS keyword, max(value) AS strength, user_id % 40 - 10 AS hours FROM events GROUP BY 1, 3),
      r AS (SELECT *, row_number() OVER (ORDER BY strength DESC, keyword) AS rn FROM k WHERE hours > 0)
      SELECT ((rn - 1) // 3 + 1)::BIGINT AS search, string_agg(keyword, '|' ORDER BY rn) AS terms FROM r WHERE rn <= 9
        AND coalesce((SELECT max(started_at) FROM runs WHERE source_key = 'youtube' AND error_message IS NULL) < TIMESTAMP '{AS_OF}' - INTERVAL {COOLDOWN} HOUR, true) GROUP BY 1""",
    "judge_samples": f"""WITH {_JUDGED}, t AS (SELECT issue, title, min(id) AS id, row_number() OVER (PARTITION BY issue ORDER BY title) AS rn FROM j GROUP BY 1, 2)
      SELECT window_hours, rank, issue, string_agg(id::VARCHAR, ',' ORDER BY rn) AS ids, string_agg(substring(title, 1, {TITLE}), '|' ORDER BY rn) AS titles
      FROM best JOIN t USING (issue) WHERE rank <= {SAMPLED} AND rn <= {MEMBERS} GROUP BY 1, 2, 3""",
    "issue_quality": f"""WITH RECURSIVE {_HELD}, i AS (SELECT issue, CASE WHEN issue % 13 = 0 THEN NULL ELSE sum(view_count) END AS score, count(*) AS posts, issue % 4 AS keywords FROM j GROUP BY 1),
      b AS (SELECT issue FROM i ORDER BY coalesce(score, 0) DESC, issue LIMIT {LABELLED_ISSUES}),
      m AS (SELECT issue, title, row_number() OVER (PARTITION BY issue ORDER BY view_count DESC, id) AS rn FROM j JOIN b USING (issue) WHERE title <> ''),
      t AS MATERIALIZED (SELECT DISTINCT issue, {NORMAL_SQL} AS norm FROM m WHERE rn <= {LABELLED_POSTS}),
      w AS MATERIALIZED (SELECT issue, norm, {topic_tokens_sql("norm")} AS k FROM t),
      l AS MATERIALIZED (SELECT a.issue, a.norm AS x, b.norm AS y FROM w a JOIN w b ON a.issue = b.issue
        WHERE a.norm = b.norm OR list_sort(a.k) = list_sort(b.k) OR len(list_intersect(a.k, b.k)) >= 0.4 * len(list_distinct(list_concat(a.k, b.k))) AND len(list_intersect(a.k, b.k)) > 0),
      g AS (SELECT issue, norm AS x, norm AS y FROM w UNION SELECT g.issue, g.x, l.y FROM g JOIN l ON l.issue = g.issue AND l.x = g.y),
      lab AS (SELECT issue, x, min(y) AS label FROM g GROUP BY 1, 2), cnt AS (SELECT issue, label, count(*) AS n FROM lab GROUP BY 1, 2),
      p AS (SELECT issue, count(*) AS labels, sum(n) AS titles, (sum(n) * sum(n) - sum(n * n)) / 2 AS pairs FROM cnt GROUP BY 1 HAVING sum(n) >= 2),
      f AS (SELECT count(*) AS total, count(*) FILTER (WHERE score IS NULL) AS bad, {_AT("posts", 0.5)} AS p50, {_AT("posts", 0.95)} AS p95, {_AT("keywords", 0.5)} AS k50, {_AT("keywords", 0.95)} AS k95 FROM i),
      s AS (SELECT coalesce(sum(pairs), 0) AS pairs, count(*) FILTER (WHERE labels >= 3) AS many, coalesce(round(avg(labels), 6), 0) AS mean FROM p)
      SELECT 'issue.' || u[1] AS metric_name, u[2]::DOUBLE AS value FROM (SELECT unnest([['total', total::VARCHAR], ['score_nan_count', bad::VARCHAR], ['posts_per_issue_p50', p50::VARCHAR], ['posts_per_issue_p95', p95::VARCHAR],
        ['matched_kw_count_p50', k50::VARCHAR], ['matched_kw_count_p95', k95::VARCHAR], ['cross_topic_pairs_total', pairs::VARCHAR], ['with_cross_topic_count', many::VARCHAR], ['label_count_avg', mean::VARCHAR]]) AS u FROM f, s)""",
    "edited_comments": f"""WITH c AS (SELECT conv_id AS post_id, turn::BIGINT AS id, role AS author, turn::BIGINT AS depth, substring(text, 1, 20) AS body, (conv_id + turn) AS k FROM conversations),
      o AS (SELECT *, k % 11 = 0 AS gone, k % 5 = 0 AND k % 10 <> 0 AND k % 11 <> 0 AS edited, k % 7 = 0 AND k % 2 <> 0 AND k % 11 <> 0 AS removed FROM c),
      r AS (SELECT post_id, id, author, CASE WHEN k % 3 > 0 THEN id + CASE WHEN k % 3 = 1 THEN 0 ELSE 500 END END AS parent FROM c WHERE k % 4 = 1)
      SELECT post_id, id, author, depth, CASE WHEN removed THEN '' WHEN edited THEN 'edited' ELSE body END AS body, gone OR removed AS is_deleted FROM o
      UNION ALL SELECT r.post_id, r.id + 1000, r.author, coalesce(p.depth + 1, 0), 'reply', false FROM r LEFT JOIN c p ON p.post_id = r.post_id AND p.id = r.parent
        WHERE (parent IS NULL OR p.id IS NOT NULL) AND coalesce(p.depth + 1, 0) <= {DEEPEST}""",
    "saved_profiles": f"""WITH {POSTS_SQL}, s AS (SELECT id, 'Nick' || id AS nickname, url FROM posts WHERE id % 2 = 0),
      w AS (SELECT id, 'NICK' || (id + id % 5) AS nickname, min(id) OVER (PARTITION BY id + id % 5) AS first FROM posts WHERE id % 3 = 0),
      ok AS (SELECT id, nickname FROM w WHERE first = id AND NOT EXISTS (SELECT 1 FROM s WHERE lower(s.nickname) = lower(w.nickname) AND s.id <> w.id))
      SELECT id, CASE WHEN ok.id IS NOT NULL THEN ok.nickname ELSE s.nickname END AS nickname, CASE WHEN ok.id IS NULL THEN url END AS avatar_url FROM s FULL JOIN ok USING (id)""",
    "event_status": f"""WITH {POSTS_SQL}, e AS (SELECT id, scraped_at::DATE + (id % 21)::INT AS s, scraped_at::DATE + (id % 21)::INT + (id % 9)::INT AS e FROM posts),
      t AS (SELECT id, s, CASE WHEN DATE '{AS_OF[:10]}' < s THEN 'upcoming' WHEN DATE '{AS_OF[:10]}' > e THEN 'ended' ELSE 'ongoing' END AS status FROM e)
      SELECT row_number() OVER (ORDER BY CASE status WHEN 'ongoing' THEN 0 WHEN 'upcoming' THEN 1 ELSE 2 END, s, id) AS rank, id, status FROM t""",
    "quiet_runs": f"""WITH {RUNS_SQL}, q AS (SELECT source_key, (hour(started_at) + 9) % 24 BETWEEN 2 AND 5 AS quiet FROM runs)
      SELECT source_key, count(*) FILTER (WHERE quiet) AS quiet, count(*) FILTER (WHERE NOT quiet) AS busy FROM q GROUP BY 1""",
}
