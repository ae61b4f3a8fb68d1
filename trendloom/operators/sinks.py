"""Writes as plans: each gives the rows that a table holds after a batch. Tables are keyed; every step is one join or one grouping."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import xml_escape

#: Longest texts that are stored, and longest metadata (longer ones are dropped, as cut JSON is none).
LONGEST = {"source_key": 100, "source_name": 100, "title": 300, "author": 100, "content_snippet": 4000}
LONGEST_URL, LONGEST_METADATA = 2048, 8192
COUNTERS = ("view_count", "comment_count", "like_count")
#: Categories that a new batch replaces as a whole, and days that they and all others are kept.
RANKED, RANKED_DAYS, POST_DAYS = ("performance", "books", "ott"), 7, 7


def plain(text: Column) -> Column:
    """Without tags, control characters and spaces at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


def full_url(url: Column) -> Column:
    """Trimmed; ``//host`` gets its scheme."""
    url = F.trim(url)
    return F.substring(F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url), 1, LONGEST_URL)


def sanitize(posts: DataFrame) -> DataFrame:
    """Posts as they may be stored; null counters become 0, other columns stay."""
    have = set(posts.columns)
    new = {c: F.substring(plain(F.col(c)), 1, n) for c, n in LONGEST.items() if c in have}
    new |= {c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in COUNTERS if c in have}
    if "url" in have:
        new["url"] = F.substring(F.trim("url"), 1, LONGEST_URL)
    if "thumbnail" in have:
        new["thumbnail"] = full_url(F.col("thumbnail"))
    if "metadata" in have:
        new["metadata"] = F.when(F.length("metadata") <= LONGEST_METADATA, F.col("metadata"))
    return posts.withColumns(new)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the greatest by ``order``. A grouped maximum, so combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*[c if c in keys else F.col(f"row.`{c}`") for c in df.columns])


def merge(old: DataFrame, new: DataFrame, keys: list[str], rules: dict | None = None) -> DataFrame:
    """``old`` after an upsert of ``new``, which has each key once.

    A column's rule takes (old value, new value) and holds where a key is on both sides; without one the
    new value wins, even if null. Rows with a null key part match nothing and stay.
    """
    rules = rules or {}
    a, b = old.withColumn("_in", F.lit(1)).alias("a"), new.withColumn("_in", F.lit(1)).alias("b")
    joined = a.join(b, functools.reduce(operator.and_, [F.col(f"a.`{k}`") == F.col(f"b.`{k}`") for k in keys]), "full_outer")
    was, comes = F.col("a._in").isNotNull(), F.col("b._in").isNotNull()

    def value(c: str) -> Column:
        x, y = F.col(f"a.`{c}`"), F.col(f"b.`{c}`")
        if c in keys:
            return F.coalesce(x, y).alias(c)
        both = rules[c](x, y) if c in rules else y
        return F.when(was & comes, both).when(comes, y).otherwise(x).alias(c)

    return joined.select(*[value(c) for c in old.columns])


def upsert_posts(old: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Counters grow only, a snippet stays, metadata is the newest known, all else but the category is the old row's."""
    rules = {c: (lambda x, y: x) for c in old.columns}
    rules |= {c: F.greatest for c in COUNTERS}
    rules |= {"content_snippet": F.coalesce, "metadata": lambda x, y: F.coalesce(y, x), "category": lambda x, y: y, "scraped_at": lambda x, y: at}
    return merge(old, new, ["url"], rules)


def replace_sources(old: DataFrame, new: DataFrame, ranked: tuple = RANKED) -> DataFrame:
    """Ranked sources hold their last batch only: their old rows go, the batch comes."""
    fresh = new.where(F.col("category").isin(*ranked))
    return old.join(fresh.select("source_key").distinct(), "source_key", "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def new_snapshots(posts: DataFrame, batch: DataFrame, at: Column) -> DataFrame:
    """Snapshots of the batch's rows that have a counter and a known url."""
    some = functools.reduce(operator.or_, [F.col(c) > 0 for c in COUNTERS])
    return batch.where(some).select("url", *COUNTERS).join(posts.select("url", F.col("id").alias("post_id")), "url").select("post_id", *COUNTERS, at.alias("captured_at"))


def upsert_trends(old: DataFrame, new: DataFrame, at: Column, hours: int = 12) -> DataFrame:
    """Keywords by (keyword_normalized, source_key); strengths from 0 to 1, kept for ``hours`` from now."""
    strength = F.least(F.greatest(F.col("signal_strength"), F.lit(0.0)), F.lit(1.0))
    fresh = new.withColumns({"signal_strength": strength, "scraped_at": at, "expires_at": at + F.make_dt_interval(hours=F.lit(hours))})
    fresh = latest(fresh, ["keyword_normalized", "source_key"], F.col("signal_strength"), F.col("keyword"))
    return merge(old, fresh.select(*old.columns), ["keyword_normalized", "source_key"])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key ``old`` hasn't."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def kept_posts(posts: DataFrame, as_of: Column, days: int = POST_DAYS, ranked: tuple = RANKED) -> DataFrame:
    """Posts that retention leaves: ranked categories by their own days; a null category is never removed."""
    limit = F.when(F.col("category").isin(*ranked), F.lit(RANKED_DAYS)).otherwise(F.lit(days))
    old = F.col("category").isNotNull() & (F.col("scraped_at") < as_of - F.make_dt_interval(days=limit))
    return posts.where(~F.coalesce(old, F.lit(False)))


def kept_since(df: DataFrame, at: str, as_of: Column, hours: int) -> DataFrame:
    return df.where(F.col(at) >= as_of - F.make_dt_interval(hours=F.lit(hours)))


def count_votes(votes: DataFrame) -> DataFrame:
    """Votes by post, one of each (post_id, voter)."""
    return votes.select("post_id", "voter").distinct().groupBy("post_id").agg(F.count("voter").alias("vote_count"))


def comment_votes(votes: DataFrame) -> DataFrame:
    """Scores by comment from each voter's last vote (1, -1; 0 takes it back)."""
    last = latest(votes.select("comment_id", "voter", "vote", "at", "id"), ["comment_id", "voter"], F.col("at"), F.col("id"))
    up, down = F.count_if(F.col("vote") > 0), F.count_if(F.col("vote") < 0)
    return last.groupBy("comment_id").agg(up.alias("upvotes"), down.alias("downvotes"), (up - down).alias("vote_score"))


def with_rank(df: DataFrame, *order: Column, most: int) -> DataFrame:
    """The first ``most`` rows and their rank; the limit comes first, so one task ranks ``most`` rows at most."""
    return df.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def _joined(first: DataFrame, line: Column) -> Column:
    return F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x.line))


def feed_document(posts: DataFrame, title: str, link: str, most: int = 50) -> DataFrame:
    """One row, ``body``: an RSS 2.0 document of the newest ``most`` posts (a property of feeds)."""
    element = lambda name, c: F.concat(F.lit(f"<{name}>"), xml_escape(F.coalesce(c, F.lit(""))), F.lit(f"</{name}>"))
    date = F.date_format(F.coalesce("published_at", "scraped_at"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    item = F.concat(F.lit("<item>"), element("title", F.col("title")), element("link", F.col("url")), element("guid", F.col("url")), element("pubDate", date), element("category", F.col("category")), F.lit("</item>"))
    newest = with_rank(posts, F.desc("scraped_at"), F.desc("id"), most=most)
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel>'
    return newest.agg(F.concat(F.lit(head), element("title", F.lit(title)), element("link", F.lit(link)), F.lit("\n"), _joined(newest, item), F.lit("\n</channel></rss>")).alias("body"))


def sitemap_document(posts: DataFrame, base: str, fixed: tuple, as_of: Column, days: int = 14, most: int = 2000) -> DataFrame:
    """One row, ``body``: fixed pages and the newest ``most`` posts of the last ``days``."""
    newest = with_rank(posts.where(F.col("scraped_at") > as_of - F.make_dt_interval(days=F.lit(days))), F.desc("scraped_at"), F.desc("id"), most=most)
    url = F.concat(F.lit(f"<url><loc>{base}/issue/"), F.col("id").cast("string"), F.lit("</loc><lastmod>"), F.date_format("scraped_at", "yyyy-MM-dd"), F.lit("</lastmod></url>"))
    pages = "\n".join(f"<url><loc>{base}{p}</loc></url>" for p in fixed)
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    return newest.agg(F.concat(F.lit(head + pages + "\n"), _joined(newest, url), F.lit("\n</urlset>")).alias("body"))


def backup(df: DataFrame, path: str, derived: tuple = ()) -> None:
    """JSON lines, gzipped, one file a partition; derived columns are left out."""
    df.drop(*derived).write.mode("errorifexists").option("ignoreNullFields", "false").json(path, compression="gzip")
