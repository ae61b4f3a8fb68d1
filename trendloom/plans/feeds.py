"""Sources over the test tables: pages, the list of sources, sections, forecasts and visitors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_korean_date
from ..model import AS_OF, POSTS_SQL, RUNS_SQL, as_of, posts, read, scraper_runs
from ..operators.scoring import top_per
from ..sources import feeds, selectors

#: Event types as weather categories.
CATEGORIES = {"view": "TMP", "click": "SKY", "error": "POP", "signup": "PCP", "purchase": "REH"}


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", feeds.page_title(F.col("html")).alias("title"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.links(read(spark, sf_dir, "pages"))


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' article text, by the selectors of their host's rule or those for any host."""
    return read(spark, sf_dir, "pages").select("page_id", selectors.article_bodies(F.col("html"), F.col("url")).alias("body")).where("body IS NOT NULL")


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of pages' navigation as typed rows."""
    return selectors.listed(read(spark, sf_dir, "pages"), "nav > ul > li", {"href": "a@href", "label": "a"})


#: Entries and items of a feed at most, as feeds have them.
FEED = 30
_XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def _escaped(text):
    for a, b in _XML:
        text = F.replace(text, F.lit(a), F.lit(b))
    # what XML can't hold
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def _bodies(p: DataFrame, item, head: str, tail: str) -> DataFrame:
    """(source_key, body): a feed of each source's latest posts."""
    latest = top_per(p.where("source_key IS NOT NULL"), "source_key", FEED, F.desc("scraped_at"), F.col("id"))
    listed = latest.groupBy("source_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", item.alias("x")))), lambda r: r["x"]).alias("items"))
    return listed.select("source_key", F.concat(F.lit(head), F.array_join("items", ""), F.lit(tail)).alias("body"))


def video_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of sources' Atom feeds, out of their nested media groups; the feeds are made of posts."""
    p = posts(spark, sf_dir).where("length(trim(title)) > 0")
    at = F.coalesce("published_at", "scraped_at")
    item = F.concat(
        F.lit("<entry><id>yt:"), F.col("id"), F.lit("</id><title>"), _escaped(F.col("title")), F.lit('</title><link rel="self" href="https://x.test/"/><link rel="alternate" href="'), F.col("url"), F.lit('"/><author><name>'), F.col("source_name"),
        F.lit("</name></author><published>"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit('+00:00</published><media:group><media:thumbnail url="https://i.test/'), F.col("id"),
        F.lit('.jpg" width="480"/><media:description>'), _escaped(F.col("title")), F.lit("</media:description></media:group></entry>"),
    )
    head = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/"><title>t</title>'
    out = feeds.video_posts(_bodies(p, item, head, "</feed>"), as_of())
    return out.select("source_key", "url", F.length("title").alias("title_length"), "thumbnail", F.length("content_snippet").alias("snippet_length"), "author", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


def _dated(at, n):
    """A time as feeds write it, in one of five ways by ``n``."""
    korean = F.from_utc_timestamp(at.cast("timestamp"), "Asia/Seoul")
    half = F.when(F.hour(korean) < 12, "오전").otherwise("오후")
    hour = F.when(F.hour(korean) % 12 == 0, 12).otherwise(F.hour(korean) % 12).cast("string")
    return (
        F.when(n == 0, F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(n == 1, F.date_format(korean, "EEE, dd MM yyyy HH:mm:ss '+0900'")).when(n == 2, F.date_format(korean, "yyyy-MM-dd HH:mm:ss"))
        .when(n == 3, F.concat(F.date_format(korean, "yyyy년 M월 d일 "), half, F.lit(" "), hour, F.date_format(korean, ":mm:ss"))).otherwise(F.date_format(korean, "yyyy.MM.dd"))
    )


def rss_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of sources' feeds, dates in all the ways that feeds write them; the feeds are made of posts."""
    p = posts(spark, sf_dir).where("length(trim(title)) > 0")
    item = F.concat(
        F.lit("<item><title>"), _escaped(F.col("title")), F.when(F.col("id") % 4 == 0, F.concat(F.lit('</title><guid isPermaLink="true"> '), F.col("url"), F.lit("</guid>"))).otherwise(F.concat(F.lit("</title><link>"), F.col("url"), F.lit("</link>"))),
        F.lit("<pubDate>"), _dated(F.col("scraped_at"), F.col("id") % 5), F.lit("</pubDate></item>"),
    )
    out = feeds.rss_posts(_bodies(p, item, '<rss version="2.0"><channel><title>t</title>', "</channel></rss>"), as_of())
    return out.select("source_key", "url", F.length("title").alias("title_length"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


def korean_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as Korean boards write them, read again: minutes, hours and days ago, whole dates, days of this year, times of today."""
    p = posts(spark, sf_dir).select("id", F.col("scraped_at").alias("at"))
    korean = F.from_utc_timestamp(F.col("at").cast("timestamp"), "Asia/Seoul")
    n = F.col("id") % 6
    minutes = F.floor(F.timestamp_diff("SECOND", F.col("at"), as_of()) / 60).cast("string")
    text = (
        F.when(n == 0, F.concat(minutes, F.lit("분 전"))).when(n == 1, F.concat((F.col("id") % 23).cast("string"), F.lit("시간 전"))).when(n == 2, F.concat((F.col("id") % 6).cast("string"), F.lit("일전")))
        .when(n == 3, F.date_format(korean, "yyyy.MM.dd HH:mm")).when(n == 4, F.date_format(korean, "MM-dd")).otherwise(F.date_format(korean, "HH:mm"))
    )
    return p.select("id", F.date_format(parse_korean_date(text, as_of()), "yyyy-MM-dd HH:mm:ss").alias("at"))


def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with posts, but those whose last run failed; runs are the overrides."""
    listed = posts(spark, sf_dir).select("source_key").unionByName(scraper_runs(spark, sf_dir).select("source_key")).distinct().withColumn("enabled", F.lit(True))
    last = scraper_runs(spark, sf_dir).groupBy("source_key").agg(F.max_by(F.col("error_message").isNull(), F.struct("started_at", "id")).alias("enabled"))
    return feeds.registry(listed, last).select("source_key")


def feed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections are categories, places come from scrape time; a title stands for an address."""
    from pyspark.sql import Window

    p = posts(spark, sf_dir).select(F.col("category").alias("section"), F.row_number().over(Window.partitionBy("category").orderBy(F.desc("scraped_at"), "id")).alias("rn"), F.col("title").alias("url"), "id")
    # a filter on the number itself lets each task limit its rows before they are sorted together
    first = p.where(F.col("rn") <= 30).select("section", (F.col("rn") - 1).cast("long").alias("place"), "url", "id")
    return feeds.sections(first, 120, 4).select("section", "place", "id")


def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return read(spark, sf_dir, "events").select(F.concat(F.lit("city"), F.col("user_id") % 20).alias("city"), F.date_trunc("hour", "ts").alias("hour"), kind[F.col("event_type")].alias("category"), F.col("value").cast("string").alias("value"))


def forecast_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.forecast(_weather(spark, sf_dir)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


def visitor_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.visitor_trend(read(spark, sf_dir, "events").select(F.concat(F.lit("r"), F.col("user_id") % 20).alias("region"), F.to_date("ts").alias("day"), F.lit(1).alias("n")))


QUERIES = {f.__name__: f for f in (page_titles, page_links, page_articles, page_rows, video_feeds, rss_feeds, korean_dates, source_registry, feed_sections, forecast_hours, visitor_trend)}
_LINK = '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'


def _plain(html: str) -> str:
    """Text of markup, as test pages have it."""
    plain = f"regexp_replace({html}, '<[^>]*>', '', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        plain = f"replace({plain}, '{a}', '{b}')"
    return plain


def _spaced(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[\s\x{{A0}}]+', ' ', 'g'))"


def _article(tag: str) -> str:
    """Paragraphs within ``tag``, which end at their end tags or where the next block begins, and all text within."""
    inner = f"regexp_extract(clean, '(?s)<{tag}(?: [^>]*)?>(.*?)(?:</{tag}>|$)', 1)"
    ended = "string_split_regex(p, '</p>|<(?:div|ul|ol|table|section|article|main|header|footer|form|h[1-6]|blockquote|figure|aside|pre)[ >]')[1]"
    parts = rf"list_transform(string_split_regex({inner}, '<p(?: [^>]*)?>')[2:], lambda p: regexp_replace({_plain(ended)}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g'))"
    joined = f"array_to_string(list_filter({parts}, lambda p: length(p) >= {selectors.LEAST_PARAGRAPH}), ' ')"
    return f"{_spaced(joined)} AS {tag}_p, {_spaced(_plain(inner))} AS {tag}"


def _value(category: str, default: str) -> str:
    kind = {v: k for k, v in CATEGORIES.items()}.get(category)
    number = "" if category == "PCP" else "::DOUBLE"
    return f"coalesce(max(CASE WHEN event_type = '{kind}' THEN value::VARCHAR END){number}, {default}) AS {category.lower()}"


ORACLE_SQL = {
    "page_titles": r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>([^<]*)</title>', 1), '[ \t\r\n]+', ' ', 'g')) AS title FROM pages",
    "page_links": f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '{_LINK}', 1) AS h, regexp_extract_all(html, '{_LINK}', 2) AS t FROM pages)
      SELECT page_id, i - 1 AS place, h[i] AS href, trim(t[i]) AS label FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM l)""",
    "page_articles": f"""WITH c AS (SELECT page_id, regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') AS clean FROM pages),
      a AS (SELECT page_id, {", ".join(_article(t) for t in ("article", "main", "body"))} FROM c),
      b AS (SELECT page_id, CASE {" ".join(f"WHEN length({t}) >= {selectors.LEAST_BODY} THEN substring({t}, 1, {selectors.MOST_BODY})" for t in ("article_p", "article", "main_p", "main", "body_p", "body"))} END AS body FROM a) SELECT * FROM b WHERE body IS NOT NULL""",
    "page_rows": """WITH n AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav><ul>(.*?)</ul></nav>', 1), '<li>(.*?)</li>', 1)) AS li, generate_subscripts(regexp_extract_all(regexp_extract(html, '(?s)<nav><ul>(.*?)</ul></nav>', 1), '<li>(.*?)</li>', 1), 1) - 1 AS place FROM pages)
      SELECT page_id, place, replace(regexp_extract(li, 'href="([^"]*)"', 1), '&amp;', '&') AS href, replace(regexp_extract(li, '>([^<]*)</a>', 1), '&amp;', '&') AS label FROM n""",
    "video_feeds": f"""WITH {POSTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY scraped_at DESC, id) AS rn FROM posts WHERE length(trim(title)) > 0 AND source_key IS NOT NULL)
      SELECT source_key, url, length(trim(title)) AS title_length, 'https://i.test/' || id || '.jpg' AS thumbnail, length(trim(title)) AS snippet_length, source_name AS author, strftime(coalesce(published_at, scraped_at), '%Y-%m-%d %H:%M:%S') AS published_at FROM r WHERE rn <= {FEED}""",
    "rss_feeds": f"""WITH {POSTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY scraped_at DESC, id) AS rn FROM posts WHERE length(trim(title)) > 0 AND source_key IS NOT NULL)
      SELECT source_key, url, length(trim(title)) AS title_length, strftime(CASE WHEN id % 5 = 4 THEN date_trunc('day', scraped_at + INTERVAL 9 HOUR) - INTERVAL 9 HOUR ELSE scraped_at END, '%Y-%m-%d %H:%M:%S') AS published_at FROM r WHERE rn <= {FEED}""",
    "korean_dates": f"""WITH {POSTS_SQL}, k AS (SELECT id, scraped_at AS u, scraped_at + INTERVAL 9 HOUR AS k, TIMESTAMP '{AS_OF}' AS now, TIMESTAMP '{AS_OF}' + INTERVAL 9 HOUR AS here FROM posts)
      SELECT id, strftime(CASE id % 6 WHEN 0 THEN date_trunc('minute', u) WHEN 1 THEN now - to_hours(id % 23) WHEN 2 THEN now - to_days(CAST(id % 6 AS INT)) WHEN 3 THEN date_trunc('minute', u)
        WHEN 4 THEN make_timestamp(year(here), month(k), day(k), 0, 0, 0.0) - INTERVAL 9 HOUR ELSE date_trunc('day', here) + (date_trunc('minute', k) - date_trunc('day', k)) - INTERVAL 9 HOUR END, '%Y-%m-%d %H:%M:%S') AS at FROM k""",
    "source_registry": f"""WITH {POSTS_SQL}, {RUNS_SQL}, l AS (SELECT source_key FROM posts UNION SELECT source_key FROM runs),
      r AS (SELECT source_key, arg_max(error_message IS NULL, (started_at, id)) AS ok FROM runs GROUP BY 1) SELECT source_key FROM l LEFT JOIN r USING (source_key) WHERE coalesce(ok, true)""",
    "feed_sections": f"""WITH {POSTS_SQL}, s AS (SELECT category AS section, row_number() OVER (PARTITION BY category ORDER BY scraped_at DESC, id) - 1 AS place, title, id FROM posts)
      SELECT section, place, id FROM s WHERE place < 30 QUALIFY row_number() OVER (PARTITION BY title ORDER BY section, place) = 1""",
    "forecast_hours": f"""WITH w AS (SELECT 'city' || (user_id % 20) AS city, date_trunc('hour', ts) AS h, {_value("TMP", "0")}, {_value("SKY", "1")}, 0::DOUBLE AS pty, {_value("POP", "0")}, {_value("PCP", "'강수없음'")},
      '적설없음' AS sno, {_value("REH", "0")}, 0::DOUBLE AS wsd FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY city ORDER BY h) <= 48)
      SELECT * EXCLUDE (h), strftime(h, '%Y-%m-%d %H') AS hour FROM w""",
    "visitor_trend": """WITH d AS (SELECT 'r' || (user_id % 20) AS region, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY day DESC) AS back FROM d),
      t AS (SELECT region, avg(n) FILTER (WHERE back <= 3) AS recent, avg(n) FILTER (WHERE back > 3) AS before, max(n) FILTER (WHERE back = 1) AS latest FROM b GROUP BY 1 HAVING count(*) >= 2)
      SELECT region, round(recent, 4) AS recent, round(coalesce(before, 0), 4) AS before, CASE WHEN before > 0 THEN floor((recent - before) / before * 100 + 0.5)::BIGINT ELSE 0 END AS change_pct, latest FROM t ORDER BY abs(change_pct) DESC, region LIMIT 10""",
}
