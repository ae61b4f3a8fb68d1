"""Sources: feeds, XML and JSON answers and pages that were fetched, as relations.

``fetched`` tables have one row an answer (``body``); parsing is Spark's own. ``PageSource`` fetches,
one task an address, for sessions with a network.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.text import not_future, parse_feed_date, traffic

RSS = "channel struct<item:array<struct<title:string,link:string,guid:string,pubDate:string,category:string,description:string>>>"
TRENDS = "channel struct<item:array<struct<title:string,approx_traffic:string,picture:string>>>"


class _Address(InputPartition):
    def __init__(self, url: str):
        self.url = url


class PageSource(DataSource):
    """``spark.read.format("pages").option("urls", "a b").load()``: url, body (null if it failed), error.

    ``spark.readStream`` polls the addresses: a page comes when it is first there and when it has changed.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, body binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options.get("urls", "").split(), float(self.options.get("timeout", 30)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PagePoll(self.options.get("urls", "").split(), float(self.options.get("timeout", 30)))


class _PageReader(DataSourceReader):
    def __init__(self, urls: list[str], timeout: float):
        self.urls, self.timeout = urls, timeout

    def partitions(self) -> list[InputPartition]:
        return [_Address(u) for u in self.urls]

    def read(self, partition):
        if partition is not None:
            yield _fetched(partition.url, self.timeout)


def _fetched(url: str, timeout: float) -> tuple:
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return url, answer.read(), None
    except (OSError, ValueError) as e:  # one source that fails must not stop the others
        return url, None, str(e)[:500]


class _PagePoll(DataSourceStreamReader):
    """An offset is each address's state: the mark of the page that was there last. Spark logs it, so a stream
    that is started anew knows which pages have come; only those whose mark differs are fetched, one task each."""

    def __init__(self, urls: list[str], timeout: float):
        self.urls, self.timeout = urls, timeout

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {url: mark for url in self.urls if (mark := self._mark(url)) is not None}

    def _mark(self, url: str) -> str | None:
        """What tells a page's versions apart: its tag or date if the answer's head has one, else a hash of it; null if it fails."""
        import hashlib
        import urllib.request

        try:
            with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=self.timeout) as answer:
                head = answer.headers.get("ETag") or answer.headers.get("Last-modified")
                size = answer.headers.get("Content-length")
            if head:
                return f"{head} {size}"
            with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                return hashlib.sha256(answer.read()).hexdigest()
        except (OSError, ValueError):
            return None

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Address(url) for url, mark in end.items() if start.get(url) != mark]

    def read(self, partition):
        yield _fetched(partition.url, self.timeout)


def decode(body: Column, charset: str = "utf-8") -> Column:
    """Bytes as text; what isn't valid in the charset becomes a replacement mark. Only other charsets than UTF-8 leave the JVM."""
    if charset.lower() in ("utf-8", "utf8"):
        return F.make_valid_utf8(body.cast("string"))

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode(charset, "replace"))

    return decoded(body)


def registry(sources: DataFrame, overrides: DataFrame, priority: str | None = None) -> DataFrame:
    """Enabled sources; an override (source_key, enabled) wins over the list."""
    out = sources.join(overrides.select("source_key", F.col("enabled").alias("_set")), "source_key", "left")
    out = out.withColumn("enabled", F.coalesce("_set", "enabled")).drop("_set").where("enabled")
    return out if priority is None else out.where(F.col("priority") == priority)


def rss_posts(fetched: DataFrame, as_of: Column, most: int = 30) -> DataFrame:
    """(source_key, body) -> the first ``most`` items of each feed with an address; dates in the future are null."""
    items = fetched.select("source_key", F.posexplode(F.from_xml("body", RSS).channel.item).alias("at", "i")).where(F.col("at") < most)
    at = parse_feed_date(F.col("i.pubDate"))
    out = items.select("source_key", F.trim("i.title").alias("title"), F.trim(F.coalesce("i.link", "i.guid")).alias("url"), not_future(at, as_of).alias("published_at"), F.col("i.category").alias("category"), F.col("i.description").alias("content_snippet"))
    return out.where("url != ''")


#: Atom entries with their media group, by local names.
VIDEOS = "entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>,id:string,published:string,updated:string,author:struct<name:string>,group:struct<thumbnail:array<struct<_url:string>>,description:string>>>"
SNIPPET, NO_TITLE = 500, "(제목 없음)"


def video_posts(fetched: DataFrame, as_of: Column, most: int = 30) -> DataFrame:
    """(source_key, body) -> the first ``most`` entries of each Atom feed of videos: thumbnail and description are nested
    in the entry's media group. One parse makes typed rows; a body that is no feed has none."""
    feed = F.from_xml("body", VIDEOS, {"ignoreNamespace": "true"})
    items = fetched.select("source_key", F.posexplode(feed.entry).alias("at", "i")).where(F.col("at") < most)
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    links = F.col("i.link")
    own = F.coalesce(F.get(F.filter(links, lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate")), F.lit(0)), F.get(links, F.lit(0)))
    out = items.select(
        "source_key", F.coalesce(text(F.col("i.title")), F.lit(NO_TITLE)).alias("title"), F.trim(F.coalesce(own["_href"], F.col("i.id"))).alias("url"),
        F.get(F.col("i.group.thumbnail"), F.lit(0))["_url"].alias("thumbnail"), text(F.substring(F.col("i.group.description"), 1, SNIPPET)).alias("content_snippet"),
        text(F.col("i.author.name")).alias("author"), not_future(parse_feed_date(F.coalesce("i.published", "i.updated")), as_of).alias("published_at"),
    )
    return out.where("url != ''")


def sections(items: DataFrame, most: int, n: int) -> DataFrame:
    """(section, place, url, ...) of ``n`` sections: each gives max(5, most / n) items; of a url the first section's stays."""
    quota = max(5, most // n)
    return items.where(F.col("place") < quota).withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy("section", "place"))).where("_r = 1").drop("_r")


def items_of(fetched: DataFrame, item: str, path: str = "response.body.items.item") -> DataFrame:
    """(source_key, body) -> a row an item: JSON, or XML where the body starts with ``<``.

    ``item`` is the items' DDL. One item in place of a list is a list of one; what can't be parsed has none.
    """
    steps = path.split(".")
    xml_ddl, kind = f"{steps[-1]} array<struct<{item}>>", steps[1:-1]
    for step in reversed(kind):
        xml_ddl = f"{step} struct<{xml_ddl}>"
    body = F.trim("body")
    markup = body.startswith("<")
    xml = F.from_xml(F.when(markup, body), xml_ddl)
    for step in steps[1:]:
        xml = xml.getField(step)
    found = F.get_json_object(F.when(~markup, body), "$." + path)
    many = F.from_json(F.when(found.startswith("["), found), f"array<struct<{item}>>")
    one = F.array(F.from_json(F.when(found.startswith("{"), found), f"struct<{item}>"))
    rows = F.coalesce(xml, many, F.when(found.startswith("{"), one))
    return fetched.select("source_key", F.explode(rows).alias("i")).select("source_key", "i.*")


def trend_items(fetched: DataFrame) -> DataFrame:
    """Search trends: rank is an item's place, strength its traffic over 100,000, at most 1."""
    items = fetched.select("source_key", F.posexplode(F.from_xml("body", TRENDS, {"ignoreNamespace": "true"}).channel.item).alias("at", "i"))
    strength = F.least(F.coalesce(traffic(F.col("i.approx_traffic")), F.lit(0.0)) / 100_000, F.lit(1.0))
    return items.select("source_key", F.trim("i.title").alias("keyword"), strength.alias("signal_strength"), (F.col("at") + 1).cast("long").alias("rank_position")).where("keyword != ''")


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?s)<title>([^<]*)</title>", 1), r"[ \t\r\n]+", " "))


def links(pages: DataFrame) -> DataFrame:
    """A row a link of each page: its place, address and text."""
    pattern = r'<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), 1).alias("href"), F.regexp_extract_all("html", F.lit(pattern), 2).alias("label"))
    return pages.select("page_id", F.posexplode(both).alias("place", "l")).select("page_id", F.col("place").cast("long").alias("place"), "l.href", F.trim("l.label").alias("label"))


def forecast(items: DataFrame) -> DataFrame:
    """Long weather rows (city, hour, category, value) -> a row an hour, the first 48 of each city, defaults for what is missing."""
    value = lambda c: F.max(F.when(F.col("category") == c, F.col("value")))
    number = lambda c, d: F.coalesce(value(c).cast("double"), F.lit(d)).alias(c.lower())
    wide = items.groupBy("city", "hour").agg(number("TMP", 0.0), number("SKY", 1.0), number("PTY", 0.0), number("POP", 0.0), F.coalesce(value("PCP"), F.lit("강수없음")).alias("pcp"), F.coalesce(value("SNO"), F.lit("적설없음")).alias("sno"), number("REH", 0.0), number("WSD", 0.0))
    return wide.withColumn("_n", F.row_number().over(Window.partitionBy("city").orderBy("hour"))).where("_n <= 48").drop("_n")


def daily_extremes(items: DataFrame) -> DataFrame:
    """Least and greatest temperature of each city and day."""
    value = lambda c, f: f(F.when(F.col("category") == c, F.col("value").cast("double")))
    return items.groupBy("city", F.to_date("hour").alias("day")).agg(value("TMN", F.min).alias("min"), value("TMX", F.max).alias("max"))


def base_time(as_of: Column, hours: tuple = (2, 5, 8, 11, 14, 17, 20, 23)) -> Column:
    """The last forecast that is out: ten minutes after one of ``hours``, else yesterday's last."""
    at = as_of - F.make_dt_interval(mins=F.lit(10))
    day = F.date_trunc("day", at)
    last = F.array_max(F.filter(F.array(*[F.lit(h) for h in hours]), lambda h: h <= F.hour(at)))
    return F.when(last.isNotNull(), day + F.make_dt_interval(hours=last)).otherwise(day - F.make_dt_interval(hours=F.lit(24 - max(hours))))


def visitor_trend(items: DataFrame, most: int = 10) -> DataFrame:
    """(region, day, n): the regions whose last three days changed most against the days before."""
    days = items.groupBy("region", "day").agg(F.sum("n").alias("n"))
    days = days.withColumn("back", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("day"))))
    out = days.groupBy("region").agg(
        F.count("*").alias("days"), F.avg(F.when(F.col("back") <= 3, F.col("n"))).alias("recent"), F.avg(F.when(F.col("back") > 3, F.col("n"))).alias("before"), F.max(F.when(F.col("back") == 1, F.col("n"))).alias("latest")
    ).where("days >= 2")
    change = F.when(F.col("before") > 0, F.floor((F.col("recent") - F.col("before")) / F.col("before") * 100 + 0.5)).otherwise(0)
    return out.select("region", F.round("recent", 4).alias("recent"), F.round(F.coalesce("before", F.lit(0.0)), 4).alias("before"), change.cast("long").alias("change_pct"), "latest").orderBy(F.desc(F.abs("change_pct")), "region").limit(most)


# Page names that are no topics.
NO_TOPICS = ("위키백과:", "특수:", "분류:", "틀:", "포털:", "사용자:", "모듈:")
ALWAYS = "대한민국"


def page_views(fetched: DataFrame, most: int = 30) -> DataFrame:
    """(source_key, body: JSON of the day's most read pages) -> keywords: the first ``most`` that are topics, strength by views, 1 at 100,000."""
    pages = F.from_json("body", "items array<struct<articles:array<struct<article:string,views:long,rank:long>>>>")
    articles = F.get(pages["items"], F.lit(0))["articles"]
    topic = lambda a: ~F.coalesce(a["article"].rlike("^(" + "|".join(NO_TOPICS) + ")"), F.lit(True)) & (a["article"] != ALWAYS)
    items = fetched.select("source_key", F.explode(F.slice(F.filter(articles, topic), 1, most)).alias("a"))
    return items.select("source_key", F.replace("a.article", F.lit("_"), F.lit(" ")).alias("keyword"), F.least(F.col("a.views") / 100_000, F.lit(1.0)).alias("signal_strength"), F.col("a.rank").alias("rank_position"), F.col("a.views").alias("views"))


CITY = "CITYDATA struct<LIVE_PPLTN_STTS:struct<LIVE_PPLTN_STTS:struct<AREA_CONGEST_LVL:string,AREA_CONGEST_MSG:string,AREA_PPLTN_MIN:string,AREA_PPLTN_MAX:string,PPLTN_TIME:string>>>"


def people(n: Column) -> Column:
    """12345 -> 1.2만, 20000 -> 2만, 9876 -> 9,876."""
    tens = F.call_function("format_number", F.floor(n / 1000 + 0.5) / 10, F.lit("0.0"))
    return F.when(n >= 10_000, F.concat(F.regexp_replace(tens, r"\.0$", ""), F.lit("만"))).otherwise(F.call_function("format_number", n, F.lit("#,##0")))


def city_records(fetched: DataFrame) -> DataFrame:
    """(area, body: XML) -> how crowded an area is: level, message, least and most people, when; areas without a record are left out."""
    r = F.from_xml("body", CITY)["CITYDATA"]["LIVE_PPLTN_STTS"]["LIVE_PPLTN_STTS"]
    number = lambda c: F.coalesce(r[c].try_cast("long"), F.lit(0).cast("long"))
    out = fetched.where(r.isNotNull()).select("area", F.coalesce(r["AREA_CONGEST_LVL"], F.lit("측정중")).alias("level"), F.coalesce(r["AREA_CONGEST_MSG"], F.lit("")).alias("message"), number("AREA_PPLTN_MIN").alias("least"), number("AREA_PPLTN_MAX").alias("most"), F.coalesce(r["PPLTN_TIME"], F.lit("")).alias("measured_at"))
    return out.withColumn("title", F.concat("area", F.lit(": "), "level", F.lit(" (인구 약 "), people(F.col("least")), F.lit("~"), people(F.col("most")), F.lit("명)")))
