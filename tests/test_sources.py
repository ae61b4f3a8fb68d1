"""Selectors on nested and malformed pages, host rules, video feeds, feed dates, polled pages."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from trendloom.functions.text import parse_feed_date
from trendloom.sources import feeds
from trendloom.sources import selectors as sel


def texts(html, selector):
    return [" ".join(n.text().split()) for n in sel.select(sel.tree(html), selector)]


PAGE = """<div id=a class="x  y"><p>one<p>two<b>bold</b></p></div><ul><li>1<ul><li>1a</ul><li class=y>2</ul>
<table><tr><td>r1<td>r2<tr><th>h</table><img src=i.png><a href="/q?id=3" data-k>go</a><br>tail</i></section>"""


@pytest.mark.parametrize(("selector", "want"), [
    ("p", ["one", "twobold"]), ("#a p", ["one", "twobold"]), (".x.y > p b", ["bold"]), ("div.x", ["one twobold".replace(" ", "")]), ("ul > li", ["11a", "1a", "2"]), ("ul ul li", ["1a"]), ("li.y", ["2"]),
    ("tr td", ["r1", "r2"]), ("tr > th, li.y", ["2", "h"]), ('a[href*="id="]', ["go"]), ("a[data-k]", ["go"]), ("a[href^='/x']".replace("'", '"'), []), ("*#a", ["onetwobold"]), ("b p", []), ("p > p", []),
])
def test_selectors(selector, want):
    assert texts(PAGE, selector) == want


def test_odd_pages():
    assert texts(None, "p") == texts("", "p") == texts("<<>>&&amp", "p") == []
    deep = "<div>" * 5000 + "x" + "</div>" * 4000
    assert len(list(sel.select(sel.tree(deep), "div"))) == 5000 and sel.tree(deep).text() == "x"
    with pytest.raises(ValueError):
        list(sel.select(sel.tree("<p>"), "p:first"))


LONG = "text of this article, " * 8


@pytest.mark.parametrize(("host", "html", "want"), [
    ("www.yna.co.kr", f"<div class='story-news article'><p>{LONG}</p><aside><p>{LONG}aside</p></aside><p>short</p><p class=adrs>{LONG}ad</p></div>", LONG),
    ("m.yna.co.kr", f"<div class='story-news article'><p>short</p></div><article>{LONG}<figure>pic</figure></article>", LONG),
    ("v.daum.net", f"<div class=article_view>{LONG}<br>{LONG}</div>", LONG + LONG),
    ("news.nate.com", f"<div id=realArtcContents>{LONG}<script>var x</script></div>", LONG),
    ("ytn.co.kr", f"<div class=article_txt>{LONG}</div>", LONG), ("notytn.co.kr", f"<div class=article_txt>{LONG}</div>", None), ("kbs.co.kr", "<div class=detail-body>too short</div>", None),
    ("zum.com", f"<article>{'long words ' * 1000}</article>", ("long words " * 1000)[:4000]), (None, f"<article>{LONG}</article>", None),
])
def test_host_rules(spark, host, html, want):
    df = spark.createDataFrame([(html, host and f"https://{host}/a/1"), (None, "https://zum.com/")], "html string, url string")
    got = [r.b for r in df.coalesce(1).select(sel.article_bodies(F.col("html"), F.col("url"), any_host=None).alias("b")).collect()]
    assert got == [want if want is None else want.strip() if len(want) < 4000 else want, None]


def test_rows_of_a_list_page(spark):
    page = '<table><tr class=row><td class=t><a href="/1"> First  <b>one</b></a><td class=n>12<tr class=row><td class=t>no link<tr class=row></table>'
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>")], "page_id long, html string")
    got = sel.listed(df, "tr.row", {"title": ".t", "url": "a@href", "n": "td.n"}).collect()
    assert [tuple(r) for r in got] == [(1, 0, "First one", "/1", "12"), (1, 1, "no link", None, None)]


def test_video_feeds(spark):
    entry = "<entry><title>{t}</title><link rel='alternate' href=' https://v.test/{n} '/><published>2024-01-0{n}T10:00:00+09:00</published><author><name>Ann</name></author>{g}</entry>"
    group = "<media:group><media:title>no</media:title><media:thumbnail url='a.jpg'/><media:thumbnail url='b.jpg'/><media:description>{d}</media:description></media:group>"
    head = "<feed xmlns='http://www.w3.org/2005/Atom' xmlns:media='http://search.yahoo.com/mrss/' xmlns:yt='y'>"
    body = head + entry.format(t=" A &amp; B ", n=1, g=group.format(d="x" * 600)) + entry.format(t="", n=2, g="") + entry.format(t="late", n=9, g=group.format(d=" ")) + "</feed>"
    one = head + "<entry><id>yt:1</id><title>only</title></entry></feed>"
    df = spark.createDataFrame([("v", body), ("o", one), ("bad", "no feed"), ("n", None), ("e", head + "</feed>")], "source_key string, body string")
    at = F.lit(dt.datetime(2024, 1, 5)).cast("timestamp")
    got = {(r.source_key, r.url): r for r in feeds.video_posts(df, at).collect()}
    a, b, c = (got["v", f"https://v.test/{n}"] for n in (1, 2, 9))
    assert (a.title, a.thumbnail, len(a.content_snippet), a.author, a.published_at) == ("A & B", "a.jpg", 500, "Ann", dt.datetime(2024, 1, 1, 1))
    assert (b.title, b.thumbnail, b.content_snippet) == (feeds.NO_TITLE, None, None) and (c.published_at, c.content_snippet) == (None, None)
    assert got["o", "yt:1"].title == "only" and len(got) == 4


@pytest.mark.parametrize(("text", "want"), [
    ("Sat, 11 04 2026 10:00:00 +0900", dt.datetime(2026, 4, 11, 1)), ("Sat, 11 Apr 2026 10:00:00 GMT", dt.datetime(2026, 4, 11, 10)), ("2026-04-11 05:57:47", dt.datetime(2026, 4, 10, 20, 57, 47)),
    ("2026-04-11T05:57:47", dt.datetime(2026, 4, 10, 20, 57, 47)), ("2024.10.29", dt.datetime(2024, 10, 28, 15)), ("2024년 10월 29일 오후 3:05:09", dt.datetime(2024, 10, 29, 6, 5, 9)), ("2024년 1월 2일 오전 12:00:01", dt.datetime(2024, 1, 1, 15, 0, 1)),
    ("2024년10월29일", dt.datetime(2024, 10, 28, 15)), ("2026-04-11T05:57:47+00:00", dt.datetime(2026, 4, 11, 5, 57, 47)), ("2026-04-11T05:57:47Z", dt.datetime(2026, 4, 11, 5, 57, 47)), ("Sat, 11 13 2026 10:00:00 +0900", None), ("soon", None), ("", None), (None, None),
])
def test_feed_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(parse_feed_date(F.col("t")).alias("d")).first().d == want


def test_polled_pages_come_once(spark, tmp_path):
    """A page comes when it is new and when it has changed; a stream that goes on from its log gives no row twice."""
    spark.dataSource.register(feeds.PageSource)
    names = ["a", "b", "none"]
    urls = " ".join(f"file://{tmp_path}/{n}" for n in names)

    def poll():
        stream = spark.readStream.format("pages").option("urls", urls).load().select("url", F.col("body").cast("string").alias("body"))
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r.url[-1], r.body) for r in spark.read.schema("url string, body string").parquet(f"{tmp_path}/out").collect())

    (tmp_path / "a").write_text("one")
    assert poll() == [("a", "one")]
    assert poll() == [("a", "one")]
    (tmp_path / "b").write_text("two")
    (tmp_path / "a").write_text("one, changed")
    os.utime(tmp_path / "a", (1, 1))
    assert poll() == [("a", "one"), ("a", "one, changed"), ("b", "two")]
    assert poll() == [("a", "one"), ("a", "one, changed"), ("b", "two")]
