"""Sinks, sources and streaming on fixed rows."""

import gzip
import os

from pyspark.sql import functions as F

from trendloom.model import as_of, posts
from trendloom.operators import sinks
from trendloom.plans.streams import last_events
from trendloom.sources import feeds, selectors


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sanitize(spark):
    df = spark.createDataFrame([(" <b>a\x00</b> ", " http://x ", "//i", None, "x" * 8193), (None, None, None, 3, "{}")], "title string, url string, thumbnail string, view_count int, metadata string")
    assert rows(sinks.sanitize(df)) == sorted([("a", "http://x", "https://i", 0, None), (None, None, None, 3, "{}")], key=repr)


def test_merge_keeps_null_keys_and_takes_null_values(spark):
    schema = "k string, v int, w int"
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), (None, 9, 9)], schema)
    new = spark.createDataFrame([("b", None, 5), ("c", 3, 3), (None, 8, 8)], schema)
    assert rows(sinks.merge(old, new, ["k"], {"w": F.greatest})) == sorted([("a", 1, 1), ("b", None, 5), ("c", 3, 3), (None, 9, 9), (None, 8, 8)], key=repr)
    assert rows(sinks.merge(old, new.limit(0), ["k"])) == rows(old)


def test_trend_upsert(spark):
    schema = "keyword string, keyword_normalized string, source_key string, signal_strength double, scraped_at timestamp_ntz, expires_at timestamp_ntz"
    old = spark.createDataFrame([("A", "a", "s", 0.5, None, None), ("Z", "z", "s", 0.1, None, None)], schema)
    new = spark.createDataFrame([("a!", "a", "s", 7.0, None, None), ("a", "a", "s", 0.2, None, None), ("b", "b", "s", -1.0, None, None)], schema)
    out = {r.keyword_normalized: (r.keyword, r.signal_strength, str(r.expires_at)) for r in sinks.upsert_trends(old, new, as_of()).collect()}
    assert out == {"a": ("a!", 1.0, "2024-01-31 12:00:00"), "b": ("b", 0.0, "2024-01-31 12:00:00"), "z": ("Z", 0.1, "None")}


def test_retention_keeps_null_categories(spark):
    df = spark.sql("SELECT * FROM VALUES ('ott', 6), ('ott', 8), ('news', 2), ('news', 4), (null, 99) AS t(category, d)").withColumn("scraped_at", as_of() - F.make_dt_interval(days=F.col("d")))
    assert rows(sinks.kept_posts(df, as_of(), days=3).select("category", "d")) == sorted([("ott", 6), ("news", 2), (None, 99)], key=repr)


def test_feed_round_trip(spark, sf_dir):
    p = posts(spark, sf_dir)
    body = sinks.feed_document(p, "T & t", "https://ex.test/", most=20).withColumn("source_key", F.lit("s"))
    back = feeds.rss_posts(body, F.expr("TIMESTAMP '2024-02-01'"), most=15)
    want = sinks.with_rank(p, F.desc("scraped_at"), F.desc("id"), most=15)
    assert rows(back.select("url", "category")) == rows(want.select("url", "category"))
    assert rows(back.select("title")) == rows(want.select(F.trim("title")))


def test_items_of_json_and_xml(spark):
    many = '{"response":{"body":{"items":{"item":[{"a":"1","n":2},{"a":"x","n":null}]}}}}'
    one = '{"response":{"body":{"items":{"item":{"a":"3","n":4}}}}}'
    xml = " <response><body><items><item><a>5</a><n>6</n></item></items></body></response>"
    df = spark.createDataFrame([("m", many), ("o", one), ("x", xml), ("bad", "oops"), ("null", None), ("empty", "")], "source_key string, body string")
    assert rows(feeds.items_of(df, "a string, n long")) == sorted([("m", "1", 2), ("m", "x", None), ("o", "3", 4), ("x", "5", 6)], key=repr)


def test_articles(spark):
    long = "w" * 99 + "!"
    pages = [(f"<body><p>{'b' * 120}</p><article><script>'</p>'</script><p>short<p>{long}<!-- x --></article></body>",), (f"<article><p>tiny tiny tiny</p></article><main><p a>{long}</p></main>",), ("<p>none</p>",), (None,), ("",)]
    got = [r.b for r in spark.createDataFrame(pages, "html string").coalesce(1).select(selectors.article_bodies(F.col("html"), F.lit("https://ex.test/1")).alias("b")).collect()]
    assert got == [long, long, None, None, None]


def test_pages_are_fetched_and_errors_kept(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes("가".encode("euc-kr"))
    spark.dataSource.register(feeds.PageSource)
    got = spark.read.format("pages").option("urls", f"file://{tmp_path}/a.xml file://{tmp_path}/none.xml").load()
    texts = got.select("url", feeds.decode(F.col("body"), "euc-kr").alias("text"), feeds.decode(F.col("body")).alias("wrong"), "error").collect()
    out = {r.url.rsplit("/", 1)[-1]: (r.text, r.wrong is not None, r.error is None) for r in texts}
    assert out == {"a.xml": ("가", True, True), "none.xml": (None, False, False)}


def test_base_time(spark):
    at = lambda s: str(spark.range(1).select(feeds.base_time(F.expr(f"TIMESTAMP_NTZ '{s}'")).alias("x")).first().x)
    assert at("2024-01-31 05:09:00") == "2024-01-31 02:00:00"
    assert at("2024-01-31 05:10:00") == "2024-01-31 05:00:00"
    assert at("2024-01-31 02:09:00") == "2024-01-30 23:00:00"


def test_backup(spark, tmp_path):
    sinks.backup(spark.createDataFrame([(1, None, "h")], "id int, t string, title_hash string").coalesce(1), f"{tmp_path}/b", ("title_hash",))
    (name,) = [f for f in os.listdir(tmp_path / "b") if f.endswith(".gz")]
    assert gzip.open(tmp_path / "b" / name, "rt").read().strip() == '{"id":1,"t":null}'


def test_upserts_over_several_batches(spark, tmp_path):
    rows_ = [(i, f"2024-01-01 00:{i:02d}:00", i % 3, "view") for i in range(30)]
    df = spark.createDataFrame(rows_, "event_id long, at string, user_id long, event_type string").select("event_id", F.to_timestamp("at").alias("ts"), "user_id", "event_type")
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = rows(last_events(stream).select("user_id", "n", "last.event_id"))
    assert got == [(0, 10, 27), (1, 10, 28), (2, 10, 29)]
