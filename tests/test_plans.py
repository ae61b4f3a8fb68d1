"""All registered queries with SQL against DuckDB, and the text functions on fixed cases."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, duck_of
from trendloom.config import DEFAULT
from trendloom.functions import maths, text
from trendloom.operators import similarity as sim

SQL = {n: s for n, s in entry.oracle_sql().items() if not n.startswith("op") and n != "pipeline"}
#: Empty at this size.
MAY_BE_EMPTY = {"video_news_signal", "missing_sources", "token_df_burst", "breaking", "cluster_importance", "word_jaccard_pairs", "bigram_jaccard_pairs", "trend_match"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return duck_of(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, sf_dir, name):
    why = compare(spark, duck, entry.queries()[name], SQL[name], sf_dir)
    assert why == "" or (why == "both empty" and name in MAY_BE_EMPTY)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    cases = [
        (text.normalize_title(lit("[속보] Hello,  World! 한글 ")), "hello world 한글"),
        (text.title_tokens(lit("정부는 예산을 발표 the 2024")), ["정부", "예산", "발표", "the"]),
        (text.bigrams(lit("abab")), ["ab", "ba"]),
        (text.bigrams(lit("a")), []),
        (text.strip_html(lit("<p>a &lt;b&gt; &amp;amp;</p>")), "a <b> &amp;"),
        (text.xml_escape(lit("a<b & 'c'")), "a&lt;b &amp; &apos;c&apos;"),
        (text.video_id(lit("https://youtu.be/abcdefghijk?t=1")), "abcdefghijk"),
        (text.video_id(lit("https://x.test/")), None),
        (text.traffic(lit("1.5M+")), 1_500_000.0),
        (text.traffic(lit("2,000+")), 2000.0),
        (text.rank_key(lit("Song (Live)"), lit("A B")), "song||ab"),
        (text.host_matches(lit("https://www.news.ex.test/a"), "ex.test"), True),
        (text.host_matches(lit("https://notex.test/a"), "ex.test"), False),
        (text.json_answer(lit('```json\n[{"a":1}]\n```')), '{"a":1}'),
        (text.fingerprint(F.array(lit(3), lit(1), lit(3))), value(spark, F.md5(lit(b"1,3")))),
        (maths.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")), 1.0),
        (maths.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(0.0), lit(0.0))), 0.0),
        (maths.lookup(lit("zz"), {"a": 1.0}, 0.5), 0.5),
        (maths.floor_percentile(F.array(lit(5), lit(1), lit(3)), 0.5), 3),
    ]
    for column, want in cases:
        assert value(spark, column) == want


def test_dates(spark):
    at = F.expr("TIMESTAMP '2024-01-31 00:00:00'")
    show = lambda c: value(spark, F.date_format(c, "yyyy-MM-dd HH:mm"))
    assert show(text.parse_korean_date(F.lit("5분 전"), at)) == "2024-01-30 23:55"
    assert show(text.parse_korean_date(F.lit("2024.01.30 10:00"), at)) == "2024-01-30 01:00"
    assert show(text.parse_korean_date(F.lit("08:30"), at)) == "2024-01-30 23:30"
    assert show(text.parse_feed_date(F.lit("Tue, 30 Jan 2024 10:00:00 GMT"))) == "2024-01-30 10:00"
    assert show(text.parse_feed_date(F.lit("2024-01-30 10:00:00"))) == "2024-01-30 01:00"
    assert value(spark, text.parse_korean_date(F.lit("soon"), at)) is None


def test_config():
    assert DEFAULT.overlay('{"burst": 3, "source_weight": {"x": 2}}').source_weight["x"] == 2
    for bad in ({"nope": 1}, {"burst": -1}, {"burst": "a"}, {"news_signals": [1]}):
        with pytest.raises(ValueError, match="."):
            DEFAULT.overlay(bad)


def test_anchor_clusters(spark):
    """Near posts join the best anchor in time; later anchors win ties; no vector stays alone."""
    rows = [(1, 0, [1.0, 0.0]), (2, 1, [0.99, 0.1]), (3, 2, [0.0, 1.0]), (4, 3, None), (5, 60 * 13, [1.0, 0.0]), (6, 60 * 13 + 1, [0.1, 0.99])]
    df = spark.createDataFrame(rows, "id long, m int, v array<double>").selectExpr("id", "TIMESTAMP '2024-01-01' + make_interval(0,0,0,0,0,m) AS scraped_at", "'t' AS title", "v")
    got = {r.id: r.cluster_id for r in sim.anchor_clusters(df).collect()}
    assert got == {1: "v8-cluster-1", 2: "v8-cluster-1", 3: "v8-cluster-3", 4: "v8-cluster-4", 5: "v8-cluster-5", 6: "v8-cluster-6"}
    room = {r.id: r.cluster_id for r in sim.anchor_clusters(df, hours=24, most=2).collect()}
    assert (room[5], room[6]) == ("v8-cluster-5", "v8-cluster-3")


def test_groups_and_rank_changes(spark):
    ids = spark.range(1, 41)
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(35, 33), (35, 34)], "a long, b long")
    got = {r.id: r.group for r in sim.groups(ids, links).collect()}
    assert {got[i] for i in range(1, 31)} == {1} and got[34] == got[35] == 33 and got[40] == 40
    schema = "stable_id string, rank int, members array<int>"
    now = spark.createDataFrame([("a", 1, [1]), ("b", 2, [4, 5, 6]), ("c", 3, [9])], schema)
    old = spark.createDataFrame([("a", 3, [7]), ("x", 4, [4, 5]), ("y", 1, [4])], schema)
    assert {r.stable_id: r.rank_change for r in sim.rank_changes(now, old).collect()} == {"a": 2, "b": 2, "c": None}


@pytest.mark.parametrize("held", [4, 1 << 20])
def test_groups_of_chains_and_odd_links(spark, monkeypatch, held):
    """Long chains with shuffled names, tasks that hold few ends, links to themselves, twice, both ways and to nothing."""
    rng = random.Random(5)
    names = rng.sample(range(10_000), 1200)
    chains = [names[:700], names[700:1100], names[1100:1110]]
    pairs = [(x, y) if rng.random() < 0.5 else (y, x) for c in chains for x, y in zip(c, c[1:], strict=False)]
    rng.shuffle(pairs)
    links = spark.createDataFrame([*pairs, *pairs[:50], (names[1150], names[1150]), (names[1151], None), (None, names[3])], "a long, b long").repartition(6)
    rounds, table = [], sim.work_table
    monkeypatch.setattr(sim, "work_table", lambda df, name: (rounds.append(name), table(df, name))[1])
    got = {r.id: r.group for r in sim.groups(spark.createDataFrame([(x,) for x in names], "id long"), links, held).collect()}
    assert got == {x: min(c) for c in [*chains, *([x] for x in names[1110:])] for x in c}
    assert rounds.count("steps") <= 9
    nothing = spark.createDataFrame([], "a long, b long")
    assert sim.groups(nothing.select(F.col("a").alias("id")), nothing).count() == 0
    assert {(r.id, r.group) for r in sim.groups(spark.range(2), nothing).collect()} == {(0, 0), (1, 1)}
