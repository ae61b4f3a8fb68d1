"""Scores of cards at the edge of their rounding, titles of cards whose posts tie, and views of issues beside their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import compare
from trendloom.operators import similarity as sim
from trendloom.plans import pages

#: 9.89925 together, of which doubles from the largest on make 9.899249999999999.
EDGE = (2.978146, 1.511488, 1.50471, 1.639684, 2.265222)


def scores(spark, clusters):
    rows = [(100 * k + i, str(k), f"s{i % 2}", "news", "a title", x) for k, xs in enumerate(clusters) for i, x in enumerate(xs)]
    cards = sim.issue_cards(spark.createDataFrame(rows, "id long, cluster_id string, source_key string, channel string, title string, trend_score double"))
    return {r.cluster_id: r.x for r in cards.select("cluster_id", F.round("issue_score", 4).cast("double").alias("x")).collect()}


def test_scores_are_rounded_as_decimals(spark):
    assert scores(spark, [EDGE]) == {"0": 9.8993}


def test_equal_scores_are_equal(spark):
    # so they share a rank, whatever they are summed from
    assert len(set(scores(spark, [EDGE, (9.0, 0.89925), EDGE[::-1]]).values())) == 1


@pytest.mark.parametrize("ids", [(1, 1), (None, None), (None, 1)])
@pytest.mark.parametrize("turn", [1, -1])
def test_titles_of_posts_that_tie(spark, ids, turn):
    # what has a key comes first, then the title decides
    rows = [(ids[0], "c", "s0", "news", "a title!", 2.0), (ids[1], "c", "s1", "news", "A title", 2.0)][::turn]
    df = spark.createDataFrame(rows, "id long, cluster_id string, source_key string, channel string, title string, trend_score double").coalesce(1)
    assert [r.title for r in sim.issue_cards(df).collect()] == ["A title"]


def test_views_of_null_texts(spark, tmp_path):
    # every second text is null: some of their posts have titles all the same
    rows = [(i, None if i % 2 else f"Title {i % 9}\nrest", ("en", "fr", "es", "de", None)[i // 40 % 5], f"src{i // 40 % 7}", 0) for i in range(800)]
    # the same keys again, titles written otherwise
    rows += [(i, f"title, {i % 9}", lang, source, n) for i, x, lang, source, n in rows if x is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(spark, duck, pages.issue_views, pages.ORACLE_SQL["issue_views"], str(tmp_path)) == ""
