"""Signals of single posts: classes by rule, the token gate, masks, older scores and chart scales, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORY_WEIGHT, DEFAULT, DEFAULT_SOURCE_WEIGHT, SOURCE_WEIGHT
from ..functions.maths import age_minutes, decay, freshness_signal, lookup
from ..functions.text import topic_tokens
from ..model import AS_OF, POSTS_SQL, as_of, case_of, comments, posts
from ..operators.scoring import places
from .issues import topic_tokens_sql
from .posts import FLASH

# Patterns of addresses, sources and titles by news subcategory; the first that fits counts.
URL_CLASSES = (
    (r"(?i)/(politics|정치|pol)/", "정치"),
    (r"(?i)/(economy|경제|econo|money|finance)/", "경제"),
    (r"(?i)/(society|사회|soc|national)/", "사회"),
    (r"(?i)/(international|world|global|세계|foreign)/", "세계"),
    (r"(?i)/(entertain|culture|연예|ent|celeb)/", "연예"),
    (r"(?i)/(sports?|스포츠)/", "스포츠"),
    (r"(?i)/(science|tech|it|digital|과학|ICT)/", "IT/과학"),
    (r"(?i)/(life|living|health|생활|라이프|wellness)/", "생활"),
    (r"(?i)/(opinion|editorial|column|사설|칼럼)/", "정치"),
    (r"(?i)/(auto|car|부동산|real.?estate)/", "경제"),
)
SOURCE_CLASSES = {"hankyung": "경제", "mk": "경제", "asiae": "경제", "etnews": "IT/과학"}
TITLE_CLASSES = (
    (r"(?i)주식|코스피|코스닥|환율|금리|증시|부동산|경제|GDP|무역|수출|수입|인플레", "경제"),
    (r"(?i)대통령|국회|여당|야당|선거|정치|탄핵|국무회의|외교부", "정치"),
    (r"(?i)사건|사고|재판|검찰|경찰|화재|지진|태풍|날씨|미세먼지", "사회"),
    (r"(?i)미국|중국|일본|러시아|우크라|트럼프|바이든|NATO|유럽|북한", "세계"),
    (r"(?i)야구|축구|농구|배구|올림픽|KBO|K리그|EPL|NBA|손흥민", "스포츠"),
    (r"(?i)아이돌|드라마|영화|방송|연예|K-pop|콘서트|음악|넷플릭스", "연예"),
    (r"(?i)AI|인공지능|반도체|스마트폰|앱|소프트웨어|5G|로봇|자율주행|사이버", "IT/과학"),
    (r"(?i)건강|다이어트|맛집|여행|패션|뷰티|육아|반려동물", "생활"),
)
# Patterns of lower-cased titles by issue category, and their default.
ISSUE_CLASSES = (
    (r"정치|대통령|국회|선거|여당|야당", "정치"),
    (r"경제|주가|환율|금리|부동산|증시", "경제"),
    (r"연예|배우|가수|아이돌|드라마|영화", "연예"),
    (r"스포츠|축구|야구|올림픽|kbo|epl", "스포츠"),
    (r"사건|사고|화재|범죄|재판|검찰", "사회"),
    (r"it|ai|기술|스타트업|it업계", "IT"),
)
ISSUE_DEFAULT = "종합"
# Patterns of titles by category of a summary made by rule, and their default.
SUMMARY_CLASSES = (
    (r"주식|코스피|코스닥|환율|금리|부동산|경제|투자|증시", "경제"),
    (r"대통령|국회|여당|야당|정치|선거|탄핵|의원", "정치"),
    (r"AI|반도체|로봇|우주|IT|테크|앱|소프트웨어", "IT과학"),
    (r"아이돌|드라마|영화|배우|가수|연예|방송", "연예"),
    (r"축구|야구|농구|올림픽|스포츠|경기|선수", "스포츠"),
    (r"미국|중국|일본|유럽|전쟁|외교|세계", "세계"),
    (r"생활|날씨|건강|교통|맛집|여행|육아|교육|의료", "생활"),
)
SUMMARY_DEFAULT = "사회"
DELETED = "[삭제된 댓글입니다]"


def first_class(text: Column, classes: tuple, default: str | None = None) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.lit(c)) for p, c in classes], F.lit(default))


def classified_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subcategory by address, source, then title; issue and summary category; whether a title is a flash."""
    sections = F.array(*[F.lit(x) for x in ("sports", "econo", "TECH", "opinion")])
    url = F.when(F.col("id") % 7 == 0, F.concat(F.lit("https://ex.test/"), F.element_at(sections, (F.col("id") % 4 + 1).cast("int")), F.lit("/1"))).otherwise(F.col("url"))
    p = posts(spark, sf_dir)
    return p.select(
        "id", F.coalesce(first_class(url, URL_CLASSES), lookup(F.col("source_key"), SOURCE_CLASSES), first_class(F.col("title"), TITLE_CLASSES)).alias("news_class"),
        first_class(F.lower("title"), ISSUE_CLASSES, ISSUE_DEFAULT).alias("issue_class"), first_class(F.col("title"), SUMMARY_CLASSES, SUMMARY_DEFAULT).alias("summary_class"),
        F.col("title").rlike(FLASH).alias("flash"),
    )


def token_gate(pairs: DataFrame, stats: DataFrame, totals: DataFrame, c=DEFAULT) -> DataFrame:
    """(id, passes) of ``pairs`` (id, a, b: word arrays): whether they share a word that tells events apart.

    ``stats`` has token, df24 and df; ``totals`` one row, n24 and n. A word does if it is unknown, or in under
    ``rate`` of the last day's titles, or ``burst`` times as common as in all. A side without words passes, and all
    pass without statistics.
    """
    shared = pairs.where("size(a) > 0 AND size(b) > 0").select("id", F.explode(F.array_intersect("a", "b")).alias("token"))
    known = shared.join(stats, "token", "left").join(F.broadcast(totals), how="left")
    rate24 = F.when(F.col("n24") > 0, F.col("df24") / F.col("n24")).otherwise(0.0)
    tells = F.col("df24").isNull() | F.coalesce(F.col("n"), F.lit(0)).eqNullSafe(0) | (rate24 < c.rate) | F.coalesce(rate24 / F.nullif(F.col("df") / F.col("n"), F.lit(0.0)) >= c.burst, F.lit(False))
    found = known.groupBy("id").agg(F.bool_or(tells).alias("tells"))
    open_ = (F.size("a") == 0) | (F.size("b") == 0)
    return pairs.join(found, "id", "left").select("id", (open_ | F.coalesce("tells", F.lit(False))).alias("passes"))


def gated_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each post beside the next one: whether a cluster may take both, by all titles' words of a day and of all time."""
    p = posts(spark, sf_dir).select("id", "scraped_at", topic_tokens(F.col("title")).alias("ws"))
    recent = F.col("scraped_at") > as_of("2024-01-30 00:00:00")
    stats = p.select(recent.alias("recent"), F.explode("ws").alias("token")).groupBy("token").agg(F.count_if("recent").alias("df24"), F.count("*").alias("df"))
    totals = p.where("size(ws) > 0").agg(F.count_if(recent).alias("n24"), F.count("*").alias("n"))
    pairs = p.select("id", F.col("ws").alias("a")).join(p.select((F.col("id") - 1).alias("id"), F.col("ws").alias("b")), "id")
    return token_gate(pairs, stats, totals)


def masked_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments with deleted bodies masked, and their place among those of a post by votes, then age."""
    c = comments(spark, sf_dir).select("post_id", "id", "body", ((F.col("post_id") * 31 + F.col("id") * 17) % 23 - 5).cast("long").alias("score"), ((F.col("post_id") + F.col("id")) % 9 == 0).alias("deleted"))
    masked = c.select("post_id", "id", F.when(F.col("deleted"), DELETED).otherwise(F.substring("body", 1, 40)).alias("body"), "score")
    return places(masked, ["post_id"], F.desc("score"), F.col("id"))


def older_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older score: ln(1 + V) + 1.5 ln(1 + C), 2 for none, times decay, source and category weight; and the freshness signal."""
    p = posts(spark, sf_dir)
    age = age_minutes(F.coalesce("published_at", "scraped_at"), as_of())
    plain = F.log1p("view_count") + 1.5 * F.log1p("comment_count")
    score = F.when(plain > 0, plain).otherwise(2.0) * decay(age, lookup(F.col("category"), {"community": 150.0, "news": 240.0, "video": 360.0, "portal": 240.0}, 300.0))
    score = score * lookup(F.col("source_key"), SOURCE_WEIGHT, DEFAULT_SOURCE_WEIGHT) * lookup(F.col("category"), CATEGORY_WEIGHT, 1.0)
    return p.select("id", F.round(score, 6).alias("score"), F.round(freshness_signal(age), 6).alias("freshness"))


def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts by day of each category, scaled to 0..1 between the least and the most of the category; 0.5 if all are alike."""
    h = posts(spark, sf_dir).groupBy("category", F.date_trunc("day", "scraped_at").alias("at")).agg(F.sum("view_count").cast("long").alias("views"))
    span = h.groupBy("category").agg(F.min("views").alias("low"), F.max("views").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), (F.col("views") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5)
    return h.join(F.broadcast(span), "category").select("category", F.date_format("at", "yyyy-MM-dd").alias("day"), "views", F.round(scaled, 6).alias("y"))


QUERIES = {f.__name__: f for f in (classified_posts, gated_neighbours, masked_comments, older_scores, chart_points)}


def _classes_sql(text: str, classes: tuple, default: str | None = None) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{c}'" for p, c in classes) + (f" ELSE '{default}'" if default else "") + " END"


ORACLE_SQL = {
    "classified_posts": f"""WITH {POSTS_SQL}, p AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'https://ex.test/' || ['sports', 'econo', 'TECH', 'opinion'][id % 4 + 1] || '/1' ELSE url END AS address FROM posts)
      SELECT id, coalesce({_classes_sql("address", URL_CLASSES)}, {case_of("source_key", {k: f"'{v}'" for k, v in SOURCE_CLASSES.items()}, "NULL")}, {_classes_sql("title", TITLE_CLASSES)}) AS news_class,
        {_classes_sql("lower(title)", ISSUE_CLASSES, ISSUE_DEFAULT)} AS issue_class, {_classes_sql("title", SUMMARY_CLASSES, SUMMARY_DEFAULT)} AS summary_class, regexp_matches(title, '{FLASH}') AS flash FROM p""",
    "gated_neighbours": f"""WITH {POSTS_SQL}, p AS MATERIALIZED (SELECT id, scraped_at > TIMESTAMP '2024-01-30' AS recent, {topic_tokens_sql("title")} AS ws FROM posts),
      n AS (SELECT count(*) FILTER (WHERE recent) AS n24, count(*) AS n FROM p WHERE len(ws) > 0), t AS (SELECT id, recent, unnest(ws) AS token FROM p),
      s AS (SELECT token, count(*) FILTER (WHERE recent) AS df24, count(*) AS df FROM t GROUP BY 1),
      g AS (SELECT token, df24 / n24 < 0.01 OR (df24 / n24) / (df / n) >= 2 AS tells FROM s, n),
      f AS (SELECT a.id, bool_or(tells) AS tells FROM t a JOIN t b ON b.id = a.id + 1 AND a.token = b.token JOIN g ON g.token = a.token GROUP BY 1)
      SELECT a.id, len(a.ws) = 0 OR len(b.ws) = 0 OR coalesce(tells, false) AS passes FROM p a JOIN p b ON b.id = a.id + 1 LEFT JOIN f ON f.id = a.id""",
    "masked_comments": f"""WITH c AS (SELECT conv_id AS post_id, turn::BIGINT AS id, text, ((conv_id * 31 + turn * 17) % 23 - 5)::BIGINT AS score, (conv_id + turn) % 9 = 0 AS deleted FROM conversations)
      SELECT post_id, id, CASE WHEN deleted THEN '{DELETED}' ELSE substring(text, 1, 40) END AS body, score, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, id) AS place FROM c""",
    "older_scores": f"""WITH {POSTS_SQL}, a AS (SELECT *, greatest(0.0, date_diff('microsecond', coalesce(published_at, scraped_at), TIMESTAMP '{AS_OF}') / 6e7) AS age, ln(1 + view_count) + 1.5 * ln(1 + comment_count) AS plain FROM posts)
      SELECT id, round(CASE WHEN plain > 0 THEN plain ELSE 2.0 END * exp(-ln(2) * age / CASE category WHEN 'community' THEN 150 WHEN 'video' THEN 360 ELSE 240 END) * {case_of("source_key", SOURCE_WEIGHT, DEFAULT_SOURCE_WEIGHT)}::DOUBLE
        * {case_of("category", CATEGORY_WEIGHT, 1.0)}::DOUBLE, 6) AS score, round(CASE WHEN age > 0 THEN 10 * exp(-ln(2) * age / 45) ELSE 10 END, 6) AS freshness FROM a""",
    "chart_points": f"""WITH {POSTS_SQL}, h AS (SELECT category, date_trunc('day', scraped_at) AS d, sum(view_count)::BIGINT AS views FROM posts GROUP BY 1, 2), s AS (SELECT category, min(views) AS low, max(views) AS high FROM h GROUP BY 1)
      SELECT category, strftime(d, '%Y-%m-%d') AS day, views, round(CASE WHEN high > low THEN (views - low) / (high - low) ELSE 0.5 END, 6) AS y FROM h JOIN s USING (category)""",
}
