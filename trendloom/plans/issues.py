"""Issues: similarity, clusters, cards, signals and merges of charts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import COMMENT_LIKE_WEIGHT, DEFAULT, SOURCE_TIER
from ..functions import text
from ..functions.maths import change_rate, clamp, lookup, ratio_or_zero, step_decay
from ..functions.text import bigrams, fingerprint, hangul_tokens, normalize_title, title_hash, title_tokens, topic_tokens
from ..model import AS_OF, POSTS_SQL, as_of, case_of, posts, read
from ..operators import similarity as sim
from ..operators.scoring import authority, channel, ranked, score_posts, top_per, topic_importance
from ..operators.work import spread, work_table
from .posts import AUTHORITY_SQL, FINAL_SQL, NORMAL_SQL, SCORED_SQL, H

#: Vectors of the test tables are far apart.
NEAR = 0.3


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def title_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = posts(spark, sf_dir).where(normalize_title(F.col("title")) != "")
    return df.select("id", title_hash(F.col("title")).alias("cluster_id"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near posts of ``cluster_hours``."""
    return sim.cosine_pairs(timed_vectors(spark, sf_dir), NEAR, hours=DEFAULT.cluster_hours).select("a", "b", F.round("cosine", 6).alias("cosine"))


def timed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v, at) of posts with vectors."""
    return vectors(spark, sf_dir).join(posts(spark, sf_dir).select("id", F.col("scraped_at").alias("at")), "id")


def echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir).withColumn("channel", channel(F.col("category")))
    p = p.select("id", "channel", authority(F.col("source_key"), F.col("channel")).alias("authority"))
    return sim.echo(p, timed_vectors(spark, sf_dir), NEAR, hours=DEFAULT.cluster_hours).select("id", F.round("echo", 6).alias("echo"))


def _distinct_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different normalised title of a category once, with its least id."""
    df = posts(spark, sf_dir).select("id", "category", normalize_title(F.col("title")).alias("norm")).where("length(norm) >= 8")
    return df.groupBy("category", "norm").agg(F.min("id").alias("id"))


def bigram_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = work_table(_distinct_titles(spark, sf_dir), "titles")
    return sim.bigram_pairs(titles, 0.8, "category").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def word_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = work_table(spread(_distinct_titles(spark, sf_dir), "id").select("id", "category", title_tokens(F.col("norm")).alias("members")).where("size(members) >= 2"), "words")
    return sim.jaccard_pairs(sets, 0.65, "category").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def near_in_time(p: DataFrame, key: str, hours: int) -> DataFrame:
    """Links (a, b) that connect what posts (id, at, ``key``) of one key not more than ``hours`` apart do.

    Times are dealt into spans of ``hours``: all posts of a key and span are near its first one, and of two
    neighbouring spans the last and the first post are the nearest. So nothing is sorted or paired.
    """
    span = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / (hours * 3_600_000_000)).alias("span")
    rows = p.where(F.col(key).isNotNull()).select("id", F.unix_micros(F.col("at").cast("timestamp")).alias("t"), F.col(key).alias("k"), span)
    ends = rows.groupBy("k", "span").agg(F.min(F.struct("t", "id")).alias("first"), F.max(F.struct("t", "id")).alias("last"))
    same = rows.join(ends.where("first < last"), ["k", "span"]).where("id <> first.id").select(F.col("first.id").alias("a"), F.col("id").alias("b"))
    following = ends.select("k", (F.col("span") - 1).alias("span"), F.col("first").alias("next"))
    return same.unionByName(ends.join(following, ["k", "span"]).where(F.col("next.t") - F.col("last.t") <= hours * 3_600_000_000).select(F.col("last.id").alias("a"), F.col("next.id").alias("b")))


def alike_in_time(p: DataFrame, hours: int, c=DEFAULT, fresh: str | None = None) -> DataFrame:
    """Links (a, b) between near titles of one category, not more than ``hours`` apart, of posts (id, at, category, norm).

    With ``fresh``, a boolean column, only those that a fresh post's title has a part in.
    """
    span = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / (hours * 3_600_000_000)).alias("span")
    rows = p.where(F.length("norm") >= c.title_length).select("id", F.unix_micros(F.col("at").cast("timestamp")).alias("t"), "category", "norm", span, *([fresh] if fresh else []))
    # each title of a category and span once; spans meet the ones after them
    ends = rows.groupBy("category", "norm", "span").agg(F.min(F.struct("t", "id")).alias("first"), F.max(F.struct("t", "id")).alias("last"), *([F.bool_or(fresh).alias(fresh)] if fresh else []))
    ends = work_table(ends.withColumn("id", F.xxhash64("category", "norm", "span")), "titles")
    met = ends.select("id", "norm", "span", *([fresh] if fresh else []), F.col("first.t").alias("first"), F.col("last.t").alias("last"), F.explode(F.array(F.col("span"), F.col("span") + 1)).alias("s"), "category")
    # two titles of one span meet in their own span only
    met = met.withColumn("within", F.concat_ws(" ", "category", "s")).withColumn("home", F.col("s") == F.col("span"))
    grams = work_table(sim.bigram_pairs(met, c.bigram_jaccard, "within", fresh=fresh, home="home", most=hours * 3_600_000_000), "near-grams")
    worded = work_table(spread(met, "id").select("id", "within", *([fresh] if fresh else []), title_tokens(F.col("norm")).alias("members")).where("size(members) >= 2"), "met")
    words = work_table(sim.jaccard_pairs(worded, c.word_jaccard, "within", fresh), "near-words")
    pairs = grams.select("a", "b").unionByName(words.select("a", "b")).distinct()
    of = lambda side: ends.select(F.col("id").alias(side), F.col("span").alias(f"span_{side}"), F.col("first").alias(f"first_{side}"), F.col("last").alias(f"last_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    gap = F.when(F.col("span_a") < F.col("span_b"), F.col("first_b.t") - F.col("last_a.t")).when(F.col("span_a") > F.col("span_b"), F.col("first_a.t") - F.col("last_b.t")).otherwise(0)
    end = lambda x, y: F.when(F.col(f"span_{x}") < F.col(f"span_{y}"), F.col(f"last_{x}.id")).otherwise(F.col(f"first_{x}.id"))
    return both.where(gap <= hours * 3_600_000_000).select(end("a", "b").alias("a"), end("b", "a").alias("b"))


def cluster_duplicates(p: DataFrame, hours: int = int(DEFAULT.dedup_hours)) -> DataFrame:
    """(id, group) of posts (id, at, category, norm, thumbnail): linked within ``hours`` by title, thumbnail or a near
    title of one category. No two empty titles or thumbnails are linked; a post is in one group."""
    keyed = p.withColumn("norm", F.nullif("norm", F.lit(""))).withColumn("thumbnail", F.nullif("thumbnail", F.lit("")))
    keyed = work_table(keyed.select("id", "at", "category", "norm", "thumbnail"), "dedup")
    links = near_in_time(keyed, "norm", hours).unionByName(near_in_time(keyed, "thumbnail", hours)).unionByName(alike_in_time(keyed, hours))
    return sim.groups(keyed.select("id"), links)


def _with_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    thumbnail = F.when(F.col("id") % 10 < 2, F.concat(F.lit("https://img.test/"), F.floor(F.col("id") / 10).cast("string")))
    return posts(spark, sf_dir).select("id", "category", "view_count", "scraped_at", normalize_title(F.col("title")).alias("norm"), thumbnail.alias("thumbnail"))


def dedup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of duplicates with their canonical post, that of most views, then the latest."""
    p = _with_thumbnails(spark, sf_dir)
    grouped = cluster_duplicates(p.withColumn("at", F.col("scraped_at"))).join(p.select("id", "view_count", "scraped_at"), "id")
    return grouped.groupBy(F.col("group").alias("cluster_id")).agg(F.count("*").alias("member_count"), F.max_by("id", F.struct("view_count", "scraped_at", -F.col("id"))).alias("canonical_id")).where("member_count > 1")


def near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, issue) of posts with vectors: connected by near ones. Equal vectors are compared once."""
    v = vectors(spark, sf_dir)
    same = work_table(v.join(posts(spark, sf_dir).select("id").distinct(), "id", "left_semi").groupBy("v").agg(F.min("id").alias("head"), F.collect_set("id").alias("ids")), "vectors")
    heads = same.select(F.col("head").alias("id"), "v")
    linked = sim.groups(heads.select("id"), sim.cosine_links(heads, NEAR))
    return same.select("head", F.explode("ids").alias("id")).join(linked.select(F.col("id").alias("head"), "group"), "head").groupBy("id").agg(F.min("group").alias("issue"))


def label_topics(titled: DataFrame, most: int | None = None) -> DataFrame:
    """Titles of each issue of ``titled`` (id, issue, title, view_count) grouped at word Jaccard 0.4.

    Per issue: its different titles, labels, the largest one's share, pairs of titles across labels.
    Only ``most`` posts of an issue count, those of most views, if it is given. Posts without title don't.
    """
    df = titled.where("title <> ''")
    if most is not None:
        df = top_per(df, "issue", most, F.desc("view_count"), F.col("id"))
    df = df.select("issue", normalize_title(F.col("title")).alias("norm")).distinct()
    words = F.array_sort(topic_tokens(F.col("norm")))
    # titles of the same words have one label
    sets = df.groupBy("issue", words.alias("members")).agg(F.count("*").alias("n")).withColumn("id", F.xxhash64("issue", "members"))
    sets = work_table(sets, "topics")
    pairs = work_table(sim.jaccard_pairs(sets, 0.4, "issue"), "topic-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    labels = sets.join(sim.groups(ids, pairs), "id", "left").groupBy("issue", F.coalesce("group", "id").alias("label")).agg(F.sum("n").alias("n"))
    cross = (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2
    return labels.groupBy("issue").agg(F.sum("n").alias("titles"), F.count("*").alias("labels"), F.round(F.max("n") / F.sum("n"), 6).alias("largest"), cross.cast("long").alias("cross_pairs"))


def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each issue, for all posts: issues are groups of near vectors, a post without one is alone."""
    p = posts(spark, sf_dir).select("id", "title", "view_count").join(near_groups(spark, sf_dir), "id", "left")
    return label_topics(p.withColumn("issue", F.coalesce("issue", "id")))


def anchor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir).select("id", "scraped_at", "title").join(vectors(spark, sf_dir), "id", "left")
    return sim.anchor_clusters(p, NEAR, hours=24.0 * 14)


def v8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five factors, with clusters by title and echo by vectors."""
    p, members = posts(spark, sf_dir), title_members(spark, sf_dir)
    scored = score_posts(p, as_of(), topics(p, members), echo(spark, sf_dir))
    return scored.select("id", "channel", F.round("topic_importance", 6).alias("topic_importance"), F.round("echo", 6).alias("echo"), F.round("trend_score", 6).alias("trend_score"))


def topics(p: DataFrame, members: DataFrame) -> DataFrame:
    m = members.join(p.select("id", "source_key", "category"), "id")
    stats = m.groupBy("cluster_id").agg(F.count("*").alias("n"), F.countDistinct("source_key").alias("s"), F.countDistinct("category").alias("c"))
    return members.join(stats, "cluster_id").select("id", topic_importance(F.col("n"), F.col("s"), F.col("c")).alias("topic_importance"))


def issue_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    scored = score_posts(p, as_of()).withColumn("trend_score", F.round("trend_score", 6))
    titled = scored.where(normalize_title(F.col("title")) != "").withColumn("cluster_id", title_hash(F.col("title")))
    cards = sim.issue_cards(titled)
    return cards.select("cluster_id", "posts", "n_sources", "n_channels", "news_posts", "community_posts", "video_posts", "first_id", "title", F.round("issue_score", 4).cast("double").alias("issue_score"))


def issue_cards_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline: greedy clusters of the newest posts, topic factor, echo, cards."""
    p = posts(spark, sf_dir)
    members = work_table(anchor_clusters(spark, sf_dir), "anchors")
    scored = score_posts(p, as_of(), topics(p, members), echo(spark, sf_dir)).withColumn("trend_score", F.round("trend_score", 6))
    return sim.issue_cards(scored.join(members, "id")).withColumn("issue_score", F.round("issue_score", 4).cast("double"))


def issue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cards as pages of 20, each a JSON array, in order of rank."""
    cards = ranked(issue_cards(spark, sf_dir), F.desc("issue_score"), F.asc("cluster_id"))
    page = (F.floor((F.col("rank") - 1) / 20) + 1).cast("long")
    item = F.struct("rank", "first_id", "posts")
    pages = cards.groupBy(page.alias("page")).agg(F.count("*").alias("items"), F.sort_array(F.collect_list(item)).alias("list"))
    return pages.select("page", "items", F.to_json("list").alias("body"))


def normalized_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-sums of the counters' logs by source, else by channel, shifted to a mean of 2, in [0.5, 20]."""
    p = posts(spark, sf_dir).withColumn("ch", F.when(F.col("category") == "portal", "news").otherwise(F.col("category")))
    baseline = p.groupBy("category").agg(F.percentile(F.log1p("view_count"), F.lit(0.5)).alias("baseline"))

    def stats(key: str, prefix: str) -> DataFrame:
        aggs = [F.count("*").alias(f"{prefix}_n")]
        for c in ("view", "comment", "like"):
            x = F.log1p(f"{c}_count")
            aggs += [F.avg(x).alias(f"{prefix}_m_{c}"), F.greatest(F.stddev_samp(x), F.lit(0.1)).alias(f"{prefix}_s_{c}")]
        return p.where("view_count > 0").groupBy(key).agg(*aggs)

    df = p.join(baseline, "category").join(stats("source_key", "src"), "source_key", "left").join(stats("ch", "cha"), "ch", "left")
    own = F.coalesce(F.col("src_n") >= F.when(F.col("ch") == "news", 5).otherwise(10), F.lit(False))
    pick = lambda name: F.when(own, F.col(f"src_{name}")).otherwise(F.col(f"cha_{name}"))
    z = {c: ratio_or_zero(F.log1p(f"{c}_count") - pick(f"m_{c}"), pick(f"s_{c}")) for c in ("view", "comment", "like")}
    wc, wl = (lookup(F.col("ch"), {k: v[i] for k, v in COMMENT_LIKE_WEIGHT.items()}) for i in (0, 1))
    likes = F.col("src_n").isNull() | (F.col("src_m_like") >= 0.1) | (F.col("src_s_like") > 0.1)
    scale = F.when(likes, 1.0).otherwise((1 + wc + wl) / (1 + wc))
    summed = clamp(2 + z["view"] * scale + z["comment"] * wc * scale + F.when(likes, z["like"] * wl).otherwise(0.0), 0.5, 20.0)
    plain = F.greatest(F.lit(0.5), F.log1p("view_count") + F.log1p("comment_count") * wc + F.log1p("like_count") * wl)
    known = F.coalesce(pick("n") >= F.when(own, 5).otherwise(10), F.lit(False)) & F.coalesce(pick("n") >= 10, F.lit(False))
    zero = (F.col("view_count") == 0) & (F.col("comment_count") == 0) & (F.col("like_count") == 0)
    value = F.when(zero, F.col("baseline") * F.when(F.col("ch") == "news", 1.2).otherwise(1.0)).when(known, summed).otherwise(plain)
    return df.select("id", F.round(value, 6).alias("engagement"))


def cluster_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By news outlets and variety of tiers: min(10, 3 log2 n) (1 + .1 min(tiers - 1, 3)), 10 at most."""
    m = title_members(spark, sf_dir).join(posts(spark, sf_dir).select("id", "source_key", "category"), "id")
    tier = lookup(F.col("source_key"), SOURCE_TIER, 5)
    stats = m.groupBy("cluster_id").agg(F.countDistinct(F.when(F.col("category").isin("news", "newsletter", "portal"), F.col("source_key"))).alias("n"), F.countDistinct(tier).alias("tiers"))
    value = F.least(F.lit(10.0), F.least(F.lit(10.0), 3 * F.log2("n")) * (1 + 0.1 * F.least(F.col("tiers") - 1, F.lit(3))))
    return stats.where("n > 1").select("cluster_id", "n", F.round(value, 6).alias("importance"))


def cluster_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine distance of vectors to their label's centroid, and log2(1 + n)(1 + min(2 d, 3)), 10 at most."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    flat = v.select("vec_id", "label", F.posexplode("v").alias("i", "x"))
    center = flat.groupBy("label", "i").agg(F.avg("x").alias("c"))
    sums = flat.join(center, ["label", "i"]).groupBy("label", "vec_id").agg(F.sum(F.col("x") * F.col("c")).alias("xc"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    cosine = F.col("xc") / (F.sqrt("xx") * F.sqrt("cc"))
    d = sums.groupBy("label").agg(F.count("*").alias("n"), F.avg(1 - cosine).alias("d"))
    return d.select("label", "n", F.round("d", 6).alias("distance"), F.round(F.least(F.lit(10.0), F.log2(1 + F.col("n")) * (1 + F.least(2 * F.col("d"), F.lit(3.0)))), 6).alias("importance"))


def video_news_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos' engagement, z-scored to [0, 10] and halved, reaches news posts of the same title;
    large groups damp it. Videos without such posts reach news that shares two Hangul words, at 0.6."""
    p = posts(spark, sf_dir).select("id", "category", "title", "view_count", F.log(1 + F.col("view_count") + 3 * F.col("comment_count") + 2 * F.col("like_count")).alias("e"))
    videos, news = p.where("category = 'video' AND view_count > 0"), p.where("category IN ('news', 'portal', 'newsletter')")
    stats = videos.agg(F.avg("e").alias("m"), F.greatest(F.stddev_pop("e"), F.lit(0.1)).alias("s"))
    scored = videos.join(F.broadcast(stats)).select("id", "title", clamp(((F.col("e") - F.col("m")) / F.col("s") + 2) * 2.5, 0.0, 10.0).alias("score"))
    members = title_members(spark, sf_dir)
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    # each cluster's best video, then its news posts: never all pairs
    in_cluster = scored.join(members, "id")
    best = in_cluster.groupBy("cluster_id").agg(F.max("score").alias("best")).join(sizes, "cluster_id")
    news_members = news.select("id").join(members, "id")
    held = news_members.select("cluster_id").distinct()
    reach = news_members.join(best, "cluster_id").select("id", (F.col("best") * F.least(F.lit(1.0), 20 / F.col("size"))).alias("score"))
    rest = scored.join(in_cluster.join(held, "cluster_id").select("id"), "id", "left_anti")
    # titles meet on pairs of their words, whose best video is found first: a hot word makes no pairs of posts
    pairs = F.explode(F.flatten(F.transform("ws", lambda x, i: F.transform(F.slice(F.col("ws"), i + 2, F.size("ws")), lambda y: F.concat_ws(" ", x, y)))))
    worded = lambda df, *cols: df.select(*cols, F.array_sort(hangul_tokens(F.col("title"))).alias("ws")).where("size(ws) >= 2").select(*cols, pairs.alias("pair"))
    best_of_pair = worded(rest, "score").groupBy("pair").agg(F.max("score").alias("score"))
    near = worded(news, "id").join(best_of_pair, "pair").groupBy("id").agg(F.max("score").alias("score"))
    both = reach.unionByName(near.select("id", (0.6 * F.col("score")).alias("score"))).where("score > 0")
    return both.groupBy("id").agg(F.round(0.5 * F.max("score"), 6).alias("signal"))


def trend_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 strongest keywords: commonest title words by source."""
    w = F.explode(F.array_distinct(F.filter(F.split(normalize_title(F.col("title")), " "), lambda x: F.length(x) >= 6)))
    df = posts(spark, sf_dir).select("source_key", "scraped_at", w.alias("keyword")).groupBy("source_key", "keyword").agg(F.count("*").alias("n"), F.max("scraped_at").alias("at"))
    df = df.where("n >= 2").orderBy(F.desc("n"), "source_key", "keyword").limit(500)
    return df.select("source_key", "keyword", F.least(F.col("n") / 10, F.lit(1.0)).alias("strength"), "at")


def match_trends(p: DataFrame, keywords: DataFrame, at: Column, c=DEFAULT) -> DataFrame:
    """(id, sources, best, decay) of posts (id, norm) that trending keywords match.

    ``keywords`` (source_key, keyword, strength, at) are few (500, as the index has) and broadcast. A title
    matches one that it contains, with or without its spaces, of two Hangul or three other characters, or
    of which it has 70 % of the pairs of characters, if there are four characters. Each source counts once,
    by its strongest match, of equals the least keyword, and decays by that one's age.
    """
    # each different title and keyword once
    heads = work_table(p.groupBy("norm").agg(F.min("id").alias("head")), "heads")
    # step by step, as what is used within arrays would be computed for each of their elements
    grams = spread(heads, "head").select("head", "norm", F.replace("norm", F.lit(" ")).alias("bare")).select("head", "norm", bigrams(F.col("norm")).alias("grams"), bigrams(F.col("bare")).alias("bare_grams"))
    titled = work_table(grams.select("*", *sim.sketch(F.col("grams"), "t"), *sim.sketch(F.col("bare_grams"), "u")), "titles")
    words = keywords.withColumn("bare", F.replace("keyword", F.lit(" "))).where(F.length("keyword") >= F.when(F.col("keyword").rlike("^[가-힯㄰-㆏]"), 2).otherwise(3))
    words = work_table(words.select("source_key", "keyword", "bare", "strength", "at"), "keywords")
    terms = words.select("keyword", "bare").distinct().withColumn("grams", bigrams(F.col("keyword"))).withColumn("bare_grams", bigrams(F.col("bare")))
    # of a keyword in the title all pairs of characters are there, of one that is mostly there all but 30 %
    spare = F.when(F.length("keyword") >= 4, F.size("grams") - F.ceil(0.7 * F.size("grams") - 1e-9)).otherwise(0).cast("int")
    terms = work_table(terms.select("*", spare.alias("spare"), F.lit(0).alias("none"), *sim.sketch(F.col("grams"), "k"), *sim.sketch(F.col("bare_grams"), "b")), "terms")

    def candidates(grams: str, spare: str, of_word: str, of_title: str) -> DataFrame:
        """(head, keyword) of titles that have one of the keyword's ``spare`` + 1 rarest pairs, and maybe the rest."""
        wanted = terms.select("keyword", F.explode(grams).alias("gram"))
        flat = titled.select("head", *[f"{of_title}{i}" for i in range(sim.SKETCH)], F.explode(grams).alias("gram"))
        often = flat.join(F.broadcast(wanted.select("gram").distinct()), "gram").groupBy("gram").agg(F.count("*").alias("often"))
        known = wanted.join(often, "gram", "left").groupBy("keyword").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))).alias("rarest"))
        few = terms.select("keyword", spare, *[f"{of_word}{i}" for i in range(sim.SKETCH)]).join(known, "keyword")
        few = few.withColumn("rare", F.explode(F.slice("rarest", F.lit(1), F.col(spare) + 1))).withColumn("gram", F.col("rare.gram")).drop("rare", "rarest")
        return flat.join(F.broadcast(few), "gram").where(sim.missing(of_word, of_title) <= F.col(spare)).select("head", "keyword")

    near = candidates("grams", "spare", "k", "t").unionByName(candidates("bare_grams", "none", "b", "u")).distinct()
    both = near.join(titled.select("head", "norm", "grams"), "head").join(F.broadcast(terms.select("keyword", "bare", F.col("grams").alias("k_grams"))), "keyword")
    mostly = (F.length("keyword") >= 4) & (F.size(F.array_intersect("grams", "k_grams")) >= 0.7 * F.size("k_grams"))
    hit = F.contains(F.col("norm"), F.col("keyword")) | F.contains(F.replace("norm", F.lit(" ")), F.col("bare")) | mostly
    found = both.where(hit).select("head", "keyword").join(F.broadcast(words.drop("bare")), "keyword")
    one = found.groupBy("head", "source_key").agg(F.min_by(F.struct("strength", "at"), F.struct(-F.col("strength"), "keyword")).alias("m"))
    hours = F.timestamp_diff("MICROSECOND", F.col("m.at"), at) / 3.6e9
    each = one.groupBy("head").agg(F.count("*").alias("sources"), F.max("m.strength").alias("best"), F.avg(step_decay(hours)).alias("decay"))
    return p.join(heads.join(each, "head"), "norm").select("id", "sources", "best", "decay")


def trend_bonus(sources: Column, best: Column, decay: Column, c=DEFAULT) -> Column:
    base = F.array(*[F.lit(x) for x in c.trend_base])
    return clamp(F.element_at(base, (F.least(sources, F.lit(len(c.trend_base) - 1)) + 1).cast("int")) * (0.6 + 0.4 * best) * decay, 1.0, c.trend_cap)


def trend_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts' bonus for trending words."""
    p = posts(spark, sf_dir).select("id", normalize_title(F.col("title")).alias("norm"))
    found = match_trends(p, trend_keywords(spark, sf_dir), as_of())
    return found.select("id", "sources", F.round(trend_bonus(F.col("sources"), F.col("best"), F.col("decay")), 6).alias("bonus"))


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked charts: each supplier's 200 best parts by revenue."""
    l = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).cast("decimal(18,2)")).alias("revenue"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("revenue"), "l_partkey")
    return l.withColumn("rank", F.row_number().over(w)).where("rank <= 200").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("item"), "rank")


CHARTS_SQL = """rev AS (SELECT l_suppkey AS source, l_partkey AS item, sum(round(l_extendedprice * (1 - l_discount), 2)::DECIMAL(18,2)) AS revenue FROM lineitem GROUP BY 1, 2),
  charts AS (SELECT source, item, row_number() OVER (PARTITION BY source ORDER BY revenue DESC, item) AS rank FROM rev QUALIFY rank <= 200)"""


def _chart_weight(source: Column) -> Column:
    return F.when(source % 5 == 0, 1.2).when(source % 5 <= 2, 1.0).otherwise(0.8)


def borda_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = (201 - F.col("rank")) * _chart_weight(F.col("source"))
    merged = charts(spark, sf_dir).groupBy("item").agg(F.round(F.sum(points), 6).alias("points"), F.count("*").alias("charts"), F.min("rank").cast("long").alias("best_rank"))
    return merged.orderBy(F.desc("points"), "item").limit(50)


def avg_rank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = charts(spark, sf_dir).groupBy("item").agg(F.round(F.avg("rank") + F.when(F.count("*") == 1, 5).otherwise(0), 6).alias("rank_score"), F.count("*").alias("charts"))
    return merged.orderBy("rank_score", "item").limit(50)


def chart_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chart as it is: its five best items."""
    return charts(spark, sf_dir).where("rank <= 5").select("source", "item", F.col("rank").cast("long").alias("rank"))


def rank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' ranks by month's orders against the month before, by the same identity."""
    o = read(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month"), F.col("o_custkey").alias("cust")).agg(F.sum(F.round("o_totalprice", 2).cast("decimal(18,2)")).alias("total"))
    # one numbering of all months; a month's ranks begin after the months before it
    everyone = work_table(ranked(o, F.asc("month"), F.desc("total"), F.asc("cust")), "ranks")
    first = everyone.groupBy("month").agg((F.min("rank") - 1).alias("before"))
    monthly = everyone.join(F.broadcast(first), "month").withColumn("rank", F.col("rank") - F.col("before")).drop("before")
    before = monthly.select("cust", F.add_months("month", 1).alias("next"), F.col("rank").alias("was"))
    out = monthly.alias("a").join(before.alias("b"), (F.col("a.cust") == F.col("b.cust")) & (F.to_date("a.month") == F.col("b.next")), "left")
    return out.select(F.col("a.cust").alias("cust"), F.date_format("month", "yyyy-MM").alias("month"), "rank", (F.col("was") - F.col("rank")).alias("rank_change"))


def priority_of(score: Column, hours: Column, summary: Column, before: Column, now: Column, half_life: float = 6.0, stale: float = 3.0, novelty: float = 0.3, factor: float = 1.2) -> Column:
    """score 0.5^(hours / half_life), times ``stale`` without a summary of its own, times ``factor`` if ``novelty`` of
    the top posts changed since the last tick; an issue that is new has no change."""
    change = F.when(F.coalesce(F.size(before), F.lit(0)) > 0, change_rate(before, now)).otherwise(0.0)
    own = F.when(summary.isNull() | (summary == "") | summary.startswith("[fallback]"), stale).otherwise(1.0)
    return score * F.pow(F.lit(0.5), F.greatest(hours, F.lit(0.0)) / half_life) * own * F.when(change >= novelty, factor).otherwise(1.0)


def summary_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of titles as issues: top posts are the five least ids, before those of the last day and with them."""
    p = posts(spark, sf_dir).where(normalize_title(F.col("title")) != "").withColumn("cluster_id", title_hash(F.col("title")))
    g = p.groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("scraped_at").alias("at"), F.sum("view_count").cast("long").alias("views"), F.min("id").alias("first"))
    top = lambda df, name: top_per(df, "cluster_id", 5, F.col("id")).groupBy("cluster_id").agg(F.collect_list("id").alias(name))
    g = g.where("n > 1").join(top(p, "now"), "cluster_id").join(top(p.where(F.col("scraped_at") <= as_of("2024-01-30 00:00:00")), "before"), "cluster_id", "left")
    summary = F.when(F.col("first") % 3 == 0, "[fallback] x").when(F.col("first") % 3 == 1, "a summary")
    hours = F.timestamp_diff("MICROSECOND", F.col("at"), as_of()) / 3.6e9
    return g.select("cluster_id", F.round(priority_of(F.col("views"), hours, summary, F.col("before"), F.col("now")), 6).alias("priority"))


def summary_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of cached summaries: md5 of the five least ids of each group of titles."""
    p = posts(spark, sf_dir).where(normalize_title(F.col("title")) != "")
    # five least ids a group, pre-aggregated by rank within it
    w = Window.partitionBy("h").orderBy("id")
    least = p.select("id", title_hash(F.col("title")).alias("h")).withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    return least.groupBy("h").agg(fingerprint(F.collect_list("id")).alias("fingerprint"))


QUERIES = {f.__name__: f for f in (
    cosine_pairs, echo, bigram_jaccard_pairs, word_jaccard_pairs, dedup_clusters, topic_labels, anchor_clusters, v8_scores, issue_cards, issue_cards_by_vector, issue_pages,
    normalized_engagement, cluster_importance, cluster_spread, video_news_signal, trend_match, borda_merge, avg_rank_merge, chart_top5, rank_change, summary_priority, summary_fingerprints,
)}
_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, epoch_us(scraped_at) AS t FROM embeddings JOIN posts ON id = vec_id)"
_PAIRS = f"""{_V}, pairs AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.id < b.id AND abs(a.t - b.t) <= {DEFAULT.cluster_hours} * 3600000000
  WHERE list_cosine_similarity(a.v, b.v) >= {NEAR})"""
_STOP = lambda items: "[" + ", ".join(f"'{w}'" for w in items) + "]"


def title_tokens_sql(norm: str) -> str:
    cut = f"regexp_replace(w, '{text.suffix_pattern(text.TITLE_PARTICLES, 1)}', '\\1')"
    stems = f"list_transform(string_split({norm}, ' '), lambda w: CASE WHEN length({cut}) <= 1 THEN w ELSE {cut} END)"
    return f"list_distinct(list_filter({stems}, lambda w: length(w) >= 2 AND NOT list_contains({_STOP(text.TITLE_STOPWORDS)}, w) AND NOT regexp_matches(w, '^[0-9]+$')))"


def topic_tokens_sql(title: str) -> str:
    plain = f"lower(regexp_replace(regexp_replace({title}, '\\[[^\\]]*\\]', '', 'g'), '[^가-힣ㄱ-ㅎㅏ-ㅣa-zA-Z0-9 \\t\\n\\r]', ' ', 'g'))"
    stems = f"list_transform(string_split_regex({plain}, '[ \\t\\n\\r]+'), lambda w: regexp_replace(w, '{text.suffix_pattern(text.TOPIC_PARTICLES, 2)}', '\\1'))"
    return f"list_distinct(list_filter({stems}, lambda w: length(w) >= 2 AND NOT list_contains({_STOP(text.TOPIC_STOPWORDS)}, w)))"


def hangul_tokens_sql(title: str) -> str:
    plain = f"regexp_replace(regexp_replace({title}, '\\[[^\\]]*\\]', '', 'g'), '[^가-힣 \\t\\n\\r]', ' ', 'g')"
    return f"list_distinct(list_filter(string_split_regex({plain}, '[ \\t\\n\\r]+'), lambda w: length(w) >= 2 AND NOT list_contains({_STOP(text.BROADCAST_STOPWORDS)}, w)))"


_TITLES = f"titles AS (SELECT category, {NORMAL_SQL} AS norm, min(id) AS id FROM posts WHERE length({NORMAL_SQL}) >= 8 GROUP BY 1, 2)"
_ECHO = f"""{_PAIRS}, both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
  auth AS (SELECT id, category AS ch, {AUTHORITY_SQL} AS au FROM posts),
  near AS (SELECT x.id, count(*) AS n, avg(y.au) AS au FROM both_ways JOIN auth x ON x.id = a JOIN auth y ON y.id = b WHERE x.ch <> y.ch GROUP BY 1),
  echo AS (SELECT auth.id, round(CASE WHEN n IS NULL THEN 1.0 ELSE 1 + least(0.25 * sqrt(n) * near.au, 1.0) END, 6) AS echo FROM auth LEFT JOIN near ON near.id = auth.id)"""
_TOPICS = f"""g AS (SELECT {H} AS h, count(*) AS n, count(DISTINCT source_key) AS s, count(DISTINCT category) AS c FROM posts WHERE {NORMAL_SQL} <> '' GROUP BY 1),
  topics AS (SELECT id AS tid, CASE WHEN n IS NULL OR n <= 1 THEN 1.0 ELSE greatest(1.0, 1 + 0.3 * log2(1 + n) + 0.25 * log2(1 + s) + 0.25 * (c - 1)) END AS ti FROM posts LEFT JOIN g ON {H} = h AND {NORMAL_SQL} <> '')"""
_CARDS = f"""m AS (SELECT *, {H} AS cluster_id, row_number() OVER (PARTITION BY {H} ORDER BY trend_score DESC, id) AS rn,
    CASE category WHEN 'news' THEN 0 WHEN 'portal' THEN 1 WHEN 'video' THEN 2 ELSE 3 END AS pr FROM scored WHERE {NORMAL_SQL} <> ''),
  cards AS (SELECT cluster_id, count(*) AS posts, count(DISTINCT source_key) AS n_sources, count(DISTINCT category) AS n_channels, count(*) FILTER (WHERE category IN ('news', 'portal')) AS news_posts,
    count(*) FILTER (WHERE category = 'community') AS community_posts, count(*) FILTER (WHERE category = 'video') AS video_posts, min(id) AS first_id, first(title ORDER BY pr, trend_score DESC, id, title) AS title,
    round(sum(trend_score::DECIMAL(14,6)) FILTER (WHERE rn <= 10)::DECIMAL(24,6) * (1 + 0.25 * (count(DISTINCT category) - 1))::DECIMAL(8,4), 4)::DOUBLE AS issue_score FROM m GROUP BY 1 HAVING count(DISTINCT source_key) >= 2 AND count(*) FILTER (WHERE category IN ('news', 'portal')) >= 1)"""


def _engagement_stats(key: str, prefix: str) -> str:
    cols = ", ".join(f"avg(ln(1 + {c}_count)) AS {prefix}_m_{c}, greatest(stddev_samp(ln(1 + {c}_count)), 0.1) AS {prefix}_s_{c}" for c in ("view", "comment", "like"))
    return f"{prefix} AS (SELECT {key} AS {prefix}_k, count(*) AS {prefix}_n, {cols} FROM p WHERE view_count > 0 GROUP BY 1)"


_Z = " + ".join(f"CASE WHEN s_{c} > 0.01 THEN (ln(1 + {c}_count) - m_{c}) / s_{c} ELSE 0 END * {w}" for c, w in (("view", "sc"), ("comment", "wc * sc"), ("like", "CASE WHEN has_likes THEN wl ELSE 0 END")))
ORACLE_SQL = {
    "cosine_pairs": f"WITH {POSTS_SQL}, {_PAIRS} SELECT a, b, round(c, 6) AS cosine FROM pairs",
    "echo": f"WITH {POSTS_SQL}, {_ECHO} SELECT id, echo FROM echo",
    "bigram_jaccard_pairs": f"""WITH {POSTS_SQL}, {_TITLES}, s AS (SELECT id, category, list_distinct(list_transform(range(1, length(norm)), lambda i: substring(norm, i, 2))) AS g FROM titles),
      j AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS k, len(a.g) + len(b.g) AS n FROM s a JOIN s b ON a.category = b.category AND a.id < b.id AND len(a.g) >= 0.79 * len(b.g) AND len(b.g) >= 0.79 * len(a.g))
      SELECT a, b, round(k / (n - k), 6) AS jaccard FROM j WHERE k / (n - k) >= 0.8 - 1e-9""",
    "word_jaccard_pairs": f"""WITH {POSTS_SQL}, {_TITLES}, s AS (SELECT id, category, {title_tokens_sql('norm')} AS g FROM titles),
      j AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS k, len(a.g) + len(b.g) AS n FROM s a JOIN s b ON a.category = b.category AND a.id < b.id AND len(a.g) >= 2 AND len(b.g) >= 2)
      SELECT a, b, round(k / (n - k), 6) AS jaccard FROM j WHERE k / (n - k) >= 0.65 - 1e-9""",
    "v8_scores": f"""WITH {POSTS_SQL}, {SCORED_SQL}, {_ECHO}, {_TOPICS},
      f AS (SELECT factors.*, ti, echo, authority * freshness * engagement * ti * echo AS raw FROM factors JOIN topics ON tid = factors.id JOIN echo ON echo.id = factors.id),
      r AS (SELECT category AS k2, avg(ln(1 + raw)) AS m2, stddev_pop(ln(1 + raw)) AS sd2 FROM f GROUP BY 1)
      SELECT f.id, category AS channel, round(ti, 6) AS topic_importance, echo, round(greatest(0, 2.5 + (ln(1 + raw) - m2) / CASE WHEN sd2 > 0 THEN sd2 ELSE 1 END), 6) AS trend_score FROM f JOIN r ON category = k2""",
    "issue_cards": f"WITH {POSTS_SQL}, {SCORED_SQL}, {FINAL_SQL}, {_CARDS} SELECT * FROM cards",
    "issue_pages": f"""WITH {POSTS_SQL}, {SCORED_SQL}, {FINAL_SQL}, {_CARDS}, r AS (SELECT *, row_number() OVER (ORDER BY issue_score DESC, cluster_id) AS rank FROM cards)
      SELECT (rank - 1) // 20 + 1 AS page, count(*) AS items, '[' || string_agg('{{"rank":' || rank || ',"first_id":' || first_id || ',"posts":' || posts || '}}', ',' ORDER BY rank) || ']' AS body FROM r GROUP BY 1""",
    "normalized_engagement": f"""WITH {POSTS_SQL}, p AS (SELECT *, CASE WHEN category = 'portal' THEN 'news' ELSE category END AS ch FROM posts),
      base AS (SELECT category AS bk, percentile_cont(0.5) WITHIN GROUP (ORDER BY ln(1 + view_count)) AS baseline FROM posts GROUP BY 1), {_engagement_stats("source_key", "src")}, {_engagement_stats("ch", "cha")},
      j AS (SELECT *, coalesce(src_n >= CASE WHEN ch = 'news' THEN 5 ELSE 10 END, false) AS own, CASE ch WHEN 'community' THEN 1.5 WHEN 'news' THEN 0.5 ELSE 1.0 END AS wc, CASE ch WHEN 'community' THEN 2.0 WHEN 'news' THEN 0.3 ELSE 1.2 END AS wl,
        src_n IS NULL OR src_m_like >= 0.1 OR src_s_like > 0.1 AS has_likes FROM p JOIN base ON category = bk LEFT JOIN src ON source_key = src_k LEFT JOIN cha ON ch = cha_k),
      k AS (SELECT *, CASE WHEN own THEN src_n ELSE cha_n END AS n, {", ".join(f"CASE WHEN own THEN src_{x}_{c} ELSE cha_{x}_{c} END AS {x}_{c}" for x in "ms" for c in ("view", "comment", "like"))}, CASE WHEN has_likes THEN 1.0 ELSE (1 + wc + wl) / (1 + wc) END AS sc FROM j)
      SELECT id, round(CASE WHEN view_count = 0 AND comment_count = 0 AND like_count = 0 THEN baseline * CASE WHEN ch = 'news' THEN 1.2 ELSE 1.0 END
        WHEN n >= 10 THEN least(20.0, greatest(0.5, 2 + {_Z})) ELSE greatest(0.5, ln(1 + view_count) + ln(1 + comment_count) * wc + ln(1 + like_count) * wl) END, 6) AS engagement FROM k""",
    "cluster_importance": f"""WITH {POSTS_SQL}, g AS (SELECT {H} AS cluster_id, count(DISTINCT CASE WHEN category IN ('news', 'portal') THEN source_key END) AS n, count(DISTINCT {case_of("source_key", SOURCE_TIER, 5)}) AS t FROM posts WHERE {NORMAL_SQL} <> '' GROUP BY 1)
      SELECT cluster_id, n, round(least(10.0, least(10.0, 3 * log2(n)) * (1 + 0.1 * least(t - 1, 3))), 6) AS importance FROM g WHERE n > 1""",
    "cluster_spread": """WITH f AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM f GROUP BY 1, 2),
      s AS (SELECT label, vec_id, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS cosine FROM f JOIN c USING (label, i) GROUP BY 1, 2), d AS (SELECT label, count(*) AS n, avg(1 - cosine) AS d FROM s GROUP BY 1)
      SELECT label, n, round(d, 6) AS distance, round(least(10.0, log2(1 + n) * (1 + least(2 * d, 3.0))), 6) AS importance FROM d""",
    "video_news_signal": f"""WITH {POSTS_SQL}, p AS (SELECT id, category, view_count, {NORMAL_SQL} AS norm, {hangul_tokens_sql("title")} AS ws, ln(1 + view_count + 3 * comment_count + 2 * like_count) AS e FROM posts),
      v0 AS (SELECT * FROM p WHERE category = 'video' AND view_count > 0), st AS (SELECT avg(e) AS m, greatest(stddev_pop(e), 0.1) AS s FROM v0),
      v AS (SELECT id, norm, ws, least(10.0, greatest(0.0, ((e - m) / s + 2) * 2.5)) AS score FROM v0, st), n AS (SELECT * FROM p WHERE category IN ('news', 'portal')),
      sz AS (SELECT norm, count(*) AS size FROM p WHERE norm <> '' GROUP BY 1),
      a AS (SELECT v.id AS vid, n.id, score * least(1.0, 20 / size) AS score FROM v JOIN n ON v.norm = n.norm AND v.norm <> '' JOIN sz ON sz.norm = v.norm),
      b AS (SELECT n.id, 0.6 * score AS score FROM v JOIN n ON len(list_intersect(v.ws, n.ws)) >= 2 WHERE v.id NOT IN (SELECT vid FROM a))
      SELECT id, round(0.5 * max(score), 6) AS signal FROM (SELECT id, score FROM a UNION ALL SELECT id, score FROM b) WHERE score > 0 GROUP BY 1""",
    "trend_match": f"""WITH {POSTS_SQL}, w AS (SELECT DISTINCT id, source_key, scraped_at, unnest(string_split({NORMAL_SQL}, ' ')) AS keyword FROM posts),
      k AS (SELECT source_key, keyword, least(count(*) / 10, 1.0) AS strength, max(scraped_at) AS ts, list_distinct(list_transform(range(1, length(keyword)), lambda i: substring(keyword, i, 2))) AS kg
        FROM w WHERE length(keyword) >= 6 GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY count(*) DESC, source_key, keyword LIMIT 500),
      t AS (SELECT id, {NORMAL_SQL} AS norm FROM posts), g AS (SELECT *, list_distinct(list_transform(range(1, greatest(1, length(norm))), lambda i: substring(norm, i, 2))) AS tg FROM t),
      m AS (SELECT g.id, k.source_key, first(strength ORDER BY strength DESC, keyword) AS strength, first(ts ORDER BY strength DESC, keyword) AS ts FROM g JOIN k
        ON contains(norm, keyword) OR contains(replace(norm, ' ', ''), keyword) OR len(list_intersect(tg, kg)) >= 0.7 * len(kg) GROUP BY 1, 2),
      d AS (SELECT *, date_diff('microsecond', ts, TIMESTAMP '{AS_OF}') / 3.6e9 AS h FROM m),
      f AS (SELECT id, count(*) AS sources, max(strength) AS best, avg(CASE WHEN h <= 1 THEN 1.0 WHEN h <= 3 THEN 0.85 WHEN h <= 6 THEN 0.6 WHEN h <= 12 THEN 0.3 ELSE 0 END) AS decay FROM d GROUP BY 1)
      SELECT id, sources, round(least(1.8, greatest(1.0, CASE WHEN sources >= 3 THEN 1.6 WHEN sources = 2 THEN 1.35 ELSE 1.15 END * (0.6 + 0.4 * best) * decay)), 6) AS bonus FROM f""",
    "dedup_clusters": f"""WITH RECURSIVE {POSTS_SQL}, p AS MATERIALIZED (SELECT id, category, view_count, scraped_at AS ts, norm, img, list_distinct(list_transform(range(1, greatest(1, length(norm))), lambda i: substring(norm, i, 2))) AS g, {title_tokens_sql("norm")} AS w
        FROM (SELECT *, {NORMAL_SQL} AS norm, CASE WHEN id % 10 < 2 THEN id // 10 END AS img FROM posts)),
      j AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND abs(date_diff('microsecond', a.ts, b.ts)) <= 6 * 3600000000 AND (a.norm = b.norm AND a.norm <> '' OR a.img = b.img
        OR a.category = b.category AND length(a.norm) >= 8 AND length(b.norm) >= 8 AND (len(list_intersect(a.g, b.g)) >= 0.8 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) - 1e-9
          OR len(a.w) >= 2 AND len(b.w) >= 2 AND len(list_intersect(a.w, b.w)) >= 0.65 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9))),
      e AS MATERIALIZED (SELECT a, b FROM j UNION ALL SELECT b, a FROM j), r AS (SELECT id, id AS reached FROM p UNION SELECT r.id, e.b FROM r JOIN e ON r.reached = e.a),
      c AS (SELECT id, min(reached) AS cluster_id FROM r GROUP BY 1)
      SELECT cluster_id, count(*) AS member_count, first(id ORDER BY view_count DESC, ts DESC, id) AS canonical_id FROM c JOIN p USING (id) GROUP BY 1 HAVING count(*) > 1""",
    "borda_merge": f"WITH {CHARTS_SQL} SELECT item, round(sum((201 - rank) * CASE WHEN source % 5 = 0 THEN 1.2::DOUBLE WHEN source % 5 <= 2 THEN 1.0 ELSE 0.8 END), 6) AS points, count(*) AS charts, min(rank) AS best_rank FROM charts GROUP BY 1 ORDER BY points DESC, item LIMIT 50",
    "avg_rank_merge": f"WITH {CHARTS_SQL} SELECT item, round(avg(rank) + CASE WHEN count(*) = 1 THEN 5 ELSE 0 END, 6) AS rank_score, count(*) AS charts FROM charts GROUP BY 1 ORDER BY rank_score, item LIMIT 50",
    "chart_top5": f"WITH {CHARTS_SQL} SELECT source, item, rank FROM charts WHERE rank <= 5",
    "rank_change": """WITH o AS (SELECT date_trunc('month', o_orderdate) AS month, o_custkey AS cust, sum(round(o_totalprice, 2)::DECIMAL(18,2)) AS total FROM orders GROUP BY 1, 2),
      r AS (SELECT month, cust, row_number() OVER (PARTITION BY month ORDER BY total DESC, cust) AS rank FROM o)
      SELECT a.cust, strftime(a.month, '%Y-%m') AS month, a.rank, b.rank - a.rank AS rank_change FROM r a LEFT JOIN r b ON a.cust = b.cust AND a.month = b.month + INTERVAL 1 MONTH""",
    "summary_priority": f"""WITH {POSTS_SQL}, q AS (SELECT *, {H} AS cluster_id FROM posts WHERE {NORMAL_SQL} <> ''),
      g AS (SELECT cluster_id, max(scraped_at) AS ts, sum(view_count)::BIGINT AS views, min(id) AS f, list_slice(list_sort(list(id)), 1, 5) AS now,
        coalesce(list_slice(list_sort(list(id) FILTER (WHERE scraped_at <= TIMESTAMP '2024-01-30')), 1, 5), []) AS before FROM q GROUP BY 1 HAVING count(*) > 1)
      SELECT cluster_id, round(views * pow(0.5, date_diff('microsecond', ts, TIMESTAMP '{AS_OF}') / 3.6e9 / 6) * CASE WHEN f % 3 = 1 THEN 1.0 ELSE 3.0 END
        * CASE WHEN len(before) > 0 AND 1 - len(list_intersect(before, now)) / len(list_distinct(list_concat(before, now))) >= 0.3 THEN 1.2 ELSE 1.0 END, 6) AS priority FROM g""",
    "summary_fingerprints": f"""WITH {POSTS_SQL}, r AS (SELECT {H} AS h, id, row_number() OVER (PARTITION BY {H} ORDER BY id) AS rn FROM posts WHERE {NORMAL_SQL} <> '')
      SELECT h, md5(string_agg(id::VARCHAR, ',' ORDER BY id)) AS fingerprint FROM r WHERE rn <= 5 GROUP BY 1""",
}
