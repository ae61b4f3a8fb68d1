"""URL filters: host-suffix and path-prefix expressions joined with hashed rules (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: What holds where no rule fits.
DEFAULT = "allow"
#: Hex digits of the digest that the join compares; the whole digest is compared after it.
SHORT = 8


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def url_parts(url):
    """(host, path) of a url column; both empty for null and where there is no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    rest = F.when(F.locate("://", url) > 0, rest).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest
    rule wins (longer host, then longer path; of rules with one host and path, ``block`` wins).
    Each distinct host and path is expanded once into those host suffixes whose number of labels and
    those path prefixes whose length some rule has. Expressions and rules meet on a short digest prefix, then
    on the full digest, so rule lists of any size are joined, not broadcast by force.

    Nulls: a null url, or one without ``://``, has an empty host and path and gets the default; a
    null page_id stays. Rules with a null part or an empty host never fit. Repeated rows each give
    a row. Other columns don't matter.
    """
    host, path = url_parts(F.col("url"))
    judged = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rules = (
        rules.where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL AND host != ''")
        .select(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"), F.length("path").alias("path_length"), (F.length("host") - F.length(F.replace(F.col("host"), F.lit("."))) + 1).alias("labels"))
        .withColumn("digest", F.sha2(F.concat(F.col("host_length").cast("string"), F.lit(":"), "rule"), 256))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    # The distinct numbers of labels and path lengths: no more of them than the longest rule has characters.
    distinct = lambda c: sorted(n for (n,) in rules.select(c).distinct().collect())
    lengths = F.array(*[F.lit(n) for n in distinct("path_length")]).cast("array<int>")
    labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."))) + 1
    suffix = F.array(*[F.when(F.col("labels") >= n, F.substring_index("host", ".", -n)) for n in distinct("labels")]).cast("array<string>")
    prefix = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (
        judged.where("host != ''").select("host", "path").distinct()
        .withColumn("labels", labels)
        .select("host", "path", F.explode(suffix).alias("h"), prefix.alias("prefixes"))
        .where("h != ''")  # null: too few labels
        .select("host", "path", "h", F.explode("prefixes").alias("p"))
        .select("host", "path", F.sha2(F.concat(F.length("h").cast("string"), F.lit(":"), "h", "p"), 256).alias("full"))
        .withColumn("short", F.substring("full", 1, SHORT))
    )
    order = F.struct("host_length", "path_length", F.col("verdict") == "block", "rule", "verdict")
    best = (
        expressions.join(rules, "short").where("full = digest")
        .groupBy("host", "path").agg(F.max(order).alias("best"))
    )
    return judged.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), rule_table(spark))


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC NULLS LAST, length(q) DESC) AS n
      FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, h || q AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
