"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys, are range-sorted by key within their source, and a distributed
prefix sum of their sizes says where each source's budget ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, tidy

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix's size as a share of all sizes, and each source's ceiling as a multiple of its size.
SHARE, CEILING = 1.5, 2
#: Documents of a source are dealt into ranges of about this many keys for the prefix sum.
RANGE_ROWS = 2_000


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Shares follow the weights; none goes above ``ceiling`` times its source, and what is above is
    shared again by weight among the rest. Ordering the sources by ceiling per weight turns these
    rounds into running sums: the sources at their ceiling come first.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by_ratio = Window.orderBy("ratio", "n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.lit(ceiling) * F.col("source_size")
    weight = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sources.withColumn("n", named)
        .withColumn("weight", F.element_at(weight, ((F.col("n") - 1) % len(weights) + 1).cast("int")))
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("level", (F.lit(share) * F.col("all_size") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        # the level that holds for all that aren't capped is that of the first of them
        .withColumn("final", F.min(F.when(~F.col("capped"), F.struct("ratio", "n", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * F.col("final")))
        .drop("n", "weight", "ratio", "all_size", "level", "capped", "final")
    )


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: int = CEILING, seed: int = 7, carry: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): how many of its words the mix takes.

    Each source is taken whole as often as its target holds it, then once more along the random
    order up to its exact budget; the document at the cut is taken in part. ``taken`` thus never
    exceeds ``ceiling`` times ``size``. A column named by ``carry`` comes along as the last one.

    Nulls: a null text has size 0 and the key of the empty text; null sources form one source, the
    last; a null doc_id stays. Keys are of doc_id and text, so only rows that repeat both share one;
    of these each counts, and it doesn't matter which is taken. A key of very many rows is dealt into
    ranges of its own. An empty table gives no rows. Other columns don't matter. Sources are few: one
    row for each is ordered in one task.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    columns = [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(part("doc_id"), F.lit(f":{seed}:"), part("text")).cast("binary")).alias("key"),
    ]
    sized = materialize(docs.select(*columns), "mix-sizes")
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    plan = (
        targets(stats, weights, share, ceiling)
        .withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS).cast("long"))
    )
    plan = materialize(plan.select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest", "ranges"), "mix-plan")
    # The range of a key among equal ranges of the keys' values; keys are uniform, so are ranges.
    fraction = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    at = F.least(F.floor(fraction * F.col("ranges")), F.col("ranges") - 1).alias("range")
    ranged = lambda df: df.join(plan, df["source"].eqNullSafe(plan["s"]), "left").select(*[df[c] for c in df.columns], "source_size", "target", "epochs", "rest", at)
    placed = ranged(sized)

    # only a key that repeats overfills its range; such keys come last in it, dealt into parts
    full = placed.groupBy("source", "range").agg(F.count("*").alias("n")).where(F.col("n") > 4 * RANGE_ROWS)
    full = full.select(F.col("source").alias("s"), F.col("range").alias("r"))
    hot = placed.join(full, placed["source"].eqNullSafe(full["s"]) & (placed["range"] == full["r"])).groupBy("source", "key").agg(F.count("*").alias("n")).where(F.col("n") > RANGE_ROWS)
    hot = materialize(hot.select(F.col("source").alias("s"), F.col("key").alias("hot"), F.ceil(F.col("n") / RANGE_ROWS).alias("parts")), "mix-hot")
    some = not hot.isEmpty()

    def dealt(df: DataFrame) -> DataFrame:
        if not some:
            return df.select("*", F.lit(None).cast("string").alias("hot"), F.lit(0).cast("long").alias("part"))
        own = F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1)))
        return df.join(hot, df["source"].eqNullSafe(hot["s"]) & (df["key"] == hot["hot"]), "left").select(*[df[c] for c in df.columns], "hot", own.alias("part"))

    rows = dealt(placed if carry is None else ranged(docs.select(*columns, F.col(f"`{carry}`").alias("__carried"))))
    rows = materialize(rows, "mix-rows") if some else rows  # the parts of a key are dealt once
    slim = rows if some else dealt(placed)
    sums = slim.groupBy("source", "range", "hot", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("range", F.col("hot").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.col("hot").alias("h"), F.col("part").alias("p"), F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("before_part"))
    sums = materialize(sums, "mix-sums")  # its size is known when the join is planned
    within = Window.partitionBy("source", "range", "hot", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(sums, rows["source"].eqNullSafe(sums["s"]) & (rows["range"] == sums["r"]) & rows["hot"].eqNullSafe(sums["h"]) & (rows["part"] == sums["p"]), "left")
    before = F.col("before_part") + F.coalesce(F.sum("size").over(within), F.lit(0))
    once_more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    taken = (F.col("epochs") * F.col("size") + once_more).cast("long").alias("taken")
    return joined.select("doc_id", "size", "source_size", "target", taken, "source", *([] if carry is None else [F.col("__carried").alias(carry)]))


@tidy
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '') || ':7:' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight FROM d GROUP BY source),
-- each source's level if those of a lower ratio of ceiling to weight stop at their ceiling
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
f AS (SELECT arg_min(level, 2 * source_size / weight) AS final FROM l WHERE 2 * source_size / weight > level),
t AS (SELECT source, source_size, CASE WHEN 2 * source_size / weight <= level THEN 2.0 * source_size ELSE weight * final END::DOUBLE AS target FROM l LEFT JOIN f ON true),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
p AS (SELECT d.doc_id, d.size, e.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken, source FROM p
"""
