"""Settings in groups with typed bounds: proposals are checked as rows, kept by group, and reset by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CATEGORY_WEIGHT, CHANNEL_HALF_LIFE, COMMENT_LIKE_WEIGHT, COMMUNITY_HALF_LIFE, COMMUNITY_WEIGHT, NEWS_HALF_LIFE, SOURCE_WEIGHT

# Groups of settings: key, default, least, greatest, step.
NUMBERS = {
    "issue_aggregator": (
        ("ISSUE_WINDOW_HOURS", 12, 1, 48, 1), ("MAX_ISSUES", 30, 5, 100, 1), ("NEWS_WEIGHT", 1.0, 0.1, 5.0, 0.1), ("COMMUNITY_WEIGHT", 0.6, 0.0, 5.0, 0.1), ("TREND_SIGNAL_WEIGHT", 0.4, 0.0, 5.0, 0.1),
        ("ISSUE_DEDUP_THRESHOLD", 0.55, 0.1, 1.0, 0.05), ("CONTAINMENT_THRESHOLD", 0.60, 0.3, 0.9, 0.05), ("DIMINISHING_K", 0.7, 0.1, 2.0, 0.1), ("MOMENTUM_WEIGHT", 0.4, 0.0, 1.0, 0.05), ("MOMENTUM_PENALTY_MIN", 0.7, 0.5, 1.0, 0.05),
        ("COMMUNITY_BOOST", 0.3, 0.0, 0.5, 0.05), ("DIVERSITY_CAP", 2.5, 1.0, 5.0, 0.1), ("CROSS_SOURCE_2", 0.1, 0.0, 0.3, 0.05), ("CROSS_SOURCE_3", 0.2, 0.0, 0.5, 0.05), ("BREAKING_KW_HALFLIFE", 30, 10, 120, 5), ("BREAKING_KW_MAX_BOOST", 3.0, 1.5, 5.0, 0.5),
    ),
    "news_signal_weights_v7": (
        ("portal_weight", 0.32, 0.0, 1.0, 0.05), ("cluster_weight", 0.27, 0.0, 1.0, 0.05), ("trend_weight", 0.18, 0.0, 1.0, 0.05), ("engagement_weight", 0.13, 0.0, 1.0, 0.05), ("freshness_weight", 0.10, 0.0, 1.0, 0.05),
    ),
    "trend_signal": (("TREND_SIGNAL_BONUS_CAP", 1.8, 1.0, 5.0, 0.1), ("MIN_KOREAN_KEYWORD_LEN", 2, 1, 10, 1), ("MIN_LATIN_KEYWORD_LEN", 3, 1, 10, 1)),
    "breaking_news": (("DETECTION_WINDOW_HOURS", 2, 0.5, 12, 0.5), ("MIN_SOURCES", 3, 2, 10, 1), ("TIME_WINDOW_MINUTES", 30, 5, 120, 5), ("BOOST_HALF_LIFE_MINUTES", 30, 5, 120, 5), ("MAX_BOOST", 3.0, 1.5, 10.0, 0.5)),
    "summary_queue": (
        ("FRESHNESS_HALF_LIFE_HOURS", 6, 1, 48, 1), ("UNSUMMARIZED_PENALTY_MIN", 1.0, 1.0, 3.0, 0.1), ("UNSUMMARIZED_PENALTY_MAX", 3.0, 1.0, 5.0, 0.1), ("NOVELTY_FACTOR", 1.2, 1.0, 3.0, 0.05),
        ("NOVELTY_THRESHOLD", 0.3, 0.1, 0.9, 0.05), ("PHASE_TIMEOUT_MS", 90000, 10000, 300000, 1000), ("SINGLE_CALL_TIMEOUT_MS", 8000, 1000, 30000, 500), ("MAX_ISSUES_PER_WINDOW", 15, 1, 50, 1),
    ),
}
# The same of settings that are a number for each name.
RECORDS = {
    "channel_half_lives": (("values", CHANNEL_HALF_LIFE, 10, 1440, 10),),
    "source_weights": (("values", SOURCE_WEIGHT, 0.1, 5.0, 0.1),),
    "category_weights": (("values", CATEGORY_WEIGHT, 0.1, 5.0, 0.05),),
    "community_source_weights": (("values", COMMUNITY_WEIGHT, 0.1, 5.0, 0.05),),
    "community_decay_half_lives": (("values", COMMUNITY_HALF_LIFE, 10, 1440, 10),),
    "engagement_weights": (("comment_weights", {k: v[0] for k, v in COMMENT_LIKE_WEIGHT.items()}, 0.0, 5.0, 0.1), ("like_weights", {k: v[1] for k, v in COMMENT_LIKE_WEIGHT.items()}, 0.0, 5.0, 0.1)),
    "news_decay_half_lives": (("values", NEWS_HALF_LIFE, 60, 1440, 10),),
}
# The same of settings that are a list of numbers.
ARRAYS = {"trend_signal": (("BASE_BONUS_BY_COUNT", [1.0, 1.15, 1.35, 1.6], 1.0, 3.0, 0.05),)}
BOUNDS = "group string, key string, kind string, default string, least double, greatest double, step double"


def bound_rows() -> list[tuple]:
    import json

    kinds = (("number", NUMBERS), ("record", RECORDS), ("array", ARRAYS))
    return [(group, key, kind, json.dumps(default), float(low), float(high), float(step)) for kind, groups in kinds for group, fields in groups.items() for key, default, low, high, step in fields]


def bounds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(bound_rows(), BOUNDS)


def _faults(value: Column) -> Column:
    """What is wrong with a JSON value by its kind and bounds, null if nothing."""
    number = lambda name, x: F.when(~x.rlike(_NUMBER) | x.try_cast("double").isNull(), F.concat(name, F.lit(": not a number"))).when(
        x.cast("double") < F.col("least"), F.concat(name, F.lit(": below "), F.col("least").cast("string"))
    ).when(x.cast("double") > F.col("greatest"), F.concat(name, F.lit(": above "), F.col("greatest").cast("string")))
    joined = lambda parts: F.nullif(F.array_join(parts, "; "), F.lit(""))
    # raw parts, so that a quoted number stays a string
    record, array = F.from_json(value, "map<string,variant>"), F.from_json(value, "array<variant>")
    text = lambda v: F.when(F.call_function("schema_of_variant", v).isin("BIGINT", "DOUBLE") | F.call_function("schema_of_variant", v).startswith("DECIMAL"), F.call_function("variant_get", v, F.lit("$"), F.lit("string"))).otherwise("")
    names = F.array_sort(F.map_keys(record))
    of_record = F.when(~value.startswith("{") | record.isNull(), F.concat("key", F.lit(": not an object"))).otherwise(joined(F.transform(names, lambda k: number(F.concat("key", F.lit("."), k), text(record[k])))))
    of_array = F.when(~value.startswith("[") | array.isNull(), F.concat("key", F.lit(": not a list"))).otherwise(joined(F.transform(array, lambda v, i: number(F.concat("key", F.lit("["), i.cast("string"), F.lit("]")), text(v)))))
    return F.when(F.col("kind") == "number", number(F.col("key"), value)).when(F.col("kind") == "record", of_record).otherwise(of_array)


_NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def check_changes(changes: DataFrame) -> DataFrame:
    """``changes`` (group, key, value: JSON) with ``fault``: why the value can't be set, null if it can.

    Group and key must be known; numbers must be numbers within their bounds, in objects and lists each one.
    """
    spark = changes.sparkSession
    known = F.broadcast(bounds(spark))
    groups = F.broadcast(bounds(spark).select("group").distinct().withColumn("known", F.lit(True)))
    found = changes.join(groups, "group", "left").join(known, ["group", "key"], "left")
    value = F.trim(F.coalesce("value", F.lit("")))
    fault = F.when(F.col("known").isNull(), F.concat(F.lit("unknown group "), F.coalesce("group", F.lit("")))).when(F.col("kind").isNull(), F.concat(F.lit("unknown field "), F.coalesce("key", F.lit("")))).otherwise(_faults(value))
    return found.select(*[F.col(c) for c in changes.columns], fault.alias("fault"))


def apply_changes(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Settings (group, key, value) after ``changes`` (batch, group, key, value), in order of batch.

    A batch of a group is set as a whole or, with a fault in any of its values, not at all; one whose key and value are null
    resets its group to the defaults. Of what is set the last counts.
    """
    reset = F.col("key").isNull() & F.col("value").isNull()
    checked = check_changes(changes).withColumn("reset", reset & ~F.coalesce(F.col("fault").startswith("unknown group"), F.lit(False)))
    whole = checked.groupBy("batch", "group").agg(F.bool_or(F.col("fault").isNotNull() & ~F.col("reset")).alias("bad"))
    good = checked.join(whole, ["batch", "group"]).where("NOT bad")
    resets = good.where("reset").groupBy("group").agg(F.max("batch").alias("from"))
    rows = stored.select(F.lit(None).cast("long").alias("batch"), "group", "key", "value").unionByName(good.where("NOT reset").select(F.col("batch").cast("long").alias("batch"), "group", "key", "value"))
    kept = rows.join(resets, "group", "left").where(F.col("from").isNull() | (F.col("batch") > F.col("from")))
    return kept.groupBy("group", "key").agg(F.max_by("value", F.struct(F.coalesce("batch", F.lit(-(1 << 62))), "value")).alias("value"))


def settings(spark: SparkSession, stored: DataFrame) -> DataFrame:
    """Every setting with its value, the stored one or its default, its bounds, and whether it was changed."""
    own = stored.select("group", "key", F.col("value").alias("set"))
    return bounds(spark).join(own, ["group", "key"], "left").select("group", "key", "kind", F.coalesce("set", "default").alias("value"), "least", "greatest", "step", F.col("set").isNotNull().alias("changed"))


# Features that can be switched off and on, and their defaults.
FLAGS = {"embeddings_enabled": True, "gemini_summary_enabled": True, "cross_validation_enabled": True, "scoring_track_b_enabled": False, "scoring_v8_enabled": True}


def flags(stored: DataFrame) -> DataFrame:
    """(flag, enabled): a default that is on goes off by the value ``false`` alone, one that is off goes on by ``true`` alone."""
    default = stored.sparkSession.createDataFrame(list(FLAGS.items()), "flag string, usual boolean")
    own = stored.where("group = 'feature_flags'").select(F.col("key").alias("flag"), F.trim("value").alias("value"))
    enabled = F.when(F.col("usual"), ~F.col("value").eqNullSafe("false")).otherwise(F.col("value").eqNullSafe("true"))
    return default.join(own, "flag", "left").select("flag", enabled.alias("enabled"))
