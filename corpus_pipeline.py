"""The corpus pipeline: language ID, near-duplicates, decontamination, secrets, then the mix.

Each stage takes (spark, docs, sf_dir) and gives documents; all but the last with their columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import decontaminate, language, mixing, neardup, secrets
from trendloom.llm.common import id_fold, materialize, read, work_path, work_root, work_tables

#: Documents whose language is less sure than this are rejected.
SURE = 0.5
#: Numbers from here on stand for documents that a doc_id doesn't tell apart.
BEYOND = 1 << 62


def _packed(docs: DataFrame) -> DataFrame:
    """Whole rows in the struct ``row``, so that no name of theirs clashes, and their text."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    return docs.select(row.alias("row"), docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"row.`{c}`") for c in docs.columns]


def _numbered(docs: DataFrame) -> DataFrame:
    """``_packed`` with ``doc_id``: the row's own, or where that is null, or where the doc_id has several
    texts for all but one of these, a number beyond all real ones that doc_id and text give."""
    packed = _packed(docs).withColumn("hash", F.xxhash64("text"))
    several = packed.groupBy("id").agg(F.min("hash").alias("first"), F.max("hash").alias("last")).where("id IS NOT NULL AND first < last")
    several = materialize(several.select("id", "first"), "pipeline-several")
    if several.isEmpty():
        first = F.col("hash")
    else:
        packed, first = packed.join(several, "id", "left"), F.coalesce("first", "hash")
    other = F.lit(BEYOND) + F.pmod(F.xxhash64("id", "text"), F.lit(1 << 61))
    return packed.select("row", "text", F.when(F.col("id").isNotNull() & (F.col("hash") == first), F.col("id")).otherwise(other).alias("doc_id"))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a null ``lang`` becomes the recognised one.

    The model learns from the documents that have a ``lang``, but those whose crc32(doc_id) mod 3 is
    1. Rejected: null texts, texts without a letter, and those of a score below ``SURE``.
    """
    model = language.train(docs.where(id_fold("doc_id", 3) != 1).select("text", "lang"))
    found = language.identify(_packed(docs).select("row", "text"), model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= SURE))
    kind = docs.schema["lang"].dataType
    return found.select(*[F.coalesce(F.col("row.lang"), F.col("lang_pred").cast(kind)).alias("lang") if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id.

    Documents are told apart by doc_id and text. Those without a doc_id stay only if no document of
    their group has one. Of rows that repeat both, one stays.
    """
    rows = _numbered(docs)
    decided = neardup.near_duplicates(rows.select("doc_id", "text"))
    decided = decided.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), (F.count("*") > 1).alias("repeated"))
    decided = materialize(decided.where("NOT kept OR repeated"), "pipeline-decided")
    gone = decided.where("NOT kept").select("doc_id")
    again = decided.where("kept").select("doc_id")
    stays = rows.join(gone, "doc_id", "left_anti")
    if again.isEmpty():
        return stays.select(*_columns(docs))
    once = stays.join(again, "doc_id", "left_anti").select(*_columns(docs))
    # few documents are repeated, and only their rows are gathered, pre-aggregated
    whole = F.min_by("row", F.to_json("row")).alias("row")
    return once.unionByName(stays.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(whole).select(*_columns(docs)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark, as the contract's rule has it."""
    rows = _numbered(docs)
    found = decontaminate.decontaminate(rows.select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    dirty = materialize(found.where("contaminated").select("doc_id").distinct(), "pipeline-dirty")
    return rows.join(dirty, "doc_id", "left_anti").select(*_columns(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked; ``n_chars`` follows."""
    return secrets.redact(docs, secrets.train(secrets.default_samples(spark)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, with how many of their words it takes: size, source_size, target, taken.

    Columns of these names in the input are replaced.
    """
    rows = _packed(docs).select("row", F.col("id").alias("doc_id"), "text", F.col("row.source").alias("source"))
    mixed = mixing.mix_sources(rows, carry="row").where("taken > 0")
    added = ["size", "source_size", "target", "taken"]
    return mixed.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *added)


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("mix", mix_sources),
]

#: SQL can't express the first two stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again by the next.

    A stage's own work tables are removed after it, its rows at the end.
    """
    docs = read(spark, sf_dir, "documents")
    with work_tables(spark):
        for name, stage in STAGES[:-1]:
            with work_tables(spark):
                out = stage(spark, docs, sf_dir)
                path = work_path(spark, f"pipeline-{name}", outer=True)
                out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
        with work_tables(spark):
            out = STAGES[-1][1](spark, docs, sf_dir)
            path = f"{work_root(spark)}/trendloom/pipeline-{uuid.uuid4().hex}"
            out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)
