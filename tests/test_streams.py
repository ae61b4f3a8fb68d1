"""Streams over a table of many files in no order of time give what SQL gives over the table."""

import os

import pytest
from pyspark.sql import functions as F

from compare import compare, duck_of
from trendloom.plans.streams import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def shuffled(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shuffled"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(20, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(10, F.xxhash64("doc_id")).write.parquet(f"{folder}/documents.parquet")
    assert sum(x.endswith(".parquet") for x in os.listdir(f"{folder}/events.parquet")) > 8
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_many_files(spark, sf_dir, shuffled, name):
    assert compare(spark, duck_of(sf_dir), QUERIES[name], ORACLE_SQL[name], shuffled) == ""


def test_keys_again_in_later_batches(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(20, "ts").write.parquet(f"{tmp_path}/events.parquet")
    assert compare(spark, duck_of(sf_dir), QUERIES["stream_first_seen"], ORACLE_SQL["stream_first_seen"], str(tmp_path)) == ""
