"""Work tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_root(spark: SparkSession) -> str:
    """The folder for work tables, below the one that the cluster names."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="trendloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/trendloom"


def work_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared work folder and read again: short lineage, safe from lost executors."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to all shuffle partitions: for narrow rows whose next step is costly, which otherwise meet in few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
