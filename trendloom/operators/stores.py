"""Tables that are kept: partitions replaced as a whole, days appended and let go, loads swapped in whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.state import _files, drop


def replace_partitions(rows: DataFrame, path: str, *keys: str) -> None:
    """Partitions of ``keys`` that ``rows`` has hold these rows alone afterwards; all other partitions stay.

    A ranked source's new batch, or a window's new pages, so replace the old one without reading it.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_days(rows: DataFrame, path: str, at: str, keep: int, day: str = "day") -> None:
    """Appends snapshots to partitions by the day of ``at``; days that are ``keep`` or more before the latest one go.

    A snapshot of one time replaces what its day had of that time, so a run that is repeated adds nothing twice.
    """
    spark = rows.sparkSession
    dated = rows.withColumn(day, F.date_format(at, "yyyy-MM-dd")).withColumn("taken", F.date_format(at, "HHmmssSSSSSS"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, "taken").parquet(path)
    fs, where = _files(spark, path)
    # a folder a day, so few however many rows there are
    days = sorted(n.split("=", 1)[1] for x in fs.listStatus(where) if (n := x.getPath().getName()).startswith(f"{day}="))
    oldest = spark.range(1).select(F.date_format(F.date_sub(F.lit(days[-1]).cast("date"), keep - 1), "yyyy-MM-dd").alias("d")).first().d if days else ""
    for d in days:
        if d < oldest:
            drop(spark, f"{path}/{day}={d}")


def read_days(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The snapshots that are kept; a day that is just removed is left out."""
    return spark.read.option("ignoreMissingFiles", "true").schema(f"{schema}, day string, taken string").parquet(path).drop("taken")


#: Written last, so a version without it is no version.
WHOLE = "_WHOLE"


def swap_in(spark: SparkSession, path: str, tables: dict[str, DataFrame], check=None) -> int:
    """Loads ``tables`` beside the ones that are read and swaps them in together: the version's number.

    Readers see the last whole version, rows and meta row of one load. A load that fails, also in ``check``
    (which gets the staged tables), leaves it. The version before stays for those who still read it.
    """
    whole = loaded(spark, path)
    fs, where = _files(spark, path)
    # a failed load's folder isn't used again
    begun = [int(n[1:]) for x in (fs.listStatus(where) if fs.exists(where) else []) if (n := x.getPath().getName())[:1] == "v"]
    n = max(begun, default=-1) + 1
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/v{n}/{name}")
    if check is not None:
        check({name: spark.read.schema(rows.schema).parquet(f"{path}/v{n}/{name}") for name, rows in tables.items()})
    mark, at = _files(spark, f"{path}/v{n}/{WHOLE}")
    mark.create(at, False).close()
    for old in begun:
        if old not in whole[-1:]:
            drop(spark, f"{path}/v{old}")
    return n


def loaded(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole loads below ``path``, in order."""
    fs, where = _files(spark, path)
    found = [x.getPath() for x in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(p.getName()[1:]) for p in found if fs.exists(_files(spark, f"{p}/{WHOLE}")[1]))


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Table ``name`` of the last whole load."""
    return spark.read.parquet(f"{path}/v{loaded(spark, path)[-1]}/{name}")


