"""Structured Streaming jobs: each runs over what has come (``availableNow``), and with the same ``path`` can be run again for more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import Job, job_folder


def arrivals(spark: SparkSession, sf_dir: str, table: str = "events", files: int = 8) -> DataFrame:
    """A table's files as a stream. The pattern lets a table be one file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{table}.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else stream


def arrivals_of(table: DataFrame, path: str, files: int = 8) -> DataFrame:
    """A derived table as a stream: written below ``path`` once, then read file by file."""
    table.write.mode("ignore").parquet(path)
    return table.sparkSession.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """All that has come, written to a table below ``path``; its log makes each batch count once."""
    spark = stream.sparkSession
    path = job_folder(spark, name, path)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/table").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def run_upserts(stream: DataFrame, name: str, empty: DataFrame, merge, path: str | None = None) -> DataFrame:
    """A keyed table after all batches: ``merge(table, batch)`` gives its next version."""
    spark = stream.sparkSession
    job = Job(spark, job_folder(spark, name, path), empty.schema, {}, lambda table, batch: (merge(table, batch), {}))
    return job.run(stream).now()


def run_partials(stream: DataFrame, name: str, partial, path: str | None = None) -> DataFrame:
    """``partial(batch)`` of all batches, for one merge at the end: rows count in whatever order files come.

    Each batch has a folder of its own, so a batch that is repeated writes the same one again.
    """
    spark = stream.sparkSession
    path = job_folder(spark, name, path)
    empty = partial(spark.createDataFrame([], stream.schema))
    empty.write.mode("ignore").parquet(f"{path}/table/none")

    def step(batch: DataFrame, n: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/table/b{n}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(empty.schema).option("recursiveFileLookup", "true").parquet(f"{path}/table")


def passed(table: DataFrame, late: str) -> DataFrame:
    """Rows of ``table`` (end, latest) that end ``late`` before the latest of all events."""
    mark = table.agg((F.max("latest") - F.expr(f"INTERVAL {late}")).alias("mark"))
    return table.join(F.broadcast(mark), F.col("end") <= F.col("mark"))


def closed_windows(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", path: str | None = None) -> DataFrame:
    """Counts and sums by kind in the windows that end ``late`` before the latest event."""
    at = F.window("ts", size, slide) if slide else F.window("ts", size)
    aggs = lambda n, value, ts: (n.alias("n"), F.sum(value).alias("total"), F.max(ts).alias("latest"))
    part = lambda batch: batch.groupBy(at.alias("w"), "event_type").agg(*aggs(F.count("*"), "value", "ts")).select("w.start", "w.end", "event_type", "n", "total", "latest")
    out = run_partials(events, "windows", part, path).groupBy("start", "end", "event_type").agg(*aggs(F.sum("n"), "total", "latest"))
    return passed(out, late).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", path: str | None = None) -> DataFrame:
    """Users' sessions that end ``late`` before the latest event; a batch's sessions grow together with other batches'."""
    part = lambda batch: batch.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("latest")).select("user_id", "w.start", "w.end", "n", "latest")
    length = F.concat((F.unix_micros("end") - F.unix_micros("start")).cast("string"), F.lit(" microseconds"))
    out = run_partials(events, "sessions", part, path).groupBy(F.session_window("start", length).alias("w"), "user_id").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"))
    out = out.select("user_id", "w.start", "w.end", "n", "latest")
    return passed(out, late).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once; its state is kept, so a key that comes again later isn't new."""
    return events.select(*keys).dropDuplicates(keys)
