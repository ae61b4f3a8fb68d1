"""Streams that keep state: state tables in versions, per-key state with timers, watermarks that expire keys.

Every job takes the folder it works in from its caller. Called again with the same folder it goes on
where it stopped: files that were counted aren't counted again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..config import DEFAULT
from ..functions.maths import change_rate
from ..operators import similarity as sim
from ..operators.work import work_root, work_table


def job_folder(spark: SparkSession, name: str, path: str | None = None) -> str:
    """The caller's folder, or a new one in the shared work folder."""
    return path or f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions below ``path``, in order."""
    fs, where = _files(spark, path)
    if not fs.exists(where):
        return []
    whole = [x.getPath() for x in fs.listStatus(where) if fs.exists(_files(spark, f"{x.getPath()}/_SUCCESS")[1])]
    return sorted(int(p.getName()[1:]) for p in whole)


def drop(spark: SparkSession, path: str) -> None:
    fs, where = _files(spark, path)
    fs.delete(where, True)


class Job:
    """A stream whose batches turn a state table and rows into the next state table and output rows.

    ``step(state, batch)`` returns (next state, {name: rows}). Version n + 1 of the state and output
    folder n come from version n and batch n alone, so a batch that is repeated after a failure writes the
    same again. Of the state's versions the last two stay.
    """

    def __init__(self, spark: SparkSession, path: str, state: str | StructType, outputs: dict[str, str], step: Callable):
        self.spark, self.path, self.state, self.outputs, self.step = spark, path, state, outputs, step

    def run(self, stream: DataFrame) -> Job:
        """Works on all that has come since the last run."""
        spark, at = self.spark, f"{self.path}/state"
        if not versions(spark, at):
            spark.createDataFrame([], self.state).write.mode("overwrite").parquet(f"{at}/v0")
            for name, schema in self.outputs.items():
                spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}/none")

        def batch(rows: DataFrame, n: int) -> None:
            before = rows.sparkSession.read.schema(self.state).parquet(f"{at}/v{n}")
            after, out = self.step(before, rows)
            for name, some in out.items():
                some.write.mode("overwrite").parquet(f"{self.path}/{name}/b{n}")
            after.write.mode("overwrite").parquet(f"{at}/v{n + 1}")
            for old in versions(spark, at):
                if old < n:
                    drop(spark, f"{at}/v{old}")

        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.path}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        return self

    def now(self) -> DataFrame:
        """The state after the last batch."""
        return self.spark.read.schema(self.state).parquet(f"{self.path}/state/v{versions(self.spark, f'{self.path}/state')[-1]}")

    def output(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.outputs[name]).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")


# --- clusters of duplicates, post by post -------------------------------------------------------

RECENT = "id long, at timestamp, category string, norm string, thumbnail string, label long"


def cluster_job(spark: SparkSession, path: str, hours: int = int(DEFAULT.dedup_hours), delay: float = 0.0) -> Job:
    """Clusters of posts (id, at, category, norm, thumbnail) as they come, linked as ``cluster_duplicates`` links them.

    The state holds the posts of the last ``hours`` + ``delay`` hours before the latest one, each with its
    cluster's label. A batch's posts are compared with these and with each other; labels that meet
    become the least of them. Posts older than ``delay`` hours before the latest of the batches before are
    late: they are dropped and listed. A post that comes again is in its cluster already.

    Outputs: ``posts`` (id, view_count, at) that came, ``merges`` (a, b) of labels that met, ``late`` (id).
    """
    from ..plans.issues import alike_in_time, near_in_time

    span = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {(hours + delay) * 3600})")

    def step(state: DataFrame, batch: DataFrame):
        rows = batch.select("id", F.col("at").cast("timestamp").alias("at"), "category", F.nullif("norm", F.lit("")).alias("norm"), F.nullif("thumbnail", F.lit("")).alias("thumbnail"), "view_count")
        rows = work_table(rows.dropDuplicates(["id"]).join(state.select("id"), "id", "left_anti"), "fresh")
        mark = state.agg(F.max("at").alias("mark"))
        timed = rows.join(F.broadcast(mark))
        is_late = F.coalesce(F.col("at") < F.col("mark") - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {delay * 3600})"), F.lit(False))
        fresh = work_table(timed.where(~is_late).drop("mark"), "fresh")
        known = work_table(state.withColumn("fresh", F.lit(False)).unionByName(fresh.drop("view_count").select("*", F.col("id").alias("label"), F.lit(True).alias("fresh"))), "known")
        links = alike_in_time(known, hours, fresh="fresh")
        for key in ("norm", "thumbnail"):
            # only keys that the batch has can have got a new link
            touched = known.join(known.where("fresh").select(key).distinct(), key, "left_semi")
            links = links.unionByName(near_in_time(touched, key, hours))
        of = lambda side: known.select(F.col("id").alias(side), F.col("label").alias(f"of_{side}"))
        met = links.join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct()
        met = work_table(met, "met")
        least = work_table(sim.groups(met.select(F.explode(F.array("a", "b")).alias("id")), met), "least")
        merges = least.where("id <> group").select(F.col("group").alias("a"), F.col("id").alias("b"))
        newest = known.agg(F.max("at").alias("newest"))
        after = known.join(F.broadcast(newest)).where(F.col("at") >= F.col("newest") - span)
        after = after.join(least.select(F.col("id").alias("label"), "group"), "label", "left").withColumn("label", F.coalesce("group", "label"))
        columns = [c.split()[0] for c in RECENT.split(", ")]
        return after.select(*columns), {"posts": fresh.select("id", "view_count", "at"), "merges": merges, "late": timed.where(is_late).select("id")}

    return Job(spark, path, RECENT, {"posts": "id long, view_count long, at timestamp", "merges": "a long, b long", "late": "id long"}, step)


def clusters_of(job: Job) -> DataFrame:
    """(cluster_id, member_count, canonical_id) of a ``cluster_job``: what has met, through all batches."""
    came = job.output("posts").dropDuplicates(["id"])
    grouped = sim.groups(came.select("id"), job.output("merges")).join(came, "id")
    best = F.max_by("id", F.struct("view_count", "at", -F.col("id")))
    return grouped.groupBy(F.col("group").alias("cluster_id")).agg(F.count("*").alias("member_count"), best.alias("canonical_id")).where("member_count > 1")


# --- novelty against the tick before ------------------------------------------------------------

SNAPSHOTS = "stable_id string, members array<long>, put long"


def novelty_job(spark: SparkSession, path: str, most: int = 500) -> Job:
    """How far each issue's members changed since its last tick: rows (tick, rank, stable_id, members).

    The state is each known issue's last members, ``most`` issues at most: the one that was put in first goes
    first, and one that is known keeps its place, as if rows were put in one by one by (tick, rank).
    A tick's rows are compared with what was known when it began; an issue that wasn't has change 0. Rows
    without stable_id are compared with nothing and not put in. Ticks must come in order.

    Output ``changes`` (tick, stable_id, change).
    """

    def step(state: DataFrame, batch: DataFrame):
        known = state.select(F.lit(None).cast("string").alias("tick"), F.lit(0).cast("long").alias("rank"), "stable_id", "members", "put")
        rows = known.unionByName(batch.where("stable_id IS NOT NULL").select(F.col("tick").cast("string").alias("tick"), F.col("rank").cast("long").alias("rank"), "stable_id", "members", F.lit(None).cast("long").alias("put")))
        rows = work_table(rows, "ticks")
        each = Window.partitionBy("stable_id").orderBy(F.col("tick").asc_nulls_first(), "rank").rowsBetween(Window.unboundedPreceding, -1)
        base = rows.agg(F.coalesce(F.max("put"), F.lit(0)).alias("base"))

        def placed(flagged: DataFrame) -> DataFrame:
            """With ``before`` and ``began``, how many were put in before the row and before its tick, in two steps: ticks, then rows of a tick."""
            ticks = flagged.where("tick IS NOT NULL").groupBy("tick").agg(F.sum(F.col("new").cast("long")).alias("n"))
            # one row a tick
            earlier = ticks.select("tick", F.coalesce(F.sum("n").over(Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sum"))
            within = Window.partitionBy("tick").orderBy("rank", "stable_id").rowsBetween(Window.unboundedPreceding, -1)
            at = flagged.join(F.broadcast(earlier), "tick", "left").join(F.broadcast(base))
            own = F.coalesce(F.sum(F.col("new").cast("long")).over(within), F.lit(0))
            at = at.withColumn("began", F.col("base") + F.coalesce("sum", F.lit(0))).withColumn("before", F.col("began") + own).drop("sum", "base")
            return at.withColumn("place", F.when(F.col("tick").isNull(), F.col("put")).when(F.col("new"), F.col("before") + 1)).withColumn("last_place", F.max("place").over(each))

        flagged = rows.withColumn("new", F.col("tick").isNotNull() & (F.count("*").over(each) == 0))
        while True:
            # who was put in when decides who had gone, and that who was put in again; each turn settles one more row of an issue at least
            at = work_table(placed(flagged), "placed")
            new = F.col("tick").isNotNull() & (F.col("last_place").isNull() | (F.col("before") - F.col("last_place") >= most))
            flagged = at.withColumn("now", new).drop("began", "before", "place", "last_place")
            if flagged.where("now <> new").isEmpty():
                break
            flagged = flagged.withColumn("new", F.col("now")).drop("now")
        was = F.last("members").over(each)
        there = F.coalesce(F.col("began") - F.col("last_place") < most, F.lit(False)) & F.coalesce(F.size(was) > 0, F.lit(False))
        changes = at.withColumn("change", F.when(there, change_rate(was, F.col("members"))).otherwise(0.0)).where("tick IS NOT NULL")
        alone = batch.where("stable_id IS NULL").select(F.col("tick").cast("string").alias("tick"), "stable_id", F.lit(0.0).alias("change"))
        total = at.agg(F.max(F.greatest("before", F.coalesce("place", F.lit(0)))).alias("total"))
        last = at.groupBy("stable_id").agg(F.max_by("members", F.struct(F.col("tick").isNotNull(), "tick", "rank")).alias("members"), F.max("place").alias("put"))
        after = last.join(F.broadcast(total)).where(F.col("total") - F.col("put") < most).select("stable_id", "members", "put")
        return after, {"changes": changes.select("tick", "stable_id", "change").unionByName(alone)}

    return Job(spark, path, SNAPSHOTS, {"changes": "tick string, stable_id string, change double"}, step)


# --- velocity: first and last snapshot of each post ---------------------------------------------

RATES = "post_id long, views double, comments double, likes double, hours double, gone boolean"
_EDGE = "at long, id long, views long, comments long, likes long"


def velocity_updates(snapshots: DataFrame, idle: str = "2 hours", delay: str = "30 minutes") -> DataFrame:
    """``RATES`` of posts whose snapshots (id, post_id, captured_at, view_count, comment_count, like_count) came.

    The state of a post is its first and last snapshot, by time and id, whatever order they come in. A post
    without a snapshot for ``idle`` before the watermark, ``delay`` behind the latest, leaves the state and
    has a last row, ``gone``. Later snapshots than the watermark are dropped.
    """
    quiet = pd.Timedelta(idle) // pd.Timedelta("1ms")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            edges = state.get
            state.remove()
            yield _rates(key[0], edges, True)
            return
        edges = state.get if state.exists else None
        for pdf in batches:
            rows = [pdf["captured_at"].to_numpy().astype("datetime64[us]").astype("int64"), *(pdf[c].to_numpy() for c in ("id", "view_count", "comment_count", "like_count"))]
            order = np.lexsort((rows[1], rows[0]))
            for row in (tuple(int(x[i]) for x in rows) for i in (order[0], order[-1])):
                edges = (*min(edges[:5], row), *max(edges[5:], row)) if edges is not None else (*row, *row)
        state.update(edges)
        # timers can't be before the watermark
        state.setTimeoutTimestamp(max(edges[5] // 1000 + quiet, state.getCurrentWatermarkMs() + 1))
        yield _rates(key[0], edges, False)

    kept = ", ".join(f"{edge}_{field}" for edge in ("first", "last") for field in _EDGE.split(", "))
    marked = snapshots.withColumn("captured_at", F.col("captured_at").cast("timestamp")).withWatermark("captured_at", delay)
    return marked.groupBy("post_id").applyInPandasWithState(step, RATES, kept, "update", GroupStateTimeout.EventTimeTimeout)


def _rates(post_id: int, edges: tuple, gone: bool) -> pd.DataFrame:
    hours = (edges[5] - edges[0]) / 3.6e9
    rates = [(z - a) / max(hours, 0.17) for a, z in zip(edges[2:5], edges[7:10], strict=True)]
    return pd.DataFrame([(post_id, *rates, hours, gone)], columns=[c.split()[0] for c in RATES.split(", ")])


def latest_rows(updates: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key of a stream of updates, written batch by batch below ``path``."""
    spark = updates.sparkSession
    schema = updates.schema
    spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long")).write.mode("ignore").parquet(f"{path}/rows/none")

    def batch(rows: DataFrame, n: int) -> None:
        rows.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/b{n}")

    query = updates.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").schema(schema.add("batch", "long")).parquet(f"{path}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in schema.names if c not in (*keys, "batch")]), "batch").alias("row")).select(*keys, "row.*")


# --- watermarks ---------------------------------------------------------------------------------


def live_windows(events: DataFrame, size: str, delay: str, *by: str) -> DataFrame:
    """Counts and sums of ``value`` in windows, each given once the watermark, ``delay`` behind the latest event, has passed it.

    What comes for a window that was given is dropped; the state holds open windows only.
    """
    at = F.window("ts", size)
    counts = events.withWatermark("ts", delay).groupBy(at.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), *by, "n", F.round("total", 4).alias("total"))


def live_sessions(events: DataFrame, gap: str, delay: str, key: str) -> DataFrame:
    """Sessions of ``key``, each given once the watermark has passed its end; the state holds open ones only."""
    counts = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def seen_within(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Events whose keys weren't seen within ``delay`` before: later ones count as new, as the keys' state expires."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


class Progress:
    """What a finished query's batches say of its state: rows held, and rows dropped as late."""

    def __init__(self, query):
        self.rows = [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress]
        self.late = sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)


def run_append(stream: DataFrame, path: str) -> tuple[DataFrame, Progress]:
    """All that has come since the last run with this ``path``, appended to its table; each batch counts once."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/table").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table"), Progress(query)


def expire(table: DataFrame, at: str, now: Column, days: dict[str, float], kind: str, default: float) -> DataFrame:
    """Rows of ``table`` that are younger than their ``kind`` is kept: ``days`` by kind, else ``default``."""
    keep = F.coalesce(F.create_map(*[F.lit(x) for pair in days.items() for x in (pair[0], float(pair[1]))])[F.col(kind)], F.lit(float(default)))
    return table.where(F.timestamp_diff("MICROSECOND", F.col(at), now) <= keep * 86_400_000_000)
