"""Streams with state: restarts from the caller's folder, late rows, expiry, eviction."""

import datetime as dt
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from compare import compare, duck_of
from trendloom.plans import issues, streams
from trendloom.plans.streams import ORACLE_SQL
from trendloom.streaming import jobs, state

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


# --- clusters ---

POSTS = "id long, at timestamp, category string, norm string, thumbnail string, view_count long"


def cluster_rows(n, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(40)]
    bases = [" ".join(rng.choices(words, k=7)) for _ in range(6)]
    rows = []
    for i in range(n):
        title = rng.choice(bases) if rng.random() < 0.7 else " ".join(rng.choices(words, k=7))
        if rng.random() < 0.3:
            title = title.replace(title.split()[0], rng.choice(words), 1)
        rows.append((i, at(rng.random() * 40), rng.choice(["news", "video"]), title if i % 13 else "", f"img{rng.randrange(60)}" if i % 3 == 0 else None, rng.randrange(100)))
    return rows


def batch_clusters(spark, rows):
    p = spark.createDataFrame(rows, POSTS)
    grouped = issues.cluster_duplicates(p.drop("view_count")).join(p.select("id", "view_count", "at"), "id")
    best = F.max_by("id", F.struct("view_count", "at", -F.col("id")))
    out = grouped.groupBy(F.col("group").alias("cluster_id")).agg(F.count("*").alias("member_count"), best.alias("canonical_id"))
    return sorted(map(tuple, out.where("member_count > 1").collect()))


@pytest.mark.parametrize("in_order", [True, False])
def test_clusters_of_any_batches(spark, tmp_path, in_order):
    """In order with a short delay, in any order with a long one, and started anew between batches: the batch's clusters."""
    rows = cluster_rows(90, 3)
    if in_order:
        rows = sorted(rows, key=lambda r: r[1])
    folder, job = f"{tmp_path}/in", None
    for i in range(0, 90, 30):
        add(spark, folder, rows[i : i + 30] + rows[max(0, i - 1) : i], POSTS)
        job = state.cluster_job(spark, f"{tmp_path}/job", delay=0.0 if in_order else 100.0).run(stream_of(spark, folder, POSTS))
    want = batch_clusters(spark, rows)
    assert sorted(map(tuple, state.clusters_of(job).collect())) == want and len(want) > 5
    assert job.output("late").count() == 0 and len(state.versions(spark, f"{tmp_path}/job/state")) == 2
    held = job.now().count()
    newest = max(r[1] for r in rows)
    assert held == sum(r[1] >= newest - dt.timedelta(hours=6 + (0 if in_order else 100)) for r in rows)


def test_late_posts_and_old_keys(spark, tmp_path):
    """A late post is dropped and listed; a title that comes after its key left the state begins a cluster of its own."""
    folder = f"{tmp_path}/in"
    same = "exactly the same title"
    job = state.cluster_job(spark, f"{tmp_path}/job", delay=1.0)
    for rows in ([(1, at(0), "news", same, None, 1), (2, at(1), "news", same, None, 2)], [(3, at(20), "news", same, None, 1), (4, at(19.5), "news", "another thing", None, 1)], [(5, at(2), "news", same, None, 1), (6, at(19.2), "news", same, "", 9)]):
        add(spark, folder, rows, POSTS)
        job.run(stream_of(spark, folder, POSTS))
    assert [r.id for r in job.output("late").collect()] == [5]
    assert sorted(map(tuple, state.clusters_of(job).collect())) == [(1, 2, 2), (3, 2, 6)]
    assert sorted(r.id for r in job.now().collect()) == [3, 4, 6]


def test_clusters_without_rows(spark, tmp_path):
    add(spark, f"{tmp_path}/in", [], POSTS)
    assert state.clusters_of(state.cluster_job(spark, f"{tmp_path}/job").run(stream_of(spark, f"{tmp_path}/in", POSTS))).count() == 0


# --- novelty ---

TICKS = "tick string, rank long, stable_id string, members array<long>"


def plain_novelty(ticks, most):
    """One map, rows put in one by one; a tick is compared with what was known when it began."""
    known, out = OrderedDict(), []
    for tick in sorted({t[0] for t in ticks}):
        own = sorted((t for t in ticks if t[0] == tick), key=lambda t: t[1])
        for _, _, key, now in own:
            was = known.get(key) or []
            out.append((tick, str(key), round(1 - len(set(was) & set(now)) / len(set(was) | set(now)), 6) if key is not None and was and (was or now) else 0.0))
        for _, _, key, now in own:
            if key is None:
                continue
            if key not in known and len(known) >= most:
                known.popitem(last=False)
            known[key] = now
    return sorted(out), known


@pytest.mark.parametrize("most", [3, 5, 500])
def test_novelty_with_eviction(spark, tmp_path, most):
    rng = random.Random(most)
    ticks = []
    for t in range(9):
        keys = rng.sample([f"k{i}" for i in range(9)], rng.randrange(2, 6))
        ticks += [(f"t{t}", i, k, rng.sample(range(8), rng.randrange(0 if t % 4 == 3 else 1, 5))) for i, k in enumerate(keys)]
    ticks.append(("t4", 99, None, [1, 2]))
    folder, job = f"{tmp_path}/in", state.novelty_job(spark, f"{tmp_path}/job", most)
    for some in (("t0", "t1", "t2", "t3"), ("t4",), ("t5", "t6", "t7", "t8")):
        add(spark, folder, [t for t in ticks if t[0] in some], TICKS)
        job.run(stream_of(spark, folder, TICKS))
    want, known = plain_novelty(ticks, most)
    assert sorted((r.tick, str(r.stable_id), round(r.change, 6)) for r in job.output("changes").collect()) == want
    held = sorted(job.now().collect(), key=lambda r: r.put)
    assert [(r.stable_id, list(r.members)) for r in held] == [(k, list(v)) for k, v in known.items()]


# --- velocity ---

SNAPS = "id long, post_id long, captured_at timestamp, view_count long, comment_count long, like_count long"


def test_velocity_of_many_files(spark, sf_dir, tmp_path):
    """Snapshots in twenty files of no order, the job started anew half-way."""
    snaps = streams.snapshots(spark, sf_dir).repartition(20, F.xxhash64("id"))
    snaps.write.parquet(f"{tmp_path}/snapshots")
    query = lambda spark, folder: streams.stream_velocity(spark, sf_dir, str(tmp_path))
    assert compare(spark, duck_of(sf_dir), query, ORACLE_SQL["stream_velocity"], sf_dir) == ""


def test_velocity_expires(spark, tmp_path):
    """A post that was quiet for long leaves the state with a last row; what comes later than the watermark is dropped."""
    folder, job = f"{tmp_path}/in", f"{tmp_path}/job"
    batches = [[(1, 1, at(0), 0, 0, 0), (2, 1, at(1), 60, 6, 3), (3, 2, at(0.5), 1, 1, 1)], [(4, 2, at(9), 18, 1, 1)], [(5, 3, at(9.5), 0, 0, 0), (6, 2, at(1), 999, 9, 9)], [(7, 3, at(10), 5, 5, 5)]]
    for rows in batches:
        add(spark, folder, rows, SNAPS)
        updates = state.velocity_updates(stream_of(spark, folder, SNAPS), idle="2 hours", delay="30 minutes")
        found = {r.post_id: r for r in state.latest_rows(updates, job, ["post_id"]).collect()}
    assert found[1].gone and (found[1].views, found[1].comments, found[1].likes) == (60.0, 6.0, 3.0)
    assert not found[2].gone and not found[3].gone and found[2].views < 10 and found[3].views == 10.0


# --- watermarks ---

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_late_events_and_shrinking_state(spark, tmp_path):
    folder, job = f"{tmp_path}/in", f"{tmp_path}/job"
    for n, rows in enumerate(([(i, at(i / 10), i, "view", 1.0) for i in range(40)], [(100, at(20), 1, "view", 1.0)], [(101, at(2.5), 1, "view", 1.0), (102, at(19.5), 1, "view", 1.0)])):
        add(spark, folder, rows, EVENTS)
        table, progress = state.run_append(state.live_windows(stream_of(spark, folder, EVENTS), "1 hour", "2 hours", "event_type"), job)
        if n == 0:
            assert max(progress.rows) == 4
    assert sorted((r.start[11:13], r.n) for r in table.collect()) == [("00", 10), ("01", 10), ("02", 10), ("03", 10)]
    assert progress.late == 1 and progress.rows[-1] == 2  # the event at 2.5 came too late; 19 and 20 are open


def test_keys_are_forgotten(spark, tmp_path):
    folder, job = f"{tmp_path}/in", f"{tmp_path}/job"
    for rows in ([(1, at(0), 1, "view", 1.0), (2, at(0.1), 1, "view", 1.0)], [(3, at(30), 2, "view", 1.0)], [(4, at(31), 1, "view", 1.0), (5, at(31.1), 1, "view", 1.0)]):
        add(spark, folder, rows, EVENTS)
        table, progress = state.run_append(state.seen_within(stream_of(spark, folder, EVENTS), ["user_id"], "1 hour"), job)
    assert sorted(r.event_id for r in table.collect()) in ([1, 3, 4], [2, 3, 4], [1, 3, 5], [2, 3, 5]) and progress.rows[-1] <= 2


def test_expired_rows(spark):
    rows = [(1, at(0), "a"), (2, at(0), "b"), (3, at(0), None), (4, at(23), "a"), (5, None, "a")]
    df = spark.createDataFrame(rows, "id long, ts timestamp, kind string")
    kept = state.expire(df, "ts", F.lit(at(24.0)).cast("timestamp"), {"a": 0.5, "b": 1}, "kind", 2)
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4]


def test_streams_go_on(spark, tmp_path):
    """The older jobs, started anew in the caller's folder, count what has come since only."""
    folder, job = f"{tmp_path}/events.parquet", f"{tmp_path}/job"
    counts = []
    for n in (1, 2):
        add(spark, folder, [(i, at(i / 10), i % 3, "view", 1.0) for i in range(10 * n - 10, 10 * n)], EVENTS)
        out = streams.last_events(jobs.arrivals(spark, str(tmp_path)), path=job)
        counts.append(sum(r.n for r in out.collect()))
    assert counts == [10, 20]
