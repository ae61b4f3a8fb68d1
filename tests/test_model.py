"""Running counts against a plain loop, with a post that has most events."""

import datetime
import random

from trendloom.model import snapshots_of


def test_snapshots_of_a_hot_post(spark):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    events = []
    for i in range(600):
        user = rng.choice([1, 1, 1, 1, 2, 3, None])
        ts = None if rng.random() < 0.03 else start + datetime.timedelta(minutes=rng.randrange(3000))
        events.append((i, user, ts, rng.choice(["view", "view", "click", "purchase", "error"])))
    events += [(1000 + i, 1, start, "view") for i in range(20)]  # ties in time
    rng.shuffle(events)
    out = snapshots_of(spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz, event_type string").repartition(3)).collect()
    want, counts = [], {}
    for i, user, ts, kind in sorted(events, key=lambda e: (e[2] is not None, e[2] or start, e[0])):
        if kind != "error":
            own = counts.setdefault(user, {"view": 0, "click": 0, "purchase": 0})
            own[kind] += 1
            want.append((i, user, ts, own["view"], own["click"], own["purchase"]))
    assert sorted(map(tuple, out)) == sorted(want)


def test_no_events(spark):
    empty = spark.createDataFrame([], "event_id long, user_id long, ts timestamp_ntz, event_type string")
    assert snapshots_of(empty).count() == 0
