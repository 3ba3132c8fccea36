"""Flows as streams against the same flows as batches and against a loop."""

import random
from datetime import datetime, timedelta

import pytest

from harrow.streaming import flows

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Events in time order over several files, as a stream of one file at a time and as a batch."""
    rng, at, rows = random.Random(7), datetime(2024, 1, 1), []
    for i in range(300):
        at += timedelta(seconds=rng.choice([1, 20, 60, 400]))
        rows.append((i, at, rng.randrange(4), rng.choice(["view", "click"]), 1.0))
    path = str(tmp_path_factory.mktemp("events"))
    for k in range(0, 300, 100):
        spark.createDataFrame(rows[k : k + 100], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return rows, spark.read.schema(SCHEMA).parquet(path), spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def drained(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(tuple, df.sparkSession.table(name).collect()))


def test_hourly(events, tmp_path):
    _, batch, stream = events
    assert drained(flows.hourly(stream), "hourly", "complete", tmp_path) == sorted(map(tuple, flows.hourly(batch).collect()))


def test_single_flight(events, tmp_path):
    rows, _, stream = events
    got = drained(flows.single_flight(stream).select("event_id", "user_id", "event_type"), "flights", "append", tmp_path)
    assert len({(u, t) for _, u, t in got}) == len({(r[2], r[3]) for r in rows}) and len(got) < len(rows)


def test_rate_limit(events, tmp_path):
    rows, batch, stream = events
    want, kept = [], {}
    for i, at, user, _, _ in rows:
        held = [t for t in kept.get(user, []) if t > at - timedelta(seconds=900)]
        ok = len(held) < 3
        kept[user] = held + [at] * ok
        want.append((user, i, ok))
    assert sorted(map(tuple, flows.rate_limited(batch, 3, 900).collect())) == sorted(want)
    assert drained(flows.rate_limited(stream, 3, 900), "limits", "append", tmp_path) == sorted(want)
