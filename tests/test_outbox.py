"""The outbox as a batch, as a stream that is stopped and goes on, and against a plain loop."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from harrow.streaming import outbox

SCHEMA = "item long, seq long, at timestamp, kind string, worker string"
RULES = outbox.Rules(lease=300, max_retries=2, backoff=60, most_backoff=200)
FILES = 5


def history():
    """Events of 12 items in time order, and a last one an hour later."""
    rng, at, rows = random.Random(11), datetime(2024, 1, 1), []
    for i in range(500):
        at += timedelta(seconds=rng.choice([1, 5, 20, 40]))
        rows.append((rng.randrange(12), i, at, rng.choice(["enqueue", "claim", "claim", "beat", "success", "failure", "failure"]), rng.choice("ab")))
    return [*rows, (99, 500, at + timedelta(hours=1), "enqueue", "a")]


def plain(rows):
    """(item, at, seq, outcome, attempt) by the rules written out."""
    out, held = [], {}
    end = max(r[2] for r in rows)
    for item, seq, at, kind, worker in rows:
        s = held.setdefault(item, {"status": "none", "n": 0, "due": None, "by": None, "until": None})
        if s["until"] and s["until"] < at:
            out.append((item, s["until"], None, "reclaimed", s["n"]))
            s.update(by=None, until=None)
        mine = s["until"] is not None and s["by"] == worker
        if kind == "enqueue":
            what = "ignored" if s["status"] == "pending" else "queued"
            if what == "queued":
                s.update(status="pending", n=0, due=at)
        elif kind == "claim":
            what = "claimed" if s["status"] == "pending" and not s["until"] and s["due"] <= at else "refused"
            if what == "claimed":
                s.update(by=worker, until=at + timedelta(seconds=300))
        elif not mine:
            what = "stale"
        elif kind == "beat":
            what = "extended"
            s.update(until=at + timedelta(seconds=300))
        elif kind == "success":
            what = "done"
            s.update(status="done", by=None, until=None)
        else:
            what = "dead" if s["n"] >= 2 else "retry"
            s.update(status="dead" if what == "dead" else "pending", due=at + timedelta(seconds=min(200, 60 * 2 ** s["n"])), by=None, until=None, n=s["n"] + 1)
        out.append((item, at, seq, what, s["n"]))
    return Counter(out + [(i, s["until"], None, "reclaimed", s["n"]) for i, s in held.items() if s["until"] and s["until"] < end])


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows, path = history(), str(tmp_path_factory.mktemp("outbox"))
    step = -(-len(rows) // FILES)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return rows, path


def facts(df):
    return Counter((r.item, r.at, r.seq, r.outcome, r.attempt) for r in df.collect())


def test_batch(spark, stored):
    rows, path = stored
    got = facts(outbox.transitions(spark.read.parquet(path), RULES))
    assert got == plain(rows)
    assert {"reclaimed", "dead", "retry", "claimed", "refused", "stale", "done", "extended"} <= {k[3] for k in got}


def test_stream_equals_batch_after_a_restart(spark, stored, tmp_path):
    rows, path = stored
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def start(**trigger):
        return outbox.transitions(source, RULES).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(**trigger).start()

    first = start(processingTime="0 seconds")  # stopped on the way
    while not first.recentProgress and first.isActive:
        pass
    first.stop()
    rest = start(availableNow=True)
    rest.awaitTermination(180)
    assert rest.exception() is None
    assert facts(spark.read.parquet(out)) == facts(outbox.transitions(spark.read.parquet(path), RULES))


def test_two_workers_never_take_the_same(spark):
    day = lambda n: datetime(2024, 1, n)
    rows = [(i, "pending", day(1 + i % 5), None, None, None) for i in range(20)] + [(20, "pending", day(1), day(9), None, None), (21, "done", day(1), None, None, None), (22, "pending", day(1), day(2), "c", day(3)), (23, "pending", day(1), None, "c", day(8))]
    table = spark.createDataFrame(rows, "id long, status string, created_at timestamp_ntz, next_attempt_at timestamp_ntz, leased_by string, leased_until timestamp_ntz")
    a = outbox.claim(table, "2024-01-07", "a", limit=6)
    after = outbox.drained(table, a)
    b = outbox.claim(after, "2024-01-07 00:01:00", "b", limit=50)
    mine, other = {r.id for r in a.collect()}, {r.id for r in b.collect()}
    assert len(mine) == 6 and not mine & other and mine | other == {*range(20), 22}
    assert after.count() == table.count()
    again = {r.id for r in outbox.claim(outbox.drained(after, b), "2024-01-07 00:02:30", "c", limit=50).collect()}
    assert again == mine  # their leases ended first


def test_no_events(spark):
    assert outbox.transitions(spark.createDataFrame([], SCHEMA)).count() == 0
