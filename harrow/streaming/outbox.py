"""A durable outbox as a state machine for each item: claims under a lease, retries with backoff, dead letters, leases taken back.

Events are (item long, seq long, at timestamp, kind, worker): ``enqueue``, ``claim``, ``beat``, ``success``, ``failure``. The same steps run over a batch
(a fold over each item's events in order) and over a stream (state with event-time timers, which take back leases that nobody ends).
An item is held by one worker at most: a claim is granted only if the item is pending, due, and not under a lease that still runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from harrow.operators.folds import ordered_fold

RESULT = "item bigint, at timestamp, seq bigint, outcome string, worker string, attempt int, due timestamp, leased_until timestamp"


@dataclass(frozen=True)
class Rules:
    """Seconds of a lease; retries until an item is dead; seconds before the first one, which double up to ``most_backoff``."""

    lease: float = 120
    max_retries: int = 3
    backoff: float = 1.0
    most_backoff: float = 300


class Item(NamedTuple):
    """Times are microseconds. ``until`` is null without a lease."""

    status: str = "none"
    attempt: int = 0
    due: int | None = None
    worker: str | None = None
    until: int | None = None


def expired(item: Item, us: int) -> bool:
    return item.until is not None and item.until < us


def released(item: Item) -> Item:
    return item._replace(worker=None, until=None)


def advance(item: Item, us: int, kind: str, worker: str | None, rules: Rules) -> tuple[Item, str]:
    """The item after an event and the event's outcome; a lease that ran out before it has been taken back already.

    A success, a failure or a beat of a worker that doesn't hold the item is stale. A queued item isn't queued again until it is done or dead.
    """
    holds = item.until is not None and item.worker == worker
    if kind == "enqueue":
        return (item, "ignored") if item.status == "pending" else (Item("pending", 0, us), "queued")
    if kind == "claim":
        if item.status != "pending" or item.until is not None or item.due > us:
            return item, "refused"
        return item._replace(worker=worker, until=us + int(max(30, rules.lease) * 1e6)), "claimed"
    if not holds:
        return item, "stale"
    if kind == "beat":
        return item._replace(until=us + int(max(30, rules.lease) * 1e6)), "extended"
    if kind == "success":
        return Item("done", item.attempt), "done"
    if kind == "failure":
        if item.attempt >= rules.max_retries:
            return Item("dead", item.attempt + 1), "dead"
        wait = min(rules.backoff * 2**item.attempt, rules.most_backoff)
        return Item("pending", item.attempt + 1, us + int(wait * 1e6)), "retry"
    return item, "ignored"


def _micros(events: DataFrame) -> DataFrame:
    return events.select("item", "seq", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "kind", "worker")


def _batch(events: DataFrame, rules: Rules, late: float) -> DataFrame:
    def step(item: Item, row: tuple) -> tuple[Item, tuple]:
        us, kind, worker = row
        back = item if expired(item, us) else None
        item, outcome = advance(released(item) if back else item, us, kind, worker, rules)
        return item, (outcome, item.attempt, item.due, item.worker, item.until, back and back.until, back and back.worker, back and back.attempt, back and back.due)

    gives = "outcome string, attempt int, due bigint, holder string, until bigint, back bigint, back_worker string, back_attempt int, back_due bigint"
    told = ordered_fold(_micros(events), ["item"], ["us", "seq"], gives, Item, step, ["us", "kind", "worker"])
    own = F.struct(F.col("us").alias("at"), F.col("seq"), F.col("outcome"), F.col("worker"), F.col("attempt"), F.col("due"), F.col("until"))
    reclaim = lambda at, worker, attempt, due: F.struct(F.col(at).alias("at"), F.lit(None).cast("bigint").alias("seq"), F.lit("reclaimed").alias("outcome"), F.col(worker).alias("worker"), F.col(attempt).alias("attempt"), F.col(due).alias("due"), F.lit(None).cast("bigint").alias("until"))
    last = F.lead("us").over(Window.partitionBy("item").orderBy("us", "seq")).isNull()
    end = _micros(events).agg((F.max("us") - int(late * 1e6)).alias("end"))
    told = told.withColumn("last", last).crossJoin(F.broadcast(end))  # one row
    rows = F.array(F.when(F.col("back").isNotNull(), reclaim("back", "back_worker", "back_attempt", "back_due")), own, F.when(F.col("last") & (F.col("until") < F.col("end")), reclaim("until", "holder", "attempt", "due")))
    return told.select("item", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("item", "r.*")


class _Outbox(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "status string, attempt int, due bigint, worker string, until bigint")

    def close(self) -> None:
        pass

    def _held(self) -> Item:
        return Item(*self.item.get()) if self.item.exists() else Item()

    def _keep(self, item: Item) -> None:
        """An ended item's state is a few bytes; timers follow the lease."""
        self.item.update(tuple(item))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if item.until is not None:
            self.handle.registerTimer(item.until // 1000 + 1)

    @staticmethod
    def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], *r) for r in rows], columns=["item", "at", "seq", "outcome", "worker", "attempt", "due", "until"])
        return out.astype({"item": "int64", "at": "Int64", "seq": "Int64", "attempt": "int32", "due": "Int64", "until": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        item, out = self._held(), []
        told = pd.concat(list(rows)).sort_values(["us", "seq"])
        for us, seq, kind, worker in zip(told["us"].tolist(), told["seq"].tolist(), told["kind"].tolist(), told["worker"].tolist(), strict=True):
            if expired(item, us):
                out.append((item.until, None, "reclaimed", item.worker, item.attempt, item.due, None))
                item = released(item)
            item, outcome = advance(item, us, kind, worker, self.rules)
            out.append((us, seq, outcome, worker, item.attempt, item.due, item.until))
        self._keep(item)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        item = self._held()
        if item.until is not None and item.until // 1000 < timerValues.getCurrentWatermarkInMs():
            self._keep(released(item))
            yield self._frame(key, [(item.until, None, "reclaimed", item.worker, item.attempt, item.due, None)])


def transitions(events: DataFrame, rules: Rules = Rules(), late: float = 0) -> DataFrame:
    """(item, at, seq, outcome, worker, attempt, due, leased_until): a row for each event, and one for each lease taken back (seq null, at its end).

    ``late`` is the stream's watermark in seconds; leases that end before the last event less ``late`` are taken back at the end of a batch.
    A stream needs the RocksDB state store and expects an item's events in order from file to file.
    """
    if events.isStreaming:
        marked = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", f"{late} seconds")
        rows = marked.select("item", "seq", "at", F.unix_micros("at").alias("us"), "kind", "worker")
        told = rows.groupBy("item").transformWithStateInPandas(_Outbox(rules), "item bigint, at bigint, seq bigint, outcome string, worker string, attempt int, due bigint, until bigint", "Append", "eventTime")
    else:
        told = _batch(events, rules, late)
    time = lambda c: F.timestamp_micros(F.col(c))
    return told.select("item", time("at").alias("at"), "seq", "outcome", "worker", "attempt", time("due").alias("due"), time("until").alias("leased_until"))


def claim(outbox: DataFrame, now: str, worker: str, limit: int = 10, lease: float = 120) -> DataFrame:
    """What one drain of a stored outbox takes: the ``limit`` longest due of the pending rows without a running lease, leased to the worker.

    Rows are (id, status, created_at, next_attempt_at, leased_by, leased_until). The limit, 200 at most, is the feature: no more than that is sorted together.
    """
    at = F.lit(now).cast("timestamp_ntz")
    free = (F.col("status") == "pending") & (F.coalesce("next_attempt_at", F.lit("0001-01-01").cast("timestamp_ntz")) <= at) & (F.col("leased_until").isNull() | (F.col("leased_until") < at))
    taken = outbox.where(free).orderBy(F.coalesce("next_attempt_at", "created_at"), "id").limit(max(1, min(limit, 200)))
    return taken.withColumns({"leased_by": F.lit(worker), "leased_until": at + F.make_dt_interval(secs=F.lit(max(30, int(lease))))})


def drained(outbox: DataFrame, taken: DataFrame) -> DataFrame:
    """The outbox after a drain: the taken rows in place of their former selves. ``taken`` holds 200 rows at most."""
    return outbox.join(F.broadcast(taken.select("id")), "id", "left_anti").select(*outbox.columns).unionByName(taken.select(*outbox.columns))
