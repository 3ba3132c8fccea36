"""Structured Streaming flows: hourly windows, de-duplication within a time, rate limits by key.

Each takes a streaming (or batch) DataFrame of events (event_id, ts timestamp, user_id, event_type) and returns one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame) -> DataFrame:
    """Event time as an instant: watermarks don't take timestamps without a zone."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(df: DataFrame, late: str = "2 hours") -> DataFrame:
    """Count and mean value of each hour and type; rows later than the watermark are dropped by a stream."""
    windowed = event_time(df).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def single_flight(df: DataFrame, ttl: str = "90 seconds") -> DataFrame:
    """One row of each (user, type) in a time: later ones join the first."""
    return event_time(df).withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def limit_hits(times: list[float], kept: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which of the ordered times are let through when at most ``limit`` lie in any window before them; refused ones don't count."""
    allowed = []
    for t in times:
        kept = [k for k in kept if k > t - seconds]
        allowed.append(len(kept) < limit)
        if allowed[-1]:
            kept = [*kept, t]
    return allowed, kept


def rate_limited(df: DataFrame, limit: int, seconds: float) -> DataFrame:
    """(user_id, event_id, allowed) by a sliding window of each user. A batch sorts a user's events; a stream keeps at most ``limit`` times as state."""
    rows = event_time(df).select("user_id", "event_id", F.unix_micros("ts").alias("us"))
    if not df.isStreaming:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["us", "event_id"])
            return pdf.assign(allowed=limit_hits((pdf["us"] / 1e6).tolist(), [], limit, seconds)[0])[["user_id", "event_id", "allowed"]]

        return rows.groupBy("user_id").applyInPandas(run, "user_id long, event_id long, allowed boolean")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["us", "event_id"])
        kept = list(state.get[0]) if state.exists else []
        allowed, kept = limit_hits((pdf["us"] / 1e6).tolist(), kept, limit, seconds)
        state.update((kept,))
        yield pdf.assign(allowed=allowed)[["user_id", "event_id", "allowed"]]

    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean", "kept array<double>", "append", "NoTimeout")
