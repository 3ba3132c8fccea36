"""Relational operators: tenant scope, latest rows, first-seen duplicates, roll-ups, intervals and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(df: DataFrame, org: int, column: str = "org_id") -> DataFrame:
    """The mandatory tenant predicate."""
    return df.where(F.col(column) == F.lit(org))


def filtered(df: DataFrame, **wanted: object) -> DataFrame:
    """A conjunction over the parameters that are present: None means no restriction, a list means membership."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == F.lit(value))
    return df


def enabled(column: str) -> Column:
    """True or unknown counts as enabled."""
    return F.coalesce(F.col(column), F.lit(True))


def email_key(column: str) -> Column:
    return F.lower(F.trim(F.col(column)))


def since(column: str, now: str, **parts: int) -> Column:
    """Later than ``now`` less an interval (days=, hours=, mins=)."""
    interval = F.make_dt_interval(*[F.lit(parts.get(p, 0)) for p in ("days", "hours", "mins")])
    return F.col(column) > F.lit(now).cast("timestamp_ntz") - interval


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first of the order, which has to end in a unique column."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def mark_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Derive is_latest, which a mutable table would demote and set."""
    return df.withColumn("is_latest", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def mark_duplicates(df: DataFrame, content: str, key: str) -> DataFrame:
    """duplicate_of: the smallest key with the same content; null for that one itself and for null contents."""
    first = F.min(key).over(Window.partitionBy(content))
    return df.withColumn("duplicate_of", F.when(F.col(content).isNotNull() & (F.col(key) != first), first))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def keep_first(df: DataFrame, keys: Sequence[str], values: str, normal: Column | None = None) -> DataFrame:
    """Distinct values of an array column by a normal form, in order of first appearance: (keys, position, value)."""
    rows = df.select(*keys, F.posexplode(values).alias("position", "value")).withColumn("_normal", F.lower(F.trim("value")) if normal is None else normal)
    first = F.row_number().over(Window.partitionBy(*keys, "_normal").orderBy("position"))
    return rows.where("_normal <> ''").withColumn("_first", first).where("_first = 1").drop("_first", "_normal")


def anti_with_stubs(expected: DataFrame, found: DataFrame, key: str, **stub: Column) -> DataFrame:
    """``found`` and a stub row for every expected key without a row."""
    missing = expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti").select(key, *[c.alias(n) for n, c in stub.items()])
    return found.unionByName(missing, allowMissingColumns=True)


def merge_columns(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Select-then-update-or-insert: every column of ``delta`` that isn't null wins over the base's."""
    values = [c for c in base.columns if c not in keys]
    right = delta.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    return base.join(right, list(keys), "full").select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in values])


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of ``delta`` replace those of their key; of several in ``delta``, the first of the order."""
    return base.join(delta.select(*keys).distinct(), list(keys), "left_anti").unionByName(latest_per_key(delta, keys, order))


def insert_absent(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of ``delta`` whose key the base doesn't have are added."""
    return base.unionByName(latest_per_key(delta, keys, order).join(base.select(*keys), list(keys), "left_anti"))


def free_slots(slots: DataFrame, busy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slots (start, end) that overlap no busy interval of their key: start < busy end and end > busy start.

    The overlap is an equi-join on key and day with the interval as the residual, so neither side is broadcast whole.
    """
    days = F.explode(F.sequence(F.to_date("start"), F.to_date("end")))
    left = slots.select("*", days.alias("_day"))
    right = busy.select(*keys, F.col("start").alias("_from"), F.col("end").alias("_to"), days.alias("_day"))
    hit = left.join(right, [*keys, "_day"]).where("start < _to and end > _from").select(*keys, "start", "end").distinct()
    return slots.join(hit, [*keys, "start", "end"], "left_anti")


def slot_grid(days: DataFrame, day: str, first_hour: int = 10, last_hour: int = 17) -> DataFrame:
    """One-hour slots of the weekdays among the days."""
    weekdays = days.where(~F.dayofweek(day).isin(1, 7))
    hours = weekdays.select("*", F.explode(F.sequence(F.lit(first_hour), F.lit(last_hour - 1))).alias("_hour"))
    start = F.col(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("_hour"))
    return hours.select(*[c for c in hours.columns if c != "_hour"], start.alias("start"), (start + F.make_dt_interval(F.lit(0), F.lit(1))).alias("end"))


def next_ids(existing: DataFrame, new: DataFrame, prefix: str, column: str, order: Sequence[Column], bucket: Column, width: int = 3) -> DataFrame:
    """Ids after the largest numeric suffix of the prefix, in the order given; suffixes that aren't numbers are ignored.

    ``bucket`` never falls along the order: rows are numbered within their buckets, after the rows of the buckets before. Only buckets are summed in one task.
    """
    top = existing.where(F.col(column).startswith(prefix)).agg(F.coalesce(F.max(F.expr(f"try_cast(substr({column}, {len(prefix) + 1}) as bigint)")), F.lit(0)).alias("_top"))
    dealt = new.withColumn("_bucket", bucket)
    before = F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("_bucket").count().select(F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_offset"))
    numbered = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))).join(offsets, F.col("_bucket").eqNullSafe(F.col("_b"))).crossJoin(F.broadcast(top))  # one row
    return numbered.withColumn(column, F.concat(F.lit(prefix), F.lpad((F.col("_n") + F.col("_offset") + F.col("_top")).cast("string"), width, "0"))).drop("_n", "_top", "_bucket", "_b", "_offset")


def half_up_percent(part: Column, whole: Column) -> Column:
    """100 part / whole rounded half up, in whole numbers; 0 without a whole."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.expr("0L") + F.floor((part * 200 + whole) / (whole * 2)))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all cores by their keys, before much is computed from each: short rows compress to few megabytes, which are one task's to read."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)
