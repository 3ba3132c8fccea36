"""URL filters: a temporal join of captures with dated list entries.

Entries (key, action, at) become validity intervals per key; a capture is blocked if, when it was fetched, an interval of its
host or of a parent domain was open. The join is an equi-join on key and month with the interval as the residual; hot keys are dealt in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key and month of more than one in so many of all probes (and FEW probes) is hot: its probes are dealt in parts. There are SHARE of them at most.
SHARE, FEW = 1000, 4096


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port or a trailing dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels at least."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, valid_from, valid_to): when each key was listed. entries: key, action ('add' or 'remove'), at (timestamp).

    Of several entries of a key at one time, 'remove' holds. Adding twice changes nothing; an open interval has a null
    end. Entries with a null key or time, or another action, are ignored.
    """
    known = entries.where("key is not null and at is not null and action in ('add', 'remove')").groupBy("key", "at").agg(F.max("action").alias("action"))
    by_key = Window.partitionBy("key").orderBy("at")
    turns = known.withColumn("before", F.lag("action").over(by_key)).where("action <> coalesce(before, 'remove')")
    return turns.select("key", "action", F.col("at").alias("valid_from"), F.lead("at").over(by_key).alias("valid_to")).where("action = 'add'").drop("action")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(capture_id, host, blocked, matched_key, listed_since) of each capture (capture_id, url, fetched_at).

    matched_key is the most specific listed key. A url that is null or has no host, and a null time, match nothing. Repeated
    captures give repeated rows; without entries nothing is blocked; other columns of both tables are ignored.
    """
    listed = intervals(entries)
    ends = captures.agg(F.min("fetched_at").alias("first"), F.max("fetched_at").alias("last"))
    clipped = listed.join(F.broadcast(ends), on=F.expr("valid_from <= last and (valid_to is null or valid_to > first)"))  # one row
    months = F.sequence(F.trunc(F.greatest("valid_from", "first"), "MM"), F.trunc(F.least(F.coalesce("valid_to", "last"), "last"), "MM"), F.expr("interval 1 month"))
    held = clipped.select("key", "valid_from", "valid_to", F.explode(months).alias("month"))
    base = captures.select("capture_id", "url", "fetched_at").withColumn("host", host_of(F.col("url")))
    # one probe for each capture, host suffix and time; equal captures (same id, host, time) are probed once
    probes = base.where("host is not null and fetched_at is not null").select("capture_id", "host", "fetched_at").distinct()
    asked = probes.select("*", F.explode(suffixes(F.col("host"))).alias("key"), F.trunc("fetched_at", "MM").alias("month"))
    # the captures of a hot key are dealt in parts and its intervals repeated for them; no other key's are
    counts = asked.groupBy("key", "month").agg(F.count("*").alias("n"))
    fair = F.greatest(F.lit(FEW), F.ceil(F.col("all") / SHARE))
    hot = counts.join(F.broadcast(counts.agg(F.sum("n").alias("all"))), F.col("n") > fair).select("key", "month", F.ceil(F.col("n") / fair).cast("long").alias("parts"))  # one row is broadcast
    parts, one = F.coalesce("parts", F.lit(1).cast("long")), F.broadcast(hot)  # at most SHARE rows for each label of a host
    dealt = asked.join(one, ["key", "month"], "left").withColumn("part", F.pmod(F.xxhash64("capture_id"), parts)).drop("parts")
    spread = held.join(one, ["key", "month"], "left").select("key", "month", "valid_from", "valid_to", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    hits = dealt.join(spread, ["key", "month", "part"]).where("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    best = hits.groupBy("capture_id", "host", "fetched_at").agg(F.max(F.struct(F.length("key").alias("size"), "key", "valid_from")).alias("top"))
    named = best.select(F.col("capture_id").alias("_id"), F.col("host").alias("_host"), F.col("fetched_at").alias("_at"), "top")
    on = F.col("capture_id").eqNullSafe(F.col("_id")) & (F.col("host") == F.col("_host")) & (F.col("fetched_at") == F.col("_at"))
    return base.join(named, on, "left").select("capture_id", "host", F.col("top").isNotNull().alias("blocked"), F.col("top.key").alias("matched_key"), F.col("top.valid_from").alias("listed_since"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, which has no times: page p was fetched 37 p hours into a 365-day year from 2024-01-01."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.expr("timestamp_seconds(1704067200 + pmod(page_id * 37, 8760) * 3600)").alias("fetched_at"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages: every host whose MD5 begins with 0-5 is added on a day that the digest's
    next digits name, removed 16 to 271 days later, and, for 0-2, added again 30 days after that. Hosts named spam-farm or
    cheap-pills, and their parents, are listed throughout."""
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key is not null").distinct()
    digest = F.md5("key")
    number = lambda at: F.conv(F.substring(digest, at, 2), 16, 10).cast("long")
    day = lambda d: F.timestamp_seconds(F.lit(1704067200) + d * 86400)
    added, removed = number(2), number(2) + 16 + number(4)
    picked = hosts.where(F.substring(digest, 1, 1).between("0", "5"))
    events = F.array(
        F.struct(F.lit("add").alias("action"), day(added).alias("at")),
        F.struct(F.lit("remove").alias("action"), day(removed).alias("at")),
        F.struct(F.when(F.substring(digest, 1, 1).between("0", "2"), "add").alias("action"), day(removed + 30).alias("at")),
    )
    dated = picked.select("key", F.explode(events).alias("e")).select("key", "e.action", "e.at").where("action is not null")
    standing = hosts.where(F.col("key").rlike("spam-farm|cheap-pills")).select("key", F.lit("add").alias("action"), F.to_timestamp(F.lit("2023-01-01")).alias("at"))
    return dated.unionByName(standing)


def filter_pages(pages: DataFrame) -> DataFrame:
    return evaluate(page_captures(pages), page_entries(pages)).withColumnRenamed("capture_id", "page_id")


ORACLE_SQL = r"""
WITH base AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '') AS host,
         TIMESTAMP '2024-01-01' + to_hours(CAST((page_id * 37) % 8760 AS INTEGER)) AS fetched_at
  FROM pages),
hosts AS (SELECT DISTINCT host AS key, md5(host) AS d FROM base WHERE host IS NOT NULL),
num AS (SELECT key, substr(d, 1, 1) AS c, CAST('0x' || substr(d, 2, 2) AS INTEGER) AS a, CAST('0x' || substr(d, 4, 2) AS INTEGER) AS b FROM hosts),
iv AS (
  SELECT key, TIMESTAMP '2024-01-01' + to_days(a) AS valid_from, TIMESTAMP '2024-01-01' + to_days(a + 16 + b) AS valid_to FROM num WHERE c BETWEEN '0' AND '5'
  UNION ALL SELECT key, TIMESTAMP '2024-01-01' + to_days(a + 46 + b), NULL FROM num WHERE c BETWEEN '0' AND '2'),
standing AS (SELECT key, TIMESTAMP '2023-01-01' AS valid_from FROM hosts WHERE regexp_matches(key, 'spam-farm|cheap-pills')),
merged AS (
  SELECT key, valid_from, valid_to FROM iv WHERE key NOT IN (SELECT key FROM standing)
  UNION ALL SELECT key, valid_from, NULL FROM standing WHERE key NOT IN (SELECT key FROM iv)
  UNION ALL SELECT s.key, s.valid_from, min(iv.valid_to) FROM standing s JOIN iv USING (key) GROUP BY ALL
  UNION ALL SELECT iv.key, iv.valid_from, iv.valid_to FROM iv JOIN standing USING (key) WHERE iv.valid_to IS NULL),
hit AS (
  SELECT b.page_id, arg_max(m.key, length(m.key)) AS matched_key, arg_max(m.valid_from, length(m.key)) AS listed_since
  FROM base b JOIN merged m ON (b.host = m.key OR (suffix(b.host, '.' || m.key))) AND b.fetched_at >= m.valid_from AND (m.valid_to IS NULL OR b.fetched_at < m.valid_to)
  GROUP BY b.page_id)
SELECT b.page_id, b.host, h.page_id IS NOT NULL AS blocked, h.matched_key, h.listed_since FROM base b LEFT JOIN hit h USING (page_id)
"""
