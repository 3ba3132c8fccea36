"""The as-of join of captures with list intervals against a plain loop."""

import random
from datetime import datetime, timedelta

from harrow.llm import url_filter

DAY = datetime(2024, 1, 1)


def listed(entries, host, at):
    """The most specific listed key and since when, or None."""
    labels = host.split(".")
    for k in ([host] if len(labels) < 2 else [".".join(labels[i:]) for i in range(len(labels) - 1)]):
        since = None
        times = sorted({(e[2], e[1]) for e in entries if e[0] == k and e[1] in ("add", "remove") and e[2] is not None and e[2] <= at})
        for t in sorted({t for t, _ in times}):
            action = "remove" if (t, "remove") in times else "add"
            since = None if action == "remove" else since or t
        if since is not None:
            return k, since
    return None


def test_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "FEW", 3)
    test_against_a_loop(spark)


def test_long_urls(spark):
    long = "http://" + ".".join(["label"] * 400) + ".a.com/" + "p" * 200_000
    e = spark.createDataFrame([("a.com", "add", DAY)], "key string, action string, at timestamp")
    c = spark.createDataFrame([(1, long, DAY), (2, "http://" + "x" * 100_000, DAY), (3, "http://" + "." * 50, DAY)], "capture_id bigint, url string, fetched_at timestamp")
    got = {r.capture_id: (r.blocked, r.matched_key) for r in url_filter.evaluate(c, e).collect()}
    assert got == {1: (True, "a.com"), 2: (False, None), 3: (False, None)}


def test_against_a_loop(spark):
    rng = random.Random(9)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "c.b.org", "single", "d.net"]
    entries = [(rng.choice(hosts), rng.choice(["add", "remove"]), DAY + timedelta(days=rng.randrange(300))) for _ in range(80)]
    entries += [(None, "add", DAY), ("d.net", "odd", DAY), ("d.net", "add", None)]
    captures = [(i, f"https://user@{rng.choice(hosts).upper()}:8080/p?q=http://b.org", DAY + timedelta(hours=rng.randrange(24 * 320))) for i in range(400)]
    captures += [(500, None, DAY), (501, "no url", DAY), (502, "http://a.com./", None), (None, "http://a.com/", DAY + timedelta(days=200)), captures[0], captures[0]]
    e = spark.createDataFrame([(*x, 1) for x in entries], "key string, action string, at timestamp, host int")
    c = spark.createDataFrame([(*x, 1) for x in captures], "capture_id bigint, url string, fetched_at timestamp, key int")
    got = url_filter.evaluate(c, e).collect()
    want = []
    for k, url, at in captures:
        host = url.split("//")[1].split("/")[0].split("@")[-1].split(":")[0].rstrip(".").lower() if url and "//" in url else None
        hit = listed(entries, host, at) if host and at else None
        want.append((k, host, hit is not None, *(hit or (None, None))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any(r.blocked for r in got) and not all(r.blocked for r in got)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "key string, action string, at timestamp")
    c = spark.createDataFrame([(1, "http://a.com/", DAY)], "capture_id bigint, url string, fetched_at timestamp")
    assert [r.blocked for r in url_filter.evaluate(c, e).collect()] == [False]
    assert url_filter.evaluate(c.limit(0), e).count() == 0
    p = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_filter.filter_pages(p).count() == 0
