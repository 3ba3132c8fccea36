"""Every query with SQL against DuckDB on the same tables, rows as multisets; every other one runs."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest

from harrow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "null" if value != value else f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.9g}" if value % 1 else str(int(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return "null" if value is None else str(value)


@pytest.fixture(scope="session")
def duck(tiny):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{tiny}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, tiny, name):
    got = registry.queries()[name](spark, tiny)
    rows = got.collect()
    if name not in registry.oracle_sql():
        assert rows
        return
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == want
