"""Every query of the catalogue against its SQL, at the smallest size."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import pytest

from lamella import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{v.normalize():f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got
    if name in catalogue.ORACLE_SQL:
        out = con.execute(catalogue.ORACLE_SQL[name])
        have = [d[0] for d in out.description]
        assert sorted(have) == names
        assert got == sorted(tuple(plain(r[have.index(c)]) for c in names) for r in out.fetchall())


def test_unsigned_and_char_keeps_numbers_beyond_u64(spark, tmp_path):
    keys = [0, 551_614, 551_615, 551_616, 899_999, 2**63 - 1]  # 551,615 makes the largest u64
    orders = f"'{tmp_path}/orders.parquet'"
    con = duckdb.connect()
    con.execute(f"copy (select i::bigint as o_orderkey, k::bigint as o_custkey, 'F' as o_orderstatus from (select unnest(range({len(keys)})) i, unnest({keys}) k)) to {orders}")
    con.execute(f"create view orders as select * from {orders}")
    got = catalogue.QUERIES["unsigned_and_char"](spark, str(tmp_path)).select("key", "big", "code").collect()
    assert sorted((r["key"], int(r["big"]), r["code"]) for r in got) == sorted((a, int(b), c) for a, b, c in con.execute(catalogue.ORACLE_SQL["unsigned_and_char"]).fetchall())
    assert max(int(r["big"]) for r in got) == 2**63 - 1 + 18446744073709000000


def test_entry_registers_without_the_optional_folder(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_optional", lambda name: None)
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.ORACLE_SQL)
