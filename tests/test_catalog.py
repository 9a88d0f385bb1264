"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from docledger.plans import library
from docledger.plans.catalog import QUERIES

library.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v

    return sorted(([one(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    query = QUERIES[name]
    found = query.run(spark, SF)
    rows = found.collect()
    if query.sql is None:
        assert rows
        return
    answer = duck.execute(query.sql)
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(found.columns)
    assert repr(plain(rows, found.columns)) == repr(plain(answer.fetchall(), columns))
