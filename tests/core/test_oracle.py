"""Every query that SQL can express gives the rows of its SQL twin."""

import decimal
import os

import duckdb
import pytest

from itemlab.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Queries whose results another test holds against all pairs: test_operators.test_rejected_similarity_against_all_pairs.
WITHOUT_SQL = {"rejected_similarity"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return round(float(v), 9) if isinstance(v, float | decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    if name not in ORACLE_SQL:
        assert name in WITHOUT_SQL
        return
    found = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=str)
    assert got == want
