import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CORE = {n: q for m in entry._MODULES for n, q in __import__(m, fromlist=["QUERIES"]).QUERIES.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    one = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(map(repr, ([one(r[i]) for i in order] for r in rows)))


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_sql(spark, name):
    df = CORE[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for path in glob.glob(f"{FOLDER}/*.parquet"):
            con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
        cursor = con.execute(sql)
        assert got == rows_of([c[0] for c in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
