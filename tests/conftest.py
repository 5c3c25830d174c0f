import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sumac.runtime import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session("tests")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a query and its SQL give the same rows on the smallest data."""

    def check(f, sql):
        df = f(spark, SMALL)
        cur = duck.execute(sql)
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns)
        norm = lambda rows, names: sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in rows)
        assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), cols)

    return check
