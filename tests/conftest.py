import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from orderloom.session import build_session

    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a DataFrame has the rows of a SQL statement."""

    def check(df, sql):
        cols = sorted(df.columns)
        got = sorted(tuple(norm(v) for v in r) for r in df.select(cols).collect())
        res = duck.execute(sql)
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
        assert got == want

    return check
