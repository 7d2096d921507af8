"""Every query that has SQL gives the SQL's rows, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumenrec.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    assert cols == sorted(db.sql(catalogue.oracle_sql()[name]).columns)
    got = sorted("|".join(map(norm, r)) for r in df.select(*cols).collect())
    want = sorted("|".join(map(norm, r)) for r in db.sql(f"SELECT {', '.join(cols)} FROM ({catalogue.oracle_sql()[name]})").fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows_only_queries_are_repeatable(spark, name):
    q = catalogue.queries()[name]
    rows = sorted(map(str, q(spark, DATA).collect()))
    assert rows
    if name in ("bertscore_like", "export_topk", "ranker_metrics"):
        assert rows == sorted(map(str, q(spark, DATA).collect()))
