"""Every query against its SQL oracle over the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from quorate.plans import catalog  # noqa: E402

SF = os.environ.get("QUORATE_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted([plain(v) for v in row] for row in df.select(names).collect())
    if name not in catalog.ORACLE:
        assert got
        return
    found = oracle.execute(catalog.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert got == sorted([plain(row[i]) for i in order] for row in found.fetchall())
