import duckdb
import pytest

from lodestar.plans import catalogue
from lodestar.sources.files import TABLES


@pytest.fixture(scope="module")
def con(oracle_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{oracle_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_bag(spark, con, oracle_dir, name):
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
    got = catalogue.QUERIES[name](spark, oracle_dir)
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(r) for r in got.select(*sorted(got.columns)).collect()), key=str)
    assert rows == want
    assert rows or name in ("q6_empty", "one_agg_global_nonempty")
