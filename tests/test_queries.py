"""Every registered query of the graph operators against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from quiverlake import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    want = con.sql(Q.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def compare(spark, name, folder):
    """A query and its SQL over the tables in a folder, column by column."""
    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from read_parquet('{file}')")
    want = con.sql(Q.ORACLE_SQL[name])
    df = Q.QUERIES[name](spark, str(folder))
    assert sorted(df.columns) == sorted(want.columns)
    return sorted(tuple(r) for r in df.select(*want.columns).collect()), sorted(want.fetchall())


@pytest.mark.parametrize("name", ["bfs_distances", "bfs_parents"])
def test_bfs_ends_where_its_sql_does(spark, tmp_path, name):
    """A chain of 16 parts, two an order: the last three are farther from part 0 than the SQL looks."""
    con = duckdb.connect()
    con.sql(f"copy (select i::BIGINT as p_partkey from range(16) t(i)) to '{tmp_path}/part.parquet'")
    orders = "i::BIGINT as o_orderkey, 'O' as o_orderstatus, 1.0 as o_totalprice, TIMESTAMP '1995-01-01' as o_orderdate, 'x' as o_orderpriority"
    con.sql(f"copy (select {orders} from range(15) t(i)) to '{tmp_path}/orders.parquet'")
    lines = "i::BIGINT as l_orderkey, (i + j)::BIGINT as l_partkey, j::INT as l_linenumber, 1.0 as l_quantity, 1.0 as l_extendedprice, 'N' as l_returnflag"
    con.sql(f"copy (select {lines} from range(15) t(i), range(2) u(j)) to '{tmp_path}/lineitem.parquet'")
    got, want = compare(spark, name, tmp_path)
    assert got == want and len(got) == 16


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_names_the_optional_subpackage():
    from pathlib import Path

    root = Path(Q.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and ".llm" in p.read_text()]
