"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import duckdb
import pytest

from evidra.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return int(v) if v == int(v) else f"{v:.9g}"
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    rows = sorted((tuple(cell(r[c]) for c in columns) for r in out.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert rows
        return
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    wanted = sorted((tuple(cell(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert len(rows) == len(wanted)
    assert rows == wanted


def test_rules_for_queries(spark):
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert len(ORACLE_SQL) >= 50
