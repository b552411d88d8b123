"""Every query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


def shown(rows, cols):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    text = lambda v: "-" if v is None else repr(v) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "lineitem", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, duck, name):
    want = duck.execute(registry.oracle_sql()[name])
    cols, want = [d[0] for d in want.description], want.fetchall()
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert shown(got.collect(), got.columns) == shown(want, cols)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(NAMES)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
