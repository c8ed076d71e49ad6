"""Every registered query with a SQL twin equals DuckDB on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import rows_of
from fleetlens.plans import catalog

SMALL = "/root/testdata/sf0.001"

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()
FAST = sorted(n for n in ORACLE if not n.startswith(("ST1",)))


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SMALL)
    s_rows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(ORACLE[name])
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert rows_of(sdf.columns, s_rows, 6) == rows_of(d_cols, d_rows, 6)


def test_registry_shape():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 140
    for name in catalog.QUERIES:
        assert not name.lower().startswith("op")


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 15
    assert df.columns[:2] == ["activo_id", "patente"]
