"""A sample of the registered queries against their SQL twins; tools/check_oracles.py runs all of them."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
SAMPLE = (
    "mode_intervals", "status_hold", "continuity", "aligned_wide", "asof_bounded", "inventory_scopes", "timing_stats",
    "overlap_duration", "invalid_spans", "readiness", "field_catalog", "rule_leakage",
)
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("no test data")
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if r[i] is None or r[i] != r[i] else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_twin(spark, con, name):
    df = entry.queries()[name](spark, str(DATA))
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(df.columns, df.collect()) == normal(want.columns, want.fetchall())


def test_every_query_but_one_has_a_twin():
    plain = {q for q in set(entry.queries()) - set(entry.oracle_sql()) if q != "pipeline" and not q.startswith("op")}
    assert plain == set()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
