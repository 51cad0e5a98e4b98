"""Every query with SQL gives that SQL's rows; the package works without the optional folder."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quarryline.plans import registry

DATA = Path("/root/testdata/sf0.001")
@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    df = registry.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(cols)
    rows = lambda data: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in data)
    assert rows(df.select(*cols).collect()) == rows(want.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", ["locate_reflowed", "table_twins", "diagnose_citation", "ablation_report", "chunk_stats", "citation_causes"])
def test_queries_without_sql_give_rows(spark, name):
    rows = registry.queries()[name](spark, str(DATA)).collect()
    assert rows
    if name == "locate_reflowed":
        assert all(r["span_start"] is not None for r in rows)
    if name == "citation_causes":
        assert sum(r["n"] for r in rows) == registry.queries()["diagnose_citation"](spark, str(DATA)).count()


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], timeout=120)
