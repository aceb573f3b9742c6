"""Every query that has an SQL twin against DuckDB, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from echoframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.load()[1]))
def test_twin(name, spark, sql, sf_dir):
    queries, oracles = catalog.load()
    got = queries[name](spark, sf_dir)
    want = sql.sql(oracles[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    other = sorted((tuple(r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall()), key=str)
    assert len(rows) == len(other) and len(rows) > 0
    for a, b in zip(rows, other, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y, rel=1e-9, abs=1e-9) if isinstance(x, float) and y is not None else x == y


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["median", "p90", "mean", "above_half", "above_seven_tenths"] and out.count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_text_subpackage():
    import subprocess
    import sys

    code = "import sys; from echoframe.plans import catalog; catalog.load(); import echoframe.operators.lines, echoframe.operators.formation; print(any('echoframe.llm' in m for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.__file__.rsplit("/", 1)[0]).stdout.strip() == "False"
