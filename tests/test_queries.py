"""Every query that has SQL against DuckDB; the package without its llm part."""

import math
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(name, spark, sf, duck):
    found = catalog.queries()[name](spark, sf)
    columns = sorted(found.columns)
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_library_does_not_import_llm():
    code = "import sys, millrace.catalog; sys.exit(any(m.startswith('millrace.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
