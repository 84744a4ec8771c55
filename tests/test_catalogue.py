"""The catalogue against DuckDB on the smallest tables, where they lie here; and that the library does without the subpackage llm."""

import glob
import os
import subprocess
import sys

import pytest

from lectorium.plans import catalogue

DATA = "/root/testdata/sf0.001"
TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


def test_each_has_its_sql():
    assert catalogue.QUERIES.keys() == catalogue.ORACLES.keys()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows(spark, tables, name):
    found = catalogue.QUERIES[name](spark, DATA)
    cursor = tables.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(names)
    plain = lambda x: round(float(x), 9) if isinstance(x, float) else int(x) if isinstance(x, bool) else x
    ours = sorted(str([plain(v) for v in r]) for r in found.select(names).collect())
    assert ours == sorted(str([plain(v) for v in r]) for r in cursor.fetchall())


def test_without_training_data_operators():
    code = "import sys; sys.modules['lectorium.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'filter_all' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=TOP, check=True)


def test_nothing_else_imports_them():
    for path in glob.glob(f"{TOP}/lectorium/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "llm" not in open(path).read()
