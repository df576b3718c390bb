"""Every registered query against its SQL in DuckDB, at the smallest scale; the entry point without the optional part."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from strandline.plans import registry

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    if name not in registry.SQL:
        assert rows
        return
    want = db.sql(registry.SQL[name])
    assert sorted(want.columns) == columns
    assert {k: TYPES[v] for k, v in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert rows == sorted(map(str, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_entry_without_the_optional_operators(tmp_path):
    """The entry module imports and has the other queries when the optional package is not there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(root):
        if name not in (".git", "corpus_pipeline.py", "strandline", "tests"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    (tmp_path / "strandline").mkdir()
    for name in os.listdir(f"{root}/strandline"):
        if name != "llm":
            os.symlink(f"{root}/strandline/{name}", tmp_path / "strandline" / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    n, m, ops = map(int, out.stdout.split())
    assert n == len(registry.QUERIES) and m == len(registry.SQL) and ops == 0, out.stderr
