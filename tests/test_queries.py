"""Every query against its SQL in DuckDB, on the smallest tables."""

import ast
import datetime
import math
import os
import shutil
import subprocess
import sys

import pytest

from landshift.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLES])
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted(tuple(_plain(v) for v in r) for r in df.select(*columns).collect())
    assert rows == sorted(tuple(_plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).columns) == 3


@pytest.mark.parametrize("gone", [("landshift/llm",), ("corpus_pipeline.py",), ("landshift/llm", "corpus_pipeline.py")])
def test_without_the_optional_part(tmp_path, gone):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "tests", "__pycache__") or os.path.relpath(os.path.join(folder, n), root) in gone])
    code = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True).stdout.splitlines()
    named, held = (set(ast.literal_eval(line)) for line in out[-2:])
    assert set(catalogue.QUERIES) <= named and set(catalogue.ORACLES) <= held and held <= named and "pipeline" not in named
