"""The driver contract, with and without the optional subpackage; SQL against the engine at the smallest size."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from seqloom import catalog
from verify_oracle import connect, frame

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    con: duckdb.DuckDBPyConnection = connect(SMALL)
    got, want = frame(catalog.QUERIES[name](spark, SMALL).toPandas()), frame(con.execute(catalog.ORACLE_SQL[name]).fetchdf())
    assert list(got.columns) == list(want.columns) and got.equals(want)


@needs_data
def test_works_from_anywhere(tmp_path):
    """Neither the working folder nor the path of the workers holds the package."""
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {os.path.abspath(entry.__file__)!r})
e = importlib.util.module_from_spec(spec)
spec.loader.exec_module(e)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0
assert e.queries()["jumping_minimizers"](spark, {SMALL!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=env)


def test_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for part in ("__spark_entry__.py", "seqloom", "verify_oracle.py"):
        os.symlink(f"{root}/{part}", tmp_path / part) if part != "seqloom" else None
    package = tmp_path / "seqloom"
    package.mkdir()
    for part in os.listdir(f"{root}/seqloom"):
        if part not in ("llm", "__pycache__"):
            os.symlink(f"{root}/seqloom/{part}", package / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
