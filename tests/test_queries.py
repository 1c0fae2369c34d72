import glob
import os
import subprocess
import sys

import duckdb
import pytest

from weftarc.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_duckdb(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toArrow(), duck.sql(ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*[t[c].to_pylist() for c in columns], strict=True)))
    assert rows(got) == rows(want)


def test_flagship(spark):
    assert FLAGSHIP(spark, SF).count() > 0


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "weftarc"):
        os.symlink(f"{root}/{name}", f"{tmp_path}/{name}") if name.endswith(".py") else os.mkdir(f"{tmp_path}/{name}")
    for name in os.listdir(f"{root}/weftarc"):
        if name != "llm":
            os.symlink(f"{root}/weftarc/{name}", f"{tmp_path}/weftarc/{name}")
    code = "import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
