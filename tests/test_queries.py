import subprocess
import sys
from pathlib import Path

import pytest

from helpers import compare_sql
from kontorium.plans import oracle, queries

QUERIES, SQL = queries.all_queries(), oracle.all_sql()


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, name):
    mine, theirs = compare_sql(spark, sf, name, QUERIES[name], SQL[name])
    assert mine == theirs


def test_entry_works_without_the_subpackage():
    code = "import sys; sys.modules['kontorium.llm'] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.core.all_queries()), sorted(e.oracle_sql()) == sorted(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[1])
    assert done.stdout.split() == ["True", "True"], done.stderr


def test_exports_read_back_as_written(spark, sf):
    assert QUERIES["aligned_exports"](spark, sf).count() == spark.read.parquet(f"{sf}/contact_rows.parquet").count()
