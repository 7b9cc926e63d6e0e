import pytest

from helpers import altered_tables, rows
from kontorium.llm import queries

QUERIES = queries.all_queries()
SAME = ["p3_found", "p4_found", "p4_records", "p5_found", "p5_learned", "p5_records", "p9_found", "p9_near", "p10_found", "p10_reasons"]


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    return altered_tables(spark, sf, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    return altered_tables(spark, sf, tmp_path_factory.mktemp("empty"), empty=True)


@pytest.mark.parametrize("name", SAME)
def test_null_rows_and_extra_columns(spark, sf, odd, name):
    assert rows(QUERIES[name](spark, odd)) == rows(QUERIES[name](spark, sf))


def test_packing_of_a_null_row(spark, sf, odd):
    a, b = (QUERIES["p8_packed"](spark, d) for d in (odd, sf))
    assert a.count() == b.count() + 1 and a.filter("doc_id IS NULL AND n_tokens = 0").count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == (1 if name == "p8_summary" else 0)
