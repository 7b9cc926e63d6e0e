import pytest

from helpers import altered_tables, rows
from kontorium.plans import queries

QUERIES = queries.all_queries()
DEALT = sorted(q for q in QUERIES if q.startswith("p1_") or q.startswith("p2_") or q.startswith("p6_") or q.startswith("p7_"))
CONTACTS = ["phone_parse", "accent_strip", "name_token_dedupe", "spam_filter", "phone_key_index", "merged_contacts", "merge_conflicts", "csv_lines", "duplicate_name_suffix", "slot_stats"]


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    return altered_tables(spark, sf, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    return altered_tables(spark, sf, tmp_path_factory.mktemp("empty"), empty=True)


@pytest.mark.parametrize("name", DEALT)
def test_null_rows_and_extra_columns(spark, sf, odd, name):
    assert rows(QUERIES[name](spark, odd)) == rows(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", CONTACTS)
def test_contacts_with_null_rows(spark, odd, name):
    assert QUERIES[name](spark, odd).count() > 0


@pytest.mark.parametrize("name", [*DEALT, *CONTACTS])
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == (1 if name == "slot_stats" else 0)
