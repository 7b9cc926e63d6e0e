import pytest

from helpers import compare_sql
from kontorium.llm import cuts, oracle, packing, queries

QUERIES, SQL = queries.all_queries(), oracle.all_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, name):
    mine, theirs = compare_sql(spark, sf, name, QUERIES[name], SQL[name])
    assert mine == theirs


def run(spark, sf, name):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def test_what_has_no_sql_is_known():
    assert set(QUERIES) - set(SQL) == {"p5_learned", "p8_packed", "p8_containers", "p8_summary", "p9_near", "p10_found", "p10_reasons", "p10_sources"}


def test_learned_survivors_are_members_that_say_something(spark, sf):
    fixed, learned = run(spark, sf, "p5_found"), run(spark, sf, "p5_learned")
    key = lambda r: (r["group_id"], r["field_name"])
    assert sorted(map(key, fixed)) == sorted(map(key, learned)) and fixed
    said = {(r["group_id"], r["field_name"], r["row_id"]) for r in queries._candidates(spark, sf).collect()}
    assert {(*key(r), r["row_id"]) for r in learned} <= said


def test_containers_hold_every_text_once(spark, sf):
    packed, boxes, (total,) = (run(spark, sf, n) for n in ("p8_packed", "p8_containers", "p8_summary"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {}
    for r in packed:
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["n_tokens"]
    assert size == {d: packing.count_tokens(t) for d, t in docs.items()}
    assert all(b["tokens"] <= packing.CAPACITY and b["tokens"] + b["unused"] == packing.CAPACITY for b in boxes)
    assert (total["containers"], total["tokens"], total["unused"]) == (len(boxes), sum(size.values()), sum(b["unused"] for b in boxes))
    assert total["least"] == -(-total["tokens"] // packing.CAPACITY) <= total["containers"] and total["fullest"] == max(b["tokens"] for b in boxes)


def test_near_leaks_hold_the_exact_ones(spark, sf):
    near, exact = ({tuple(sorted(r.items())) for r in run(spark, sf, n)} for n in ("p9_near", "p9_found"))
    assert exact and exact <= near


def test_cut_texts_and_shares(spark, sf):
    found, reasons, sources = (run(spark, sf, n) for n in ("p10_found", "p10_reasons", "p10_sources"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in found) == sorted(r["doc_id"] for r in reasons) and len({r["doc_id"] for r in found}) == len(found) > 0
    for r in reasons:
        assert r["broken"] == cuts.ends_broken(texts[r["doc_id"]]) and (r["at_limit"] or r["broken"] or r["inside"])
        if r["longer_id"] is not None:
            assert len(texts[r["longer_id"]]) > len(texts[r["doc_id"]].rstrip("\ufffd…<[({. \n"))
    assert {d for d, t in texts.items() if cuts.ends_broken(t)} <= {r["doc_id"] for r in found}
    assert sum(r["documents"] for r in sources) == len(texts) and sum(r["cut"] for r in sources) == len(found)
    assert all(r["share"] == r["cut"] / r["documents"] for r in sources)


def test_registered():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
