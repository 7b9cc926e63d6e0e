import os
import random

import pytest

from helpers import rows
from kontorium.llm import packing
from kontorium.llm.packing import TOKENIZER, BestFit, containers, count_tokens, encoder, packed_documents

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, piece string, n_tokens int")


def check(spark, texts, capacity, parts=4, **kw):
    packed = packed_documents(docs(spark, texts).repartition(parts), capacity, **kw)
    got = packed.collect()
    fill, pieces = {}, {}
    for r in got:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["token_start"], r["n_tokens"]))
    assert all(n <= capacity for n in fill.values())
    assert sorted(pieces) == list(range(len(texts)))
    for i, t in enumerate(texts):
        n = count_tokens(t or "")
        p = sorted(pieces[i])
        assert [x[0] for x in p] == list(range(len(p))) and [x[1] for x in p] == [k * capacity for k in range(len(p))]
        assert sum(x[2] for x in p) == n and len(p) == max(1, -(-n // capacity))  # divided only above the capacity
    return fill


def test_everything_is_packed_once(spark):
    r = random.Random(1)
    texts = ["word " * r.randint(1, 60) for _ in range(400)] + ["long text here " * 100, None, "", "word " * 64, "word " * 65]
    fill = check(spark, texts, 64)
    total = sum(fill.values())
    assert len(fill) <= 1.06 * total / 64 + 2
    few = check(spark, texts, 64, open_bins=2, merge_splits=2)
    assert len(few) < 1.25 * total / 64


def test_merging_over_levels(spark):
    fill = check(spark, ["a b c d e f"] * 70, 64, parts=9, merge_splits=2)
    assert len(fill) == 7


def test_best_fit_rules():
    b = BestFit(10, 2)
    assert b.add("a", 6) is None and b.add("b", 7) is None
    assert b.add("c", 3) == ["b", "c"]  # the fullest that holds it, which is then full
    assert b.add("d", 8) is None
    assert b.add("e", 5) == ["d"]  # a third bin opens: the fullest closes
    assert sorted(map(tuple, b.rest())) == [("a",), ("e",)]


def test_long_texts_in_pieces(monkeypatch):
    text = "Die Vorrichtung nach Anspruch 1, dadurch  gekennzeichnet...\n\n" * 300
    whole = len(encoder(TOKENIZER).encode_ordinary(text))
    monkeypatch.setattr(packing, "PIECE_CHARS", 100)
    assert count_tokens(text) == whole
    assert count_tokens("") == 0


def test_empty(spark):
    p = packed_documents(docs(spark, []))
    assert rows(p) == [] and rows(containers(p)) == []
