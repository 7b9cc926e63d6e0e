import random

import pytest

from helpers import rows
from kontorium.llm.cuts import bare_text, cut_documents, cut_shares, ends_broken, judged_endings, longer_copies, source_limits

SCHEMA = "doc_id long, text string, source string, part int, edge string"


def frame(spark, data):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in data], SCHEMA)


WHOLE = [
    "One. Two.", "Is it?", 'He said "so."', "A.\n", "A. ", "A turn.\n■", "A turn.\n* * * * *", "A turn.\n--- end of document ---", "A turn.\n(FIG. 3)",
    "A turn.\n</claims>", "A turn.\n(c) Some Works AG", "A turn.\n\nReference signs\n10 sun gear\n12 ring gear", "A turn.\n\nListe des repères\n10 la vanne\n■", "",
    None, " \n", "1. A valve.\n\n2. A seat with 13 turns.",
]
BROKEN = [
    "A gear hav", "It is therefore desirable to", "A turn.\n\n13.", "see FIG.", "The sopor�", "It remains…", "It remains...", "has 9 tur<", "gekennz [", "wherein the,",
    "A turn.\n\n9. The device according to claim 4, wherein", "[0012] Bei", "It is seal\n■", "A. And then …", "12 mm",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert not ends_broken(text)


@pytest.mark.parametrize("text", BROKEN)
def test_broken(text):
    assert ends_broken(text)


def prefixes(data):
    """doc -> whether the longer texts go on inside a line, by comparing all pairs of bare texts."""
    bare = {i: (t or "").rstrip(" \n…<[") for i, t, _ in data}
    return {i for i, t in bare.items() if t and any(u != t and u.startswith(t) for u in bare.values())}


@pytest.mark.parametrize("seed", range(3))
def test_longer_copies(spark, seed):
    r = random.Random(seed)
    data = []
    for i in range(300):
        t = "".join(r.choice(["ab", "a", "c.", " ", "\n", "é"]) for _ in range(r.randint(0, 6)))
        data.append((i, t + r.choice(["", "…", " ["]), "s"))
    data += [(1000 + i, "same text", "s") for i in range(200)] + [(5000, "same text and more", "s"), (5001, None, "s")]
    got = longer_copies(frame(spark, data).repartition(6)).collect()
    assert {x["doc_id"] for x in got} == prefixes(data)
    assert len(got) == len({x["doc_id"] for x in got})
    texts = {i: (t or "").rstrip(" \n…<[") for i, t, _ in data}
    for x in got:
        a, b = texts[x["doc_id"]], texts[x["longer_id"]]
        longer = [(k, u) for k, u in texts.items() if u != a and u.startswith(a)]
        assert b.startswith(a) and b != a and x["longer_id"] == min(min(j for j in texts if texts[j] == u) for _, u in longer)
        assert x["inside"] == (not a.endswith(".") and any(u[len(a)] != "\n" for _, u in longer))  # every continuation is asked


@pytest.mark.parametrize("parts", ["8", "200"])
def test_same_under_other_partitions(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    df = frame(spark, [(i, f"{i % 7} " + "word " * (i % 50) + "x" * (i % 3), "s") for i in range(400)])
    assert {r["doc_id"] for r in longer_copies(df).collect()} == prefixes([(r["doc_id"], r["text"], "s") for r in df.collect()])
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_many_lengths_of_one_text(spark):
    text = "".join(f"{i} " for i in range(3000))
    df = frame(spark, [(n, text[:n], "s") for n in range(1, 1500)] + [(5000, text, "s")])
    got = longer_copies(df)
    assert got.count() == 1499
    assert got.filter("inside").count() == 1499


def test_copies_only_of_one_text_over_all_partitions(spark):
    data = [(i, "a text", "s") for i in range(500)] + [(900, "a text that goes on", "s")]
    assert longer_copies(frame(spark, data)).filter("longer_id = 900 AND inside").count() == 500
    assert rows(longer_copies(frame(spark, data[:500]))) == []


def test_limits_and_reasons(spark):
    full = lambda n: "x" * (n - 1) + "."
    data = [(i, "y" * 50, "chars") for i in range(4)] + [(7, "y" * 50 + "...", "chars")] + [(4, full(50), "chars"), (5, full(49), "chars"), (6, full(30), "chars")]
    data += [(10 + i, "é" * 20, "bytes") for i in range(3)] + [(13, "é" * 19 + "..", "bytes"), (14, "é" * 18 + "xyz.", "bytes"), (15, "x" * 38 + "é"[:0] + "z", "bytes")]
    data += [(20, full(90), "free"), (21, full(90), "free"), (22, "no end", "free"), (23, "Z.\n12 gea", "free")]
    data += [(30, "Signs.\n\nList\n10 sun", "list"), (31, "Signs.\n\nList\n10 sun gear", "list"), (32, None, None), (33, "cut in", None)]
    df = frame(spark, data)
    limits = {s: (c, b) for s, c, b in rows(source_limits(judged_endings(df)))}
    assert limits == {"chars": (50, None), "bytes": (None, 40)}
    found = {r["doc_id"]: r for r in cut_documents(df).collect()}
    assert set(found) == {0, 1, 2, 3, 4, 7, 10, 11, 12, 13, 14, 15, 22, 23, 30, 33}
    assert found[4]["at_limit"] and not found[4]["broken"]
    assert found[30]["inside"] and found[30]["longer_id"] == 31
    shares = {r["source"]: (r["documents"], r["cut"], r["share"]) for r in cut_shares(df).collect()}
    assert shares["chars"] == (8, 6, 6 / 8) and shares[None] == (2, 1, 0.5) and shares["list"] == (2, 1, 0.5)


def test_empty_and_long(spark):
    df = frame(spark, [(1, "word " * 200_000 + "end.", "s"), (2, "word " * 200_000 + "en", "s")])
    assert rows(cut_documents(df).select("doc_id", "longer_id")) == [(2, 1)]
    none = df.limit(0)
    assert rows(cut_documents(none)) == [] and rows(cut_shares(none)) == [] and rows(longer_copies(none)) == []


def test_bare_text(spark):
    df = spark.createDataFrame([("abc. …",), ("x...",), ("de <[",), ("f.\xa0\n",), (None,), ("g. ...  ",)], "t string")
    assert [r[0] for r in df.select(bare_text(df.t)).collect()] == ["abc.", "x", "de", "f.", "", "g."]
