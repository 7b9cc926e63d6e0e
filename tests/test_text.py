import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kontorium.functions.text import csv_escape, dedupe_name_tokens, jtrim, non_blank, strip_accents, word_line


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


def test_strip_accents(spark):
    assert one(spark, "José Ñúñez Ångström Ø ß", strip_accents) == "Jose Nunez Angstrom Ø ß"
    assert one(spark, "한글", strip_accents) == unicodedata.normalize("NFD", "한글")
    assert one(spark, None, strip_accents) is None
    assert one(spark, "é", strip_accents) == "e"


def test_strip_accents_against_unicodedata(spark):
    sample = [chr(c) for c in [*range(1, 0x500), *range(0x1E00, 0x2000), *range(0xAC00, 0xAC80), *range(0xD780, 0xD7A4)]]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(sample)], "i int, v string").orderBy("i").select(strip_accents(F.col("v"))).collect()]
    want = ["".join(x for x in unicodedata.normalize("NFD", s) if unicodedata.category(x)[0] != "M") for s in sample]
    assert got == want


def test_token_dedupe(spark):
    f = lambda c: F.array_join(dedupe_name_tokens(c), "|")
    assert one(spark, ["Dr.", "José José", "Pérez-López", "JOSE PEREZ Chepe"], f, "array<string>") == "Dr|Jose|Perez Lopez|Chepe"
    assert one(spark, [], f, "array<string>") == ""
    assert one(spark, [None, "", "a"], f, "array<string>") == "a"


def test_trim_and_blank(spark):
    assert one(spark, "\t\x01 a b \r\n", jtrim) == "a b"
    assert one(spark, "\u00a0", jtrim) == "\u00a0"
    assert one(spark, "\u00a0", non_blank) is True
    assert one(spark, " \t", non_blank) is False
    assert one(spark, None, non_blank) is False


def test_words(spark):
    assert one(spark, "Ñu-2, x_Y", word_line) == "ñu 2 x y"
    assert one(spark, None, word_line) == ""


def test_escape(spark):
    for v, want in [("a", "a"), ("a,b", '"a,b"'), ('a"b', '"a""b"'), ("a\nb", '"a\nb"'), ("a\rb", '"a\rb"'), (None, ""), ("", "")]:
        assert one(spark, v, csv_escape) == want


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aAéb '1.", max_size=6), max_size=4))
def test_dedupe_property(spark, parts):
    import re

    seen, want = set(), []
    for p in parts:
        bare = "".join(x for x in unicodedata.normalize("NFD", p) if unicodedata.category(x)[0] != "M")
        keep = []
        for w in re.findall(r"[^\W_]+(?:'|[^\W_])*|'(?:'|[^\W_])*", bare):
            if w.lower() not in seen:
                seen.add(w.lower())
                keep.append(w)
        if keep:
            want.append(" ".join(keep))
    assert one(spark, parts, lambda c: F.to_json(dedupe_name_tokens(c)), "array<string>") == __import__("json").dumps(want, separators=(",", ":"), ensure_ascii=False)
