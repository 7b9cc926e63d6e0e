import random

import pytest

from helpers import rows
from kontorium.operators.packed import LABELS, NOTES, split_packed

SCHEMA = "row_id long, labels string, notes string, field string, tokens int"
RULES = {"labels": LABELS, "notes": NOTES}


def brute(field, s):
    """Character by character, without tokens or skeletons."""
    plain = [":::", ";", "|", "\r\n", "\n", "\r"] + ([","] if field == "labels" else [])
    wide = "/" if field == "labels" else "//"

    def sep(i):
        for p in plain:
            if s.startswith(p, i):
                return len(p)
        if s.startswith(wide, i) and 0 < i and s[i - 1].isspace() and s[i + len(wide) : i + len(wide) + 1].isspace():
            return len(wide)
        return 0

    out, i = [], 0
    while i <= len(s):
        j = i
        while True:
            while j < len(s) and s[j].isspace() and s[j] not in "\r\n":
                j += 1
            if field == "notes" and j < len(s) and (s[j] in "•‣◦▪●·" or (s[j] in "*-–" and j + 1 < len(s) and s[j + 1].isspace() and s[j + 1] not in "\r\n")):
                j += 1
                continue
            break
        if j < len(s) and s[j] == '"':
            e = j + 1
            while e < len(s) and not (s[e] == '"' and s[e + 1 : e + 2] != '"'):
                e += 2 if s[e] == '"' else 1
            k = e + 1
            while k < len(s) and s[k].isspace() and s[k] not in "\r\n":
                k += 1
            if e < len(s) and (k >= len(s) or sep(k)):
                v = s[j + 1 : e].replace('""', '"')
                if s[j + 1 : e].strip():
                    out.append(v)
                if k >= len(s):
                    break
                i = k + sep(k)
                continue
        e = j
        while e < len(s) and not sep(e):
            e += 1
        if s[j:e].strip():
            out.append(s[j:e].strip())
        if e >= len(s):
            break
        i = e + sep(e)
    return out


def got(spark, cells, least=1, **kw):
    data = [(i, c if f == "labels" else None, c if f == "notes" else None, "x", 1) for i, (f, c) in enumerate(cells)]
    out = {}
    for i, _, pos, v in sorted(tuple(r) for r in split_packed(spark.createDataFrame(data, SCHEMA), "row_id", RULES, least, **kw).collect()):
        out.setdefault(i, []).append((pos, v))
    return out


CASES = [
    ("labels", '* own ::: "A ::: B"', ["* own", "A ::: B"]),
    ("labels", '"The ""Early"" Birds", VIP,', ['The "Early" Birds', "VIP"]),
    ("labels", "24/7 Support / and/or list", ["24/7 Support", "and/or list"]),
    ("labels", "a;;b | | c", ["a", "b", "c"]),
    ("notes", "• x\n• y, z\n- w\n* v", ["x", "y, z", "w", "v"]),
    ("notes", "•x\r\n•\"a | b\"", ["x", "a | b"]),
    ("notes", "see http://n/a/b // ref 12/07: p", ["see http://n/a/b", "ref 12/07: p"]),
    ("notes", "*55; -5", ["*55", "-5"]),
    ("labels", '"open; x', ['"open', "x"]),
    ("labels", '"a" b; c', ['"a" b', "c"]),
    ("labels", "a / b", ["a / b".split(" / ")[0], "b"]),
    ("labels", "  x  ", ["x"]),
    ("labels", '"" ; a', ["a"]),
    ("notes", "a::::b", ["a", ":b"]),
]


def test_cases(spark):
    out = got(spark, [(f, c) for f, c, _ in CASES])
    for i, (f, c, want) in enumerate(CASES):
        assert [v for _, v in out[i]] == want, c
        assert [p for p, _ in out[i]] == list(range(1, len(want) + 1))
        assert brute(f, c) == want, c


def test_against_brute_force(spark):
    r = random.Random(5)
    parts = ["a", "Bc d", '"', '""', ":::", ":", ";", "|", "\n", "\r\n", ",", " / ", "/", " // ", "//", " ", "  ", "•", "* ", "*", "- ", "-", " ", "\t", '"x; y"', "é"]
    cells = [(r.choice(["labels", "notes"]), "".join(r.choice(parts) for _ in range(r.randint(0, 9)))) for _ in range(3000)]
    for kw in ({}, {"broadcast_bytes": 0}):
        out = got(spark, cells, **kw)
        for i, (f, c) in enumerate(cells):
            assert [v for _, v in out.get(i, [])] == brute(f, c), (f, c)


@pytest.mark.parametrize("least, n", [(1, 3), (2, 2)])
def test_nulls_empty_and_least(spark, least, n):
    out = got(spark, [("labels", None), ("labels", ""), ("notes", " \n "), ("labels", "one"), ("labels", "a,b"), ("labels", "a,b")], least)
    assert len(out) == n
    df = spark.createDataFrame([], SCHEMA)
    assert rows(split_packed(df, "row_id", RULES, least)) == []


def test_very_long_cell(spark):
    out = got(spark, [("notes", "; ".join(f"value {i}" for i in range(40_000)))])
    assert len(out[0]) == 40_000 and out[0][-1] == (40_000, "value 39999")


@pytest.mark.parametrize("unit", ["x", "word ", "a-b – ", "a/b//", ":x", "é😀", " ", "-", "\t"])
def test_a_million_characters_in_one_value(spark, unit):
    text = ("A" + unit * 1_000_000)[:999_999] + "z"
    for kw in ({}, {"broadcast_bytes": 0}):
        assert got(spark, [("labels", text), ("notes", text), ("notes", f"{text}; b")], **kw) == {0: [(1, text)], 1: [(1, text)], 2: [(1, text), (2, "b")]}
