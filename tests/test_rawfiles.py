import csv
import io
import random
import re
from datetime import date

from pyspark.sql import functions as F

from helpers import rows
from kontorium.operators.rawfiles import load_raw, main_types, path_types, path_values, raw_type, rejects, schema_changes, typed_table
from kontorium.sources import rawlines
from kontorium.sources.rawlines import header_key, parse_header

RAW = "file_id long, source_file string, source_row_number int, line string, chunk int, fields string"
FILES = "file_id long, source_file string, account string, stage string, exported_at timestamp, trust int"
ALIASES = [
    ("First Name", "First Name"), ("Vorname", "First Name"), ("Phone 1 - Value", "Phone 1 - Value"), ("E-mail 1 - Value", "E-mail 1 - Value"),
    ("Birthday", "Birthday"), ("DOB", "Birthday"), ("Starred", "Starred"), ("Times Contacted", "Times Contacted"), ("Notes", "Notes"),
    ("Postal Code", "Postal Code"),
]


def raw(spark, files):
    data = [(f, f"f{f}", i, line, 9, "x") for f, lines in files.items() for i, line in enumerate(lines, 1)]
    return spark.createDataFrame(data, RAW)


def aliases(spark):
    return spark.createDataFrame(ALIASES, "header_name string, field_name string")


def found(spark, files):
    _, r = load_raw(raw(spark, files), aliases(spark))
    return {(a, b): (c, d) for a, b, c, d in rows(rejects(r, path_types(r)))}


def well_quoted(line):
    """Cell by cell, by the rule's own words."""
    i, n = 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i += 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return False
                if line[j + 1 : j + 2] == '"':
                    i = j + 2
                    continue
                i = j + 1
                break
            if i < n and line[i] != ",":
                return False
        else:
            j = line.find(",", i)
            cell = line[i : n if j < 0 else j]
            if '"' in cell:
                return False
            i = n if j < 0 else j
        if i >= n:
            return True
        i += 1


def test_structure_against_brute_force(spark, monkeypatch):
    r = random.Random(7)
    parts = ["a", '"', '""', ",", '"b,c"', "\n", "\r", " ", "é", '"d ""e"""', "", "'"]
    files = {}
    for f in range(1, 5):
        width = r.randint(1, 4)
        files[f] = [",".join(f"h{i}" for i in range(width))] + ["".join(r.choice(parts) for _ in range(r.randint(0, 7))) for _ in range(400)]
    monkeypatch.setattr(rawlines, "PARSE_BYTES", 3000)
    _, rec = load_raw(raw(spark, files), aliases(spark))
    got = {(x["file_id"], x["source_row_number"]): (x["reason"], x["cells"]) for x in rec.collect()}
    for f, lines in files.items():
        width = lines[0].count(",") + 1
        for i, line in enumerate(lines[1:], 2):
            if not well_quoted(line):
                want = ("broken_quoting", None)
            else:
                cells = []
                pos = 0
                for m in re.finditer(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)', line, re.S):
                    if m.start() < pos:
                        continue
                    c = m[1]
                    cells.append(c[1:-1].replace('""', '"') if c[:1] == '"' else c)
                    pos = m.end()
                want = (None, cells) if len(cells) == width else ("column_count", None)
            assert got[f, i] == want, repr(line)


def test_first_reason_and_values(spark):
    files = {
        1: [
            "Vorname,Phone 1 - Value,E-mail 1 - Value,Birthday,Starred,Times Contacted",
            "A,5512345678,a@b,2000-02-29,true,1", "B,n/a,a@b,2001-02-29,true,2", "C,,a b@c,31/12/1999,no,x",
            'D,"1,2,3', "E,1", "F,411 ::: 12345678901234,a@@b,20000101,TRUE,1.5", 'G,411,@b,,1,3', " ,   ,  , , ,", "", None,
        ],
        2: ["First Name,Birthday", "A,26 Jan", "B,3 Mar", "C,1999-99-99"],
        3: ["First Name,Times Contacted", "A,3 x", "B,4 x", "C,5"],
    }
    assert found(spark, files) == {
        (1, 3): ("invalid_value", "Phone 1 - Value|Birthday"), (1, 4): ("invalid_value", "E-mail 1 - Value|Times Contacted"),
        (1, 5): ("broken_quoting", None), (1, 6): ("column_count", None), (1, 7): ("invalid_value", "Phone 1 - Value|E-mail 1 - Value"),
        (1, 8): ("invalid_value", "E-mail 1 - Value|Starred"), (1, 10): ("column_count", None), (1, 11): ("column_count", None),
        (3, 4): ("invalid_value", "Times Contacted"),
    }


def test_days(spark):
    texts = [f"{y:04}-{m:02}-{d:02}" for y in (1900, 2000, 2023, 2024) for m in range(0, 14) for d in (0, 1, 28, 29, 30, 31, 32)]
    files = {1: ["Birthday,Notes"] + [x for t in texts for x in (t + ",", "/".join(reversed(t.split("-"))) + ",", t.replace("-", "") + ",")]}
    bad = found(spark, files)
    for i, t in enumerate(texts):
        try:
            date(*map(int, t.split("-")))
            ok = True
        except ValueError:
            ok = False
        for k in range(3):
            assert ((1, 2 + 3 * i + k) not in bad) == ok, files[1][1 + 3 * i + k]


def test_raw_types(spark):
    cases = {
        "1": "number", "1.5": "number", "1,5": "number", "20040622": "number", "2004-06-22": "date", "1.2.1999": "date", "1/2/99": "date", "YES": "flag",
        "false": "flag", "si no": "text", "1O": "text", "3 x": "text", "26 Jan": "text", " 7 ": "number", "": None, " ": None, None: None,
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string").orderBy("i")
    assert [r[0] for r in df.select(raw_type(F.col("v"))).collect()] == list(cases.values())


def test_headers():
    assert parse_header('﻿"First Name", x ,"a ""b"""') == ["First Name", "x", 'a "b"']
    assert parse_header(None) == []
    assert header_key("Phone 1_-_ VALUE") == header_key("phone1value")


def test_changes(spark):
    files = {
        1: ["Vorname,Birthday,Notes", "a,2000-01-01,x", "b,2000-01-02,", 'c,"1,2'],
        2: ['﻿"NOTES",first name,DOB', "x,a,20000101", ",b,20000102"],
        3: ["First_Name,Starred,Birthday", "a,yes,20000101"],
        4: ["First Name", "a"],
        9: ["Notes,Starred", "x,1"],
    }
    t = ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00", "2024-01-02 12:00:00"]
    info = [(1, "f1", "A", "raw", t[0], 1), (3, "f3", "A", "raw", t[2], 1), (2, "f2", "A", "raw", t[1], 1), (4, "f4", "B", "raw", t[3], 1),
            (9, "f9", None, "raw", t[3], None), (8, "f8", "A", "loaded", t[3], 1)]
    df = spark.createDataFrame(info, "file_id long, source_file string, account string, stage string, exported_at string, trust int").withColumn("exported_at", F.col("exported_at").cast("timestamp"))
    heads, rec = load_raw(raw(spark, files), aliases(spark))
    assert rows(schema_changes(df, heads, path_types(rec))) == sorted(
        [(2, "First Name", "renamed"), (2, "Birthday", "renamed"), (2, "Birthday", "retyped"), (3, "Birthday", "renamed"), (3, "Notes", "removed"), (3, "Starred", "added")], key=repr
    )
    assert ("Birthday", "date") in [(r["field_name"], r["raw_type"]) for r in main_types(path_types(rec)).collect()]


def test_types_of_every_path(spark):
    files = {1: ["Vorname,Shoe Size,Notes,Shoe Size,DOB", "a,41,yes,x,2000-01-01", "b,42.5,,y,", "c,n/a, ,z,1.2.1999", "bad"]}
    _, rec = load_raw(raw(spark, files), aliases(spark))
    assert rows(path_types(rec)) == sorted(
        [(1, "First Name", "text", 3), (1, "Shoe Size", "number", 2), (1, "Shoe Size", "text", 1), (1, "Notes", "flag", 1), (1, "Birthday", "date", 2)], key=repr
    )


def test_table_and_empty(spark):
    files = {1: ["Vorname,DOB,Starred,Vorname", "a,31.12.1999,1,b", "c,never,maybe,d", "bad"]}
    _, rec = load_raw(raw(spark, files), aliases(spark))
    assert rows(typed_table(rec, ["First Name", "Birthday", "Starred", "Notes"])) == [
        (1, 2, "a", date(1999, 12, 31), True, None, ""), (1, 3, "c", None, None, None, "Birthday|Starred"),
    ]
    assert path_values(rec).count() == 2
    none = raw(spark, {1: ["a"]}).limit(0)
    heads, rec = load_raw(none, aliases(spark))
    assert rows(rejects(rec, path_types(rec))) == [] and rows(heads) == []
    _, rec = load_raw(raw(spark, {1: [None, "a", "b,c"]}), aliases(spark).limit(0))
    assert {r["reason"] for r in rec.collect()} == {"column_count"}


def test_large_file_and_long_record(spark, monkeypatch):
    monkeypatch.setattr(rawlines, "PARSE_BYTES", 1 << 16)
    n = 9000
    files = {1: ["First Name,Notes"] + [f"n{i},\"x\ny\"" for i in range(n)] + ["m," + "z" * 2_000_000]}
    _, rec = load_raw(raw(spark, files), aliases(spark))
    assert rec.filter("reason IS NULL").count() == n + 1
    assert rec.filter("source_row_number = 2").first()["cells"] == ["n0", "x\ny"]
    assert csv and io
