import os
from datetime import datetime

import pytest

from kontorium.plans import queries
from kontorium.plans.pipeline import export, main, run
from kontorium.sources import files
from kontorium.sources.exports import header_union, list_exports, read_contacts, read_csv, read_records, tokenize
from kontorium.sources.sink import output_name

CASES = [
    ("A,B\r\n1,2\r\n", [["A", "B"], ["1", "2"]]),
    ("a\n\nb", [["a"], [""], ["b"]]),
    ('x"y,z"w,3\n', [["xy,zw", "3"]]),
    ('"m\r\nn",4\n', [["m\r\nn", "4"]]),
    ("a\rb,c\n", [["ab", "c"]]),
    ('a\n""', [["a"]]),
    ('"a""b"\n', [['a"b']]),
    ('"open,\nend', [["open,\nend"]]),
    ("", []),
    ("a,", [["a", ""]]),
    ('""""', [['"']]),
    ('"a"""', [['a"']]),
]


@pytest.mark.parametrize("text, want", CASES)
@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_tokenizer(text, want, size):
    assert list(tokenize(text[i : i + size] for i in range(0, len(text), size))) == want


def test_bytes(tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes(b"\xef\xbb\xbfA,B\r\n\xff,2")
    assert read_csv(str(p)) == [["A", "B"], ["�", "2"]]


def write(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, name + ".csv"), "w", encoding="utf-8", newline="") as f:
            f.write(text)


def test_union_and_alignment(spark, tmp_path):
    d = str(tmp_path / "in")
    write(d, _b="B,a.x,B\n1,2,3\n4\n5,6,7,8\n", c="C,B\nu,v\n\n", d="", e="Only\n")
    (tmp_path / "in" / "skip.CSV").write_text("Z\n1\n")
    assert [os.path.basename(p) for p, _ in list_exports(spark, d)] == ["_b.csv", "c.csv", "d.csv", "e.csv"]
    assert header_union(read_records(spark, d)) == ["B", "a.x", "C", "Only"]
    t = read_contacts(spark, d)
    got = sorted((r["source_file"], r["source_row"], *[r[c] for c in t.columns]) for r in t.df.collect())
    assert got == [
        ("_b.csv", 2, "3", "2", "", ""), ("_b.csv", 3, "4", "", "", ""), ("_b.csv", 4, "7", "6", "", ""),
        ("c.csv", 2, "v", "", "u", ""), ("c.csv", 3, "", "", "", ""),
    ]


IN = """First Name,Last Name,Phone 1 - Label,Phone 1 - Value,E-mail 1 - Value,Notes,Labels
José,Pérez,Mobile,+52 1 55 1234 5678,jp@x.com,hi,* myContacts
Jose,Perez Lopez,,5512345678 ::: 411,JP@x.com,,
SPAM,,,411,,,
"""
OUT = (
    "First Name,Last Name,Phone 1 - Label,Phone 1 - Value,Phone 2 - Label,Phone 2 - Value,E-mail 1 - Label,E-mail 1 - Value,Notes,Labels\r\n"
    "Jose - Perez - Lopez,,Mobile,+525512345678,Mobile,411,Other,jp@x.com,,\r\n"
)


def test_end_to_end(spark, tmp_path):
    write(str(tmp_path / "input"), a=IN)
    out = str(tmp_path / "output")
    write(out, stale="x\n")
    r = run(spark, str(tmp_path / "input"), out, lambda: datetime(2024, 5, 6, 7, 8, 9))
    assert os.listdir(out) == ["20240506_070809_google_reimport.csv"]
    assert open(r.output, encoding="utf-8", newline="").read() == OUT
    assert (r.source_rows, r.contacts, r.merged_clusters, r.files) == (3, 1, 1, 1)


def test_numbering_and_blank_rows(spark, tmp_path):
    write(str(tmp_path / "input"), a="First Name,Last Name\nAna,Ruiz\nAna,Gil\n\nANA,\n", b="Photo,Phone 2 - Value\np,\n")
    r = run(spark, str(tmp_path / "input"), str(tmp_path / "output"))
    assert open(r.output, newline="").read().split("\r\n") == [
        "First Name,Last Name,Photo,Phone 1 - Label,Phone 1 - Value", "Ana - Ruiz,,,,", "Ana - Gil 2,,,,", ",,,,", "ANA 3,,,,", ",,p,,", "",
    ]


def test_no_input(spark, tmp_path, capsys):
    out = str(tmp_path / "output")
    write(out, stale="x\n")
    r = run(spark, str(tmp_path / "none"), out)
    assert r.output is None and os.listdir(out) == []
    os.makedirs(tmp_path / "input")
    main([str(tmp_path)])
    assert "no CSV files" in capsys.readouterr().out
    with pytest.raises(ValueError):
        run(spark, out, out)


def test_uris_and_missing_parts(spark, tmp_path, monkeypatch):
    write(str(tmp_path / "input"), a=IN)
    r = run(spark, f"file://{tmp_path}/input", f"file://{tmp_path}/output", lambda: datetime(2024, 5, 6, 7, 8, 9))
    assert open(files.bare_path(r.output), encoding="utf-8", newline="").read() == OUT
    with pytest.raises(ValueError):
        run(spark, f"file://{tmp_path}/output", str(tmp_path / "output"))
    real = files.list_files
    monkeypatch.setattr(files, "list_files", lambda s, d, end="": [] if d.endswith(".parts") else real(s, d, end))
    with pytest.raises(RuntimeError, match="0 bytes of"):
        run(spark, str(tmp_path / "input"), str(tmp_path / "output"))


def test_export_of_a_table(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/contact_rows.parquet")
    r = export(rows, str(tmp_path / "x.csv"))
    want = {x["line"] for x in queries.merged_contacts(spark, sf).collect()}
    assert set(open(r.output, encoding="utf-8", newline="").read().split("\r\n")[1:-1]) >= {x for x in want if "\n" not in x}
    assert (r.source_rows, r.contacts) == (rows.count(), queries.merged_contacts(spark, sf).count())
    assert export(rows.limit(0), str(tmp_path / "y.csv")).contacts == 0
    assert open(tmp_path / "y.csv", newline="").read().startswith("First Name,Middle Name")


def test_output_name():
    assert output_name(datetime(2024, 1, 2, 3, 4, 5)) == "20240102_030405_google_reimport.csv"


def test_exports_go_to_a_mounted_folder(spark, sf, tmp_path, monkeypatch):
    for folder in ("hdfs://host/x", "s3a://bucket/x"):
        monkeypatch.setattr(queries, "shared_folder", lambda _: folder)
        with pytest.raises(ValueError, match="mounted"):
            queries._export_folder(spark, sf)
    rows = spark.read.parquet(f"{sf}/contact_rows.parquet").select("source_file", "source_row_number").orderBy("source_file", "source_row_number").collect()
    for folder in (f"file:{tmp_path}/a", f"file://{tmp_path}/b", f"{tmp_path}/c"):
        monkeypatch.setattr(queries, "shared_folder", lambda _: folder)
        path = queries._export_folder(spark, sf)
        assert os.path.dirname(path) == f"{tmp_path}/{folder[-1]}" and sorted(os.listdir(path)) == sorted({r[0] for r in rows})
        t = read_contacts(spark, path)
        assert t.df.count() == len(rows)
