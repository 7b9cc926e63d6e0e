from helpers import rows
from kontorium.operators.contacts import ContactTable, explode_phones, from_table, is_spam, key_index, phone_occurrences
from kontorium.operators.merge import (
    base_rows, final_header, merged_contacts, name_variants, numbered_names, output_columns, phone_union, slot_union, slot_widths, stats,
)

HEADER = ["First Name", "Last Name", "Nickname", "Photo", "E-mail 1 - Value", "E-mail 2 - Value", "E-mail 4 - Value", "Website 1 - Value", "Website 1 - Label", "Phone 3 - Value", "Phone 3 - Label", "Notes", "first name"]


def table(spark, cells, header=HEADER):
    cols = [f"c{i}" for i in range(len(header))]
    data = [(i, "f", i + 1, *c, *[""] * (len(header) - len(c))) for i, c in enumerate(cells, 1)]
    df = spark.createDataFrame(data, "row_id long, source_file string, source_row int, " + ", ".join(f"{c} string" for c in cols))
    return ContactTable(df, header, cols)


def together(spark, n):
    return spark.createDataFrame([(i, 1) for i in range(1, n + 1)], "row_id long, cluster_id long")


def test_base_backfill_and_variants(spark):
    t = table(spark, [
        ["Ána", " ", "", "", "x@a", "", "", "", "", "", "", "n"],
        ["Ana", "Gil", "", " p ", "X@A", "y@a", "lost@a", "", "", "", "", "m", "low"],
        ["ana", "Gil", "Nick", "q", "", "", "", "", "", "", "", ""],
        ["", "", "", "", "", "", "", "", "", "", "", ""],
    ])
    m = together(spark, 4)
    assert rows(base_rows(t, m)) == [(1, 2, 4)]
    assert rows(name_variants(t, m)) == [(1, ["Ana", "ana Gil"])]
    out = merged_contacts(t, m)
    header, cols = output_columns(out, slot_widths(out))
    r = dict(zip(header, out.df.select(*cols).first()))
    # the variants' words are all in the name already
    assert r["First Name"] == "Ana - Gil - Nick" and r["Last Name"] == "" and r["Photo"] == " p " and r["first name"] == "low" and r["Notes"] == ""
    assert rows(slot_union(t, m, "E-mail", False).select("label", "value")) == [("Other", "x@a"), ("Other", "y@a")]
    assert rows(slot_union(t, m, "E-mail", True).select("value")) == [("X@A",), ("x@a",), ("y@a",)]
    assert rows(stats(t.df, out)) == [(4, 1, 1, 0, 2, 0)]


def test_phones_first_wins_and_limit(spark):
    many = " ::: ".join(str(5500000000 + i) for i in range(25))
    t = table(spark, [["a", "", "", "", "", "", "", "w", " L ", "+52 55 0000 0000", "", ""], ["b", "", "", "", "", "", "", "W", "", many, " Home ", ""]])
    m = together(spark, 2)
    p = rows(phone_union(t, m).select("row_id", "label", "value"))
    assert len(p) == 25 and (1, "Mobile", "+525500000000") in p and (2, "Home", "5500000001") in p
    out = merged_contacts(t, m)
    r = out.df.first()
    assert len(r["phones"]) == 20 and r["phones"][0]["value"] == "+525500000000"
    assert [(x["label"], x["value"]) for x in r["websites"]] == [("L", "w"), ("Other", "W")]
    assert slot_widths(out) == (20, 0, 2)


def test_header_layout():
    assert final_header(["x", "Phone 2 - Value", "y", "Phone 1 - Label", "Website 1 - Value"], 2, 3, 0) == [
        "x", "Phone 1 - Label", "Phone 1 - Value", "Phone 2 - Label", "Phone 2 - Value", "y", "Website 1 - Label", "Website 1 - Value",
    ]


def test_numbering(spark):
    names = ["Ana - Ruiz", "Ana - Gil", "ANA", "", "Ána - x", None]
    df = spark.createDataFrame(list(enumerate(names)), "i long, name string")
    got = [r["name"] for r in numbered_names(df, "name", "i").orderBy("i").collect()]
    assert got == ["Ana - Ruiz", "Ana - Gil 2", "ANA 3", "", "Ana - x 4", None]


def test_no_first_name_column(spark):
    t = table(spark, [["Gil", "1"], ["", "2"]], ["Last Name", "Other"])
    out = merged_contacts(t, together(spark, 2))
    header, cols = output_columns(out, slot_widths(out))
    assert header == ["Last Name", "Other"] and rows(out.df.select(*cols)) == [("Gil", "1")]


def test_spam_phones_and_index(spark):
    t = table(spark, [["spamela"], ["x", "", "", "", "", "", "", "", "", "411 ::: 411 ::: n/a", "L"], ["y", "ſpam", "", "", "", "", "", "", "", "411"]])
    assert [r[0] for r in t.df.orderBy("row_id").select(is_spam(t)).collect()] == [True, False, True]
    assert rows(key_index(phone_occurrences(t))) == [("RAW_SHORT::411", 2, 1, 2)]
    assert explode_phones(t, anomalies=True).count() == 4
    assert rows(explode_phones(table(spark, [["x"]], ["First Name"]))) == []


def test_table_with_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "f", 2, None, None)], "row_id long, source_file string, source_row_number int, first_name string, phone_1_value string")
    t = from_table(df)
    assert rows(merged_contacts(t, together(spark, 1)).df.select("cluster_id", "s0")) == [(1, "")]
    none = t.with_df(t.df.limit(0))
    out = merged_contacts(none, together(spark, 1))
    assert out.df.count() == 0 and slot_widths(out) == (0, 0, 0)
    assert rows(stats(none.df, out)) == [(0, 0, 0, 0, 0, 0)]

