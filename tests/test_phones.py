import random

import pytest
from pyspark.sql import functions as F

from kontorium.functions.phones import parse_field, parse_phones, render_phone

# raw, key type, key, country, category, confidence or warning
GOLDEN = [
    ("+52 1 55 1234 5678", "TEN_DIGIT", "5512345678", "MX", "E164_MX", "HIGH"),
    ("+52 55 1234 5678", "TEN_DIGIT", "5512345678", "MX", "E164_MX", "HIGH"),
    ("+52 1234567", None, None, None, "ANOMALY", "MX (+52) number too short: 521234567"),
    ("+1 (212) 555-0100", "TEN_DIGIT", "2125550100", "US", "E164_US", "HIGH"),
    ("+1 212 555", None, None, None, "ANOMALY", "Plus-prefixed number too short: 1212555"),
    ("+44 20 7946 0958", "E164_FULL", "+442079460958", "OTHER", "E164_OTHER_COUNTRY", "HIGH"),
    ("0044 20 7946 0958", "E164_FULL", "+442079460958", "OTHER", "INTL_00_PREFIX(E164_OTHER_COUNTRY)", "HIGH"),
    ("0052 55 1234 5678", "TEN_DIGIT", "5512345678", "MX", "INTL_00_PREFIX(E164_MX)", "HIGH"),
    ("0052123456", None, None, None, "INTL_00_PREFIX(ANOMALY)", "MX (+52) number too short: 52123456"),
    ("00123456", "RAW_SHORT", "00123456", "UNKNOWN", "SHORT_CODE_LEN8", "LOW"),
    ("01 55 1234 5678", "TEN_DIGIT", "5512345678", "MX", "MX_TOLLFREE_01", "MEDIUM"),
    ("0155123456", "TEN_DIGIT", "0155123456", "UNKNOWN", "BARE_10", "MEDIUM"),
    ("01551234567", None, None, None, "ANOMALY", "Unrecognized digit length: 11"),
    ("1 212 555 0100", "TEN_DIGIT", "2125550100", "US", "BARE_11_LEADING1", "MEDIUM"),
    ("52 55 1234 5678", "TEN_DIGIT", "5512345678", "MX", "BARE_12_COUNTRY52", "MEDIUM"),
    ("(+52) 55 1234 5678", "TEN_DIGIT", "5512345678", "MX", "BARE_12_COUNTRY52", "MEDIUM"),
    ("521 55 1234 5678", "TEN_DIGIT", "5512345678", "MX", "BARE_13_COUNTRY521", "MEDIUM"),
    ("5255123456789", None, None, None, "ANOMALY", "Unrecognized digit length: 13"),
    ("2125550100 x55", None, None, None, "ANOMALY", "Unrecognized digit length: 12"),
    ("555–1234", "RAW_SHORT", "555-1234", "UNKNOWN", "SHORT_CODE_LEN7", "LOW"),
    ("5551234", "RAW_SHORT", "5551234", "UNKNOWN", "SHORT_CODE_LEN7", "LOW"),
    ("411", "RAW_SHORT", "411", "UNKNOWN", "VERY_SHORT_CODE_LEN3", "LOW"),
    ("*86", "RAW_SHORT", "*86", "UNKNOWN", "VERY_SHORT_CODE_LEN2", "LOW"),
    ("n/a", None, None, None, "ANOMALY", "No digits found in token"),
    ("+", None, None, None, "ANOMALY", "No digits found in token"),
]


def test_golden_tokens(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, v string")
    got = {r["i"]: r["p"] for r in df.select("i", parse_phones(F.col("v")).alias("p")).collect()}
    for i, (raw, kind, key, country, category, last) in enumerate(GOLDEN):
        (p,) = got[i]
        assert (p["key_type"], p["canonical_key"], p["country"], p["category"]) == (kind, key, country, category), raw
        assert (p["warning"] if kind is None else p["confidence"]) == last, raw


@pytest.mark.parametrize(
    "cell, raws",
    [(None, []), ("", []), (" \t", []), ("411 ::: ::: 55", ["411", "55"]), (":::", []), ("a:::b", ["a", "b"]), (" 1 :::", ["1"]), ("411\u00a0 ::: ", ["411\u00a0"])],
)
def test_cells(spark, cell, raws):
    r = spark.createDataFrame([(cell,)], "v string").select(parse_phones(F.col("v")).alias("p")).first()
    assert [x["raw"] for x in r["p"]] == raws


def test_long_cell(spark):
    r = spark.createDataFrame([(" ::: ".join(["5512345678"] * 50_000),)], "v string").select(F.size(parse_phones(F.col("v"))).alias("n")).first()
    assert r["n"] == 50_000


def test_render(spark):
    data = [("TEN_DIGIT", "MX", "1"), ("TEN_DIGIT", "US", "1"), ("TEN_DIGIT", "UNKNOWN", "1"), ("E164_FULL", "OTHER", "+44"), ("RAW_SHORT", "UNKNOWN", "*86")]
    df = spark.createDataFrame(data, "t string, c string, k string")
    assert [r[0] for r in df.select(render_phone(F.col("t"), F.col("c"), F.col("k"))).collect()] == ["+521", "+11", "1", "+44", "*86"]


def test_single_texts_follow_the_same_rules(spark, sf):
    r = random.Random(3)
    cells = [g[0] for g in GOLDEN] + [x for row in spark.read.parquet(f"{sf}/contact_rows.parquet").select("phone_1_value", "phone_2_value").collect() for x in row]
    lead = ["", "+", "00", "01", "1", "52", "521", "+52", "+521", "+1", "0052", "(+52) ", "*", "x", "\u00a0", "\u2013"]
    cells += [":::".join(r.choice(lead) + "".join(r.choice("0123456789 -\u2012\u0663") for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 3))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, v string").select("i", parse_phones(F.col("v")).alias("p"))
    for row in df.collect():
        mine = [tuple(p) for p in row["p"]]
        usable, rejected = (sorted(vars(p).items() for p in x) for x in parse_field(cells[row["i"]]))
        want = [sorted(p.asDict().items() for p in row["p"] if (p["key_type"] is None) == bad) for bad in (False, True)]
        assert [[dict(x) for x in usable], [dict(x) for x in rejected]] == [[dict(x) for x in w] for w in want], cells[row["i"]]
        assert len(mine) == len(usable) + len(rejected)
