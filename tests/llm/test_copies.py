import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import rows
from kontorium.llm import copies
from kontorium.llm.copies import CountingTrie, canonical_contacts, count_copies, counted_buckets, radix_labels
from kontorium.operators.skew import hot_limit

KEYED = "row_id long, canonical string, key string, bucket int"


def counted(data):
    out = {}
    for row, key in data:
        k = key or ""
        n, r = out.get(k, (0, row))
        out[k] = (n + 1, min(r, row))
    return sorted(((r, n) for n, r in out.values()), key=repr)


def frame(spark, data):
    return spark.createDataFrame([(r, k, "x", 1) for r, k in data], KEYED)


def test_trie():
    r = random.Random(1)
    t, want = CountingTrie(), {}
    for i in range(5000):
        k = bytes(r.choice(b"ab") for _ in range(r.randint(0, 12)))
        t.add(k, 2, i)
        n, row = want.get(k, (0, i))
        want[k] = (n + 2, min(row, i))
    assert {k: (n, row) for k, n, row in t.items()} == want and t.size == len(want)


@pytest.mark.parametrize("fit", [1, 7, 100, 10**6])
def test_counts(spark, fit, monkeypatch):
    monkeypatch.setattr(copies, "SPLIT_KEYS", 50)
    r = random.Random(fit)
    data = [(i, "hot copy" if r.random() < 0.4 else "same start " * 3 + "".join(r.choice("abé\x1f") for _ in range(r.randint(0, 5)))) for i in range(1500)]
    data += [(2000, None), (2001, ""), (2002, None)]
    assert rows(count_copies(frame(spark, data).repartition(5), "canonical", "row_id", fit)) == counted(data)


def entries(spark, keys):
    return spark.createDataFrame([(k.encode(), 1, i) for i, k in enumerate(keys)], "key binary, n long, row_id long")


def test_buckets_fit(spark):
    """Half a million keys of which many share long beginnings: every bucket holds at most fifty."""
    df = spark.range(500_000).select(
        F.encode(F.concat(F.when(F.col("id") % 3 == 0, "a beginning that a third shares ").otherwise(F.lit("")), F.hex(F.xxhash64("id"))), "UTF-8").alias("key"),
        F.lit(1).cast("long").alias("n"), F.col("id").alias("row_id"),
    )
    got = counted_buckets(df, 50)
    sizes = got.groupBy("label").count()
    assert sizes.agg(F.max("count")).first()[0] <= 50
    assert rows(got.agg(F.count("*"), F.countDistinct("row_id"), F.sum("copies"))) == [(500_000, 500_000, 500_000)]


def test_no_label_is_hot(spark):
    keys = sorted({f"prefix {i * 7919 % 1000:04d}" for i in range(1000)}) + ["equal"] * 300
    found = rows(radix_labels(entries(spark, keys)).groupBy("label").agg(F.count("*"), F.countDistinct("key")))
    assert all(n <= hot_limit(spark, 1300) or k == 1 for _, n, k in found) and sum(n for _, n, _ in found) == 1300


def test_long_and_empty(spark):
    data = [(1, "x" * 1_000_000), (2, "x" * 1_000_000), (3, "x" * 1_000_000 + "y"), (4, "x")]
    assert rows(count_copies(frame(spark, data), "canonical", "row_id", 1)) == counted(data)
    assert rows(count_copies(frame(spark, data).limit(0), "canonical", "row_id")) == []


CONTACT = ["first_name", "middle_name", "last_name", "name_prefix", "name_suffix", "nickname", "organization_name", "address_1_formatted", "photo", "email_1_value", "email_2_value", "website_1_value", "notes", "labels"]


def contacts(spark, cells):
    data = [(i, "f", *[c.get(f) for f in CONTACT]) for i, c in enumerate(cells, 1)]
    return spark.createDataFrame(data, "row_id long, numbers string, " + ", ".join(f"{f} string" for f in CONTACT))


def phones(spark, data):
    return spark.createDataFrame(data, "row_id long, key_type string, canonical_key string")


def groups(spark, cells, numbers=()):
    out = {}
    for r in canonical_contacts(contacts(spark, cells), phones(spark, list(numbers))).collect():
        out.setdefault(r["canonical"], []).append(r["row_id"])
    return sorted(sorted(g) for g in out.values())


def test_what_makes_a_copy(spark):
    cells = [
        {"first_name": "Ána", "last_name": "Gil Paz", "labels": 'VIP; "A, b"', "email_1_value": "x@y.z", "organization_name": "S.A. de C.V."},
        {"first_name": "PAZ", "nickname": "gil  ÁNA", "labels": "a b, vip , VIP", "email_2_value": "<X@Y.Z>", "organization_name": "s a DE c v", "notes": " - "},
        {"first_name": "Ana", "last_name": "Gil Paz", "labels": 'VIP; "A, b"', "email_1_value": "x@y.z", "organization_name": "S.A. de C.V."},
        {"first_name": "Ána", "last_name": "Gil Paz Paz", "labels": 'VIP; "A, b"', "email_1_value": "x@y.z", "organization_name": "S.A. de C.V."},
        {"first_name": "Ána", "last_name": "Gil Paz", "labels": "VIP A b", "email_1_value": "x@y.z", "organization_name": "S.A. de C.V."},
        {},
        {"first_name": " ", "labels": ";"},
    ]
    assert groups(spark, cells) == [[1, 2], [3], [4], [5], [6, 7]]


def test_numbers_are_a_set(spark):
    numbers = [(1, "RAW_SHORT", "070-4400"), (1, "RAW_SHORT", "070-4400"), (1, None, None), (2, "RAW_SHORT", "070 4400"), (3, "TEN_DIGIT", "0704400")]
    assert groups(spark, [{"first_name": "a"}] * 4, numbers) == [[1, 2], [3], [4]]


def test_table_against_brute_force(spark, sf):
    import pandas as pd

    c = pd.read_parquet(f"{sf}/contact_rows.parquet")
    p = pd.read_parquet(f"{sf}/phones.parquet")
    from test_packed import brute

    word = lambda v: " ".join(re.findall(r"[^\W_]+", (v or "").lower()))
    numbers = {}
    for r, t, k in zip(p.row_id, p.key_type, p.canonical_key):
        if isinstance(t, str):
            numbers.setdefault(r, set()).add((t, re.sub(r"\D", "", k)))
    out = {}
    for r in c.to_dict("records"):
        r = {k: (v if isinstance(v, str) else None) if k in CONTACT else v for k, v in r.items()}
        key = (
            tuple(sorted(" ".join(word(r[f]) for f in CONTACT[:6]).split())), *[word(r[f]) for f in ("organization_name", "address_1_formatted", "photo", "website_1_value", "notes")],
            frozenset({word(r["email_1_value"]), word(r["email_2_value"])} - {""}), frozenset({word(x) for x in brute("labels", r["labels"] or "")} - {""}),
            frozenset(numbers.get(r["row_id"], ())),
        )
        out.setdefault(key, []).append(r["row_id"])
    want = sorted(((min(g), len(g)) for g in out.values() if len(g) > 1), key=repr)
    from kontorium.llm.queries import all_queries

    assert rows(all_queries()["p4_found"](spark, sf)) == want and want
