import random

from pyspark.sql import functions as F

from helpers import rows
from kontorium.operators import keycounts
from kontorium.operators.keycounts import counts_per_key

SCHEMA = "key string, k1 string, item long, owner long, block int"


def test_against_distinct_counts(spark):
    r = random.Random(3)
    data = []
    for i in range(3000):
        key = "hot" if r.random() < 0.5 else f"k{r.randint(0, 300)}"
        data.append((key, r.choice(["x", "y:1", None, ""]), i, r.randint(0, 200), 1))
    data += data[:500]  # delivered twice
    df = spark.createDataFrame(data, SCHEMA)
    want = df.groupBy("key", "k1").agg(F.countDistinct("item"), F.countDistinct("owner"))
    assert rows(counts_per_key(df, ["key", "k1"], "item", "owner")) == rows(want)


def test_folding(spark, monkeypatch):
    df = spark.range(2000).select((F.col("id") % 700).cast("string").alias("key"), F.lit("-").alias("k1"), F.col("id").alias("item"), (F.col("id") % 5).alias("owner"))
    want = df.groupBy("key", "k1").agg(F.countDistinct("item"), F.countDistinct("owner"))
    monkeypatch.setattr(keycounts, "FOLD_AT", 50)
    d = keycounts._Dense()
    import numpy as np
    import pyarrow as pa

    for lo in range(0, 300, 30):
        d.add(pa.array([str(i % 70) for i in range(lo, lo + 30)]), np.zeros(30), np.ones(30), np.ones(30))
    d.fold()
    keys, _, items, _ = d.parts[0]
    assert len(keys) == 70 and items.sum() == 300
    assert rows(counts_per_key(df, ["key", "k1"], "item", "owner")) == rows(want)


def test_nulls_and_empty(spark):
    data = [(None, None, 1, 1, 0), (None, None, 1, 1, 0), ("a", "b", None, 2, 0), ("a", "b", 3, None, 0), ("ab", "", 4, 4, 0), ("a", "b", 5, 2, 0)]
    df = spark.createDataFrame(data, SCHEMA)
    want = df.groupBy("key", "k1").agg(F.countDistinct("item"), F.countDistinct("owner"))
    assert rows(counts_per_key(df, ["key", "k1"], "item", "owner")) == rows(want)
    assert rows(counts_per_key(df.limit(0), ["key", "k1"], "item", "owner")) == []


def test_an_item_under_two_owners_counts_once(spark):
    df = spark.createDataFrame([("k", 1, 1), ("k", 1, 2), ("k", 2, 2), ("k", None, 3), ("n", None, None)], "k string, i long, o long")
    assert rows(counts_per_key(df, ["k"], "i", "o")) == [("k", 2, 3), ("n", 0, 0)]
    text = df.selectExpr("k", "i", "string(o) as o")
    assert rows(counts_per_key(text, ["k"], "i", "o")) == [("k", 2, 3), ("n", 0, 0)]
