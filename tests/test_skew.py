import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from kontorium.operators.skew import hot_keys, hot_limit, salted_join, spread_join


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(2)
    big = [(i, r.choice([1] * 30 + [2, None, *range(3, 60)]), "x") for i in range(900)]
    small = [(k, k * 10) for k in range(0, 60, 2)] + [(1, 10)]
    return spark.createDataFrame(big, "i long, k long, v string"), spark.createDataFrame(small, "k long, w long")


def test_hot_keys(spark, tables):
    big, _ = tables
    per = {k: n for k, n in rows(big.filter("k IS NOT NULL").groupBy("k").count())}
    want = {(k, n) for k, n in per.items() if n > hot_limit(spark, 900)}
    assert set(rows(hot_keys(big, ["k"], 900, counted=True))) == want and {(k,) for k, _ in want} == set(rows(hot_keys(big, ["k"], 900)))
    assert want and len(want) <= 16


@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_as_a_join(spark, tables, how):
    big, small = tables
    want = rows(big.join(small, ["k"], how).select("i", "k", "v", "w"))
    for hot in (hot_keys(big, ["k"], 900), big.select("k").limit(0), big.select("k").filter("k IS NOT NULL").distinct()):
        assert rows(spread_join(big, small, ["k"], hot, how).select("i", "k", "v", "w")) == want


def test_salted(spark, tables):
    big, small = tables
    want = rows(big.join(small, ["k"]).select("i", "k", "v", "w"))
    assert rows(salted_join(big, small, ["k"], hot_keys(big, ["k"], 900, counted=True), 900, "i").select("i", "k", "v", "w")) == want
    none = big.limit(0)
    assert rows(salted_join(none, small, ["k"], hot_keys(none, ["k"], 0, counted=True), 0, "i")) == []
    assert rows(spread_join(none, small, ["k"], hot_keys(none, ["k"], 0), "left")) == []
