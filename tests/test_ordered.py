import random

from pyspark.sql import functions as F

from helpers import rows
from kontorium.operators.ordered import number_within, with_previous


def data(spark, seed=0, n=400):
    r = random.Random(seed)
    out = [(r.choice(["a", "a", "a", "b", None, "c"]), i, r.randint(0, 9)) for i in range(n)]
    r.shuffle(out)
    return out, spark.createDataFrame(out, "g string, o int, v int").repartition(7)


def test_number_within(spark):
    raw, df = data(spark)
    want, seen = [], {}
    for g, o, v in sorted(raw, key=lambda x: x[1]):
        seen[g] = seen.get(g, 0) + 1
        want.append((g, o, v, seen[g]))
    assert rows(number_within(df, ["g"], ["o"])) == sorted(want, key=repr)


def test_with_previous(spark):
    raw, df = data(spark, 1)
    want, last = [], {}
    for g, o, v in sorted(raw, key=lambda x: x[1]):
        want.append((g, o, v, last.get(g)))
        last[g] = v
    assert rows(with_previous(df, ["g"], ["o"], ["v"])) == sorted(want, key=repr)


def test_one_group_and_empty(spark):
    df = spark.range(500).select(F.lit("x").alias("g"), F.col("id").alias("o"))
    assert rows(number_within(df, ["g"], ["o"]).select("o", "n")) == sorted(((i, i + 1) for i in range(500)), key=repr)
    assert with_previous(df, ["g"], ["o"], ["o"]).filter("prev_o = o - 1").count() == 499
    assert rows(number_within(df.limit(0), ["g"], ["o"])) == []
    assert rows(with_previous(df.limit(0), ["g"], ["o"], ["o"])) == []
