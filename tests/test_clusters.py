import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from kontorium.operators import clusters
from kontorium.operators.clusters import capped_clusters
from kontorium.operators.components import components, solve_edges
from kontorium.operators.contacts import ContactTable


def table(spark, phones, names=None):
    """Contacts 1.. with these phone cells; ``names`` are first names."""
    data = [(i, "f.csv", i + 1, (names or {}).get(i, "x"), p) for i, p in enumerate(phones, 1)]
    df = spark.createDataFrame(data, "row_id long, source_file string, source_row int, c0 string, c1 string")
    return ContactTable(df, ["First Name", "Phone 1 - Value"], ["c0", "c1"])


def model(phones, cap=10):
    """The rule itself, key after key, on keys of plain ten-digit numbers."""
    keys = {}
    for i, cell in enumerate(phones, 1):
        for k in cell.split(" ::: ") if cell else []:
            keys.setdefault("TEN_DIGIT::" + k, []).append(i)
    cluster = {i: {i} for i in range(1, len(phones) + 1)}
    refused = []
    for k, occ in sorted(keys.items(), key=lambda x: (len(x[1]), x[0])):
        parts = {id(cluster[i]): cluster[i] for i in occ}
        if len(parts) < 2:
            continue
        total = sum(map(len, parts.values()))
        if total > cap:
            refused.append((k, len(occ), total))
            continue
        merged = set().union(*parts.values())
        for i in merged:
            cluster[i] = merged
    return sorted((i, min(c)) for i, c in cluster.items()), sorted(refused)


def number(n):
    return str(5500000000 + n)


def check(spark, phones, **kw):
    c = capped_clusters(table(spark, phones), **kw)
    members, refused = model(phones)
    assert rows(c.members) == sorted(members, key=repr)
    assert rows(c.conflicts) == sorted(refused, key=repr)


def test_cap_chain(spark):
    phones = [" ::: ".join(number(k) for k in (i - 1, i) if 0 <= k < 10) for i in range(11)]
    check(spark, phones)
    c = capped_clusters(table(spark, phones))
    assert rows(c.conflicts) == [("TEN_DIGIT::5500000009", 2, 11)]
    assert rows(c.conflict_rows.select("row_id", "source_file", "source_row")) == [(10, "f.csv", 11), (11, "f.csv", 12)]


@pytest.mark.parametrize("n, clusters", [(10, 1), (11, 11)])
def test_hub(spark, n, clusters):
    c = capped_clusters(table(spark, ["411"] * n))
    assert c.members.select("cluster_id").distinct().count() == clusters
    assert c.conflicts.count() == (n > 10)


def test_repeated_number_in_one_row(spark):
    check(spark, [number(1) + " ::: " + number(1), number(2), ""])


def test_spam_and_empty(spark):
    c = capped_clusters(table(spark, ["411", "411", "411"], {2: "no sPaMela"}))
    assert rows(c.members) == [(1, 1), (3, 1)]
    empty = table(spark, ["411"])
    c = capped_clusters(empty.with_df(empty.df.limit(0)))
    assert rows(c.members) == [] and rows(c.conflicts) == [] and rows(c.conflict_rows) == []


@pytest.mark.parametrize("limit", [10**6, 1])
@pytest.mark.parametrize("seed", range(4))
def test_against_model(spark, seed, limit, monkeypatch):
    monkeypatch.setattr(clusters, "hot_limit", lambda *_: limit)  # no hub is hot, or all are
    r = random.Random(seed)
    n = r.randint(1, 90)
    keys = r.randint(1, 60)
    phones = [" ::: ".join(number(int(keys * r.random() ** 2)) for _ in range(r.choice([0, 1, 1, 2, 3]))) for _ in range(n)]
    check(spark, phones)


@pytest.mark.parametrize("alone", [0, 12])
@pytest.mark.parametrize("seed", range(4))
def test_large_components_in_rounds(spark, seed, alone):
    r = random.Random(100 + seed)
    keys = r.choice([25, 60])
    phones = [" ::: ".join(number(int(keys * r.random() ** 1.5)) for _ in range(r.choice([1, 2, 2, 3]))) for _ in range(r.choice([30, 80]))]
    check(spark, phones, replay_rows=alone)


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return sorted((v, find(v)) for v in root)


@pytest.mark.parametrize("local", [10**6, 0])
@pytest.mark.parametrize("seed", range(3))
def test_components(spark, local, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 40), r.randint(0, 40)) for _ in range(30)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7), (500, 500)]
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")
    assert rows(components(df, local_edges=local)) == sorted(brute(edges), key=repr)


def test_components_empty(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert rows(components(df)) == [] and rows(components(df, local_edges=-1)) == []


def test_same_under_other_partitions(spark):
    phones = [number(i % 7) + " ::: " + number(i % 11) for i in range(60)]
    t = table(spark, phones)
    want = rows(capped_clusters(t).members)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert rows(capped_clusters(t.with_df(t.df.repartition(5, F.col("c1")))).members) == want
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_long_chain_of_rising_keys(spark, monkeypatch):
    written = []
    monkeypatch.setattr(clusters, "cut", lambda df, name="step", real=clusters.cut: written.append(name) or real(df, name))
    phones = [" ::: ".join(number(k) for k in (i - 1, i) if 0 <= k < 1500) for i in range(1501)]
    check(spark, phones, replay_rows=1)
    assert written.count("pending") < 10
