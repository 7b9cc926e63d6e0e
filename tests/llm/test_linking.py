import random

import pytest

from helpers import rows
from kontorium.llm.linking import linked_groups

SCHEMA = "a long, b long, v long, k int"


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted(((v, find(v)) for v in root), key=repr)


def check(spark, edges, **kw):
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in edges], SCHEMA)
    assert rows(linked_groups(df, "a", "b", **kw)) == brute(edges)


def shuffled_path(ids, seed=0):
    ids = list(ids)
    random.Random(seed).shuffle(ids)
    return list(zip(ids, ids[1:]))


SHAPES = {
    "edge": [(5, 3)],
    "path": shuffled_path(range(1, 60)),
    "star": [(50, i) for i in range(1, 50)],
    "ring": [*shuffled_path(range(1, 12)), (shuffled_path(range(1, 12))[0][0], shuffled_path(range(1, 12))[-1][1])],
    "ring and tail": [(1, 2), (2, 3), (3, 4), (4, 1), (4, 9), (9, 8), (8, 7)],
    "two rings by a chain": [(1, 2), (2, 3), (3, 1), (3, 10), (10, 11), (11, 12), (12, 20), (20, 21), (21, 22), (22, 20)],
    "dense": [(i, j) for i in range(1, 7) for j in range(i)],
    "caterpillar": [*[(i, i + 1) for i in range(1, 20)], *[(i, 100 + i) for i in range(1, 20)], *[(100 + i, 200 + i) for i in range(1, 20, 3)]],
    "chain back to its anchor": [(1, 2), (2, 3), (3, 1), (1, 4), (1, 5), (5, 6)],
    "repeats": [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (4, None), (None, None)],
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(spark, name):
    check(spark, SHAPES[name])


def test_all_at_once_with_stars(spark):
    edges = [(None if a is None else a + 1000 * k, None if b is None else b + 1000 * k) for k, s in enumerate(SHAPES.values()) for a, b in s]
    check(spark, edges, local_edges=0)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    r = random.Random(seed)
    n = r.randint(5, 80)
    check(spark, [(r.randint(1, n), r.randint(1, n)) for _ in range(int(n * r.choice([0.5, 0.9, 1.3])))])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(linked_groups(df, "a", "b")) == []
