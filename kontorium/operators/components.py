"""Connected components of an edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop
from .skew import hot_limit, spread_join

#: Edge lists up to this measured length are solved in one task (about 100 MB there).
LOCAL_EDGES = 500_000
#: Rounds after which the distributed solver gives up loudly; it needs about the square of log2 of the vertices.
MAX_ROUNDS = 200


def solve_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) for edges a-b, by pointer jumping on arrays."""
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(ids))
    while True:
        lx, ly = label[x], label[y]
        low, high = np.minimum(lx, ly), np.maximum(lx, ly)
        if not (low != high).any():
            return ids, ids[label]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def _solve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        v, root = solve_edges(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(root, pa.int64())], ["v", "root"])


def _stars(edges: DataFrame) -> DataFrame:
    """Large-star and small-star contraction until nothing moves; edges end as (v, smallest)."""

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def lowest(d: DataFrame, low: F.Column, limit: int) -> DataFrame:
        """``a, b, m`` of each edge, where ``m`` is what ``low`` gives over the edges at ``a``; a hub is spread over all tasks."""
        per = d.groupBy("a").agg(low.alias("m"), F.count("*").alias("k"))
        return spread_join(d, per.select("a", "m"), ["a"], per.filter(F.col("k") > limit).select("a"))

    def round_(e: DataFrame, edges: int) -> DataFrame:
        limit = hot_limit(e.sparkSession, 2 * edges)
        large = lowest(both(e), F.least(F.min("b"), F.col("a")), limit).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        d2 = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        linked = lowest(d2, F.min("b"), limit)
        return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(linked.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first())

    cur, seen = cut(edges, "stars"), None
    for _ in range(MAX_ROUNDS):
        now = state(cur)
        if now == seen:
            return cur
        new = cut(round_(cur, now[0]), "stars")
        drop(cur)
        cur, seen = new, now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``v, root``: the smallest vertex of the component of each vertex of an edge list (long ids).

    Edges with a null end are ignored; a self-loop alone makes a component of one. Empty input gives
    no rows. Lists of at most ``local_edges`` distinct edges, counted first, are solved in one task;
    longer ones by star contraction, whose rounds end in written tables.
    """
    pairs = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    e = cut(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    if e.count() <= local_edges:
        return e.coalesce(1).mapInArrow(_solve_batches, "v long, root long")
    # a self-loop vanishes in the first round; its vertex comes back by the union below
    vertices = e.select(F.col("a").alias("v")).union(e.select(F.col("b").alias("v"))).distinct()
    found = _stars(e.filter("a != b")).select(F.col("a").alias("v"), F.col("b").alias("r"))
    return vertices.join(found, "v", "left").select("v", F.coalesce("r", "v").alias("root"))
