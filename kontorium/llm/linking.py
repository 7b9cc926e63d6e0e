"""Groups of records linked by pairwise matches.

The graph is reduced before it is solved. Each round strips the vertices of degree one and compresses
the paths of degree-two vertices into single edges, ranking each path by pointer jumping; what was
removed keeps a pointer to a vertex that stays. Trees and chains of any length thus vanish in a
logarithmic number of rounds. What is left (every vertex of degree three or more, and pure rings) goes
to the component solver, and the pointers carry its labels back.

Every join of the reduction is keyed by an edge, which is unique, so a star's centre is no hot key. Where labels
come back, to a star's leaves or a group's members, hot parents and hot groups are broadcast instead of shuffled.
A graph, or a set of chains, that is small enough for one task (counted) is finished there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import LOCAL_EDGES, components
from ..operators.skew import hot_keys, hot_limit, spread_join
from ..session import cut, drop

#: Rounds after which the reduction fails loudly; each takes a share of the removable vertices.
MAX_ROUNDS = 100


def _degrees(e: DataFrame) -> DataFrame:
    """``v, k, p, q``: degree, smallest and largest neighbour of each vertex."""
    both = e.select(F.col("a").alias("v"), F.col("b").alias("n")).union(e.select(F.col("b").alias("v"), F.col("a").alias("n")))
    return both.groupBy("v").agg(F.count("*").alias("k"), F.min("n").alias("p"), F.max("n").alias("q"))


def rank_pointers(f: np.ndarray, t: np.ndarray, nf: np.ndarray, nt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each pointer's path ends, whether it goes round a ring) by doubling on arrays."""
    ids, code = np.unique(np.concatenate([f, t, nf, nt]), return_inverse=True)
    cf, ct, cnf, cnt = np.split(code.astype(np.int64), 4)
    own, ahead = cf * len(ids) + ct, cnf * len(ids) + cnt
    order = np.argsort(own)
    at = np.searchsorted(own, ahead, sorter=order)
    at[at == len(own)] = 0
    hit = order[at]
    known = own[hit] == ahead
    # a pointer to what is no pointer itself has arrived; it leads to itself from then on
    nxt = np.where(known, hit, np.arange(len(own)))
    for _ in range(int(len(own)).bit_length() + 1):
        nxt = nxt[nxt]
    return nt[nxt], known[nxt]


def _rank_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches))
    if table.num_rows:
        f, t, nf, nt = (c.to_numpy() for c in table.columns)
        end, ring = rank_pointers(f, t, nf, nt)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f, t, end, ring)], ["f", "t", "nt", "moved"])


def _rank_chains(deg: DataFrame, inner_count: int, local: int) -> tuple[DataFrame, DataFrame | None]:
    """(``v, lo, hi`` of each degree-two vertex on a path: where the path ends; ``a, b`` of the rings).

    A pointer leads from one directed edge into a degree-two vertex to the next; each step follows four
    pointers, until one enters a vertex of another degree. On a ring none ever does. Up to ``local`` pointers are ranked in one task.
    """
    inner = deg.filter("k = 2")
    ahead = inner.select(F.col("p").alias("f"), F.col("v").alias("t"), F.col("v").alias("nf"), F.col("q").alias("nt"))
    back = inner.select(F.col("q").alias("f"), F.col("v").alias("t"), F.col("v").alias("nf"), F.col("p").alias("nt"))
    if 2 * inner_count <= local:
        cur = cut(ahead.union(back).coalesce(1).mapInArrow(_rank_batches, "f long, t long, nt long, moved boolean"), "chain")
        moved = not cur.filter("moved").isEmpty()
    else:
        cur, moved = _rank_steps(ahead.union(back))
    ends = cur.filter("NOT moved").groupBy("t").agg(F.min("nt").alias("lo"), F.max("nt").alias("hi")).select(F.col("t").alias("v"), "lo", "hi")
    if not moved:
        return ends, None
    return ends, cur.filter("moved").select(F.least("f", "t").alias("a"), F.greatest("f", "t").alias("b")).distinct()


def _rank_steps(pointers: DataFrame) -> tuple[DataFrame, int]:
    """(pointers ``f, t, nf, nt, moved`` that have arrived or go round a ring, number of the latter)."""
    cur, before = cut(pointers.withColumn("moved", F.lit(True)), "chain"), -1
    while True:
        step = cur.select("f", "t", "nf", "nt")
        for i in range(3):
            nxt = cur.select(*[F.col(c).alias(f"{c}{i}") for c in ("f", "t", "nf", "nt")])
            hop = step.join(nxt, (F.col("nf") == F.col(f"f{i}")) & (F.col("nt") == F.col(f"t{i}")), "left")
            step = hop.select("f", "t", F.coalesce(f"nf{i}", "nf").alias("nf"), F.coalesce(f"nt{i}", "nt").alias("nt"), F.col(f"f{i}").isNotNull().alias("moved"))
        new = cut(step, "chain")
        drop(cur)
        cur = new
        moved = cur.filter("moved").count()
        # on a path some pointer arrives in every step; when none does, only rings still move
        if moved in (0, before):
            return cur, moved
        before = moved


def _reduce(e: DataFrame, local: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(edges that are left, rings apart; per round ``v, parent`` of the vertices removed).

    Ends where nothing is left to remove, or after a round that leaves at most ``local`` edges.
    """
    removed: list[DataFrame] = []
    rings: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        deg = cut(_degrees(e), "degrees")
        leaves, inner = deg.agg(F.count_if(F.col("k") == 1), F.count_if(F.col("k") == 2)).first()
        if not leaves and not inner:
            return [e, *rings], removed
        ends = ring = None
        if inner:
            found, ring = _rank_chains(deg, inner, local)
            ends = cut(found, "ends")
            if ring is not None:  # a ring of degree-two vertices is a whole component: nothing else reduces it
                ring = cut(ring, "rings")
                rings.append(ring)
        low = deg.filter("k <= 2")
        sides = low.select("v", "k", F.explode(F.array_distinct(F.array("p", "q"))).alias("n"))
        pairs = sides.groupBy(F.least("v", "n").alias("a"), F.greatest("v", "n").alias("b")).agg(
            F.count_if(F.col("k") == 1).alias("leaves"), F.count_if(F.col("k") == 2).alias("inner"), F.max(F.when(F.col("k") == 1, F.col("v"))).alias("leaf")
        )
        # a leaf next to a chain is that chain's end and stays for this round
        raked = pairs.filter("leaves > 0 AND inner = 0").select(
            "a", "b", F.col("leaf").alias("v"), F.when(F.col("leaf") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("parent")
        )
        gone = raked.select("v", "parent")
        dead = raked.select("a", "b")
        if ends is not None:
            gone = gone.union(ends.select("v", F.col("lo").alias("parent")))
            sides2 = ends.join(deg, "v").select("v", F.explode(F.array("p", "q")).alias("n"))
            dead = dead.union(sides2.select(F.least("v", "n").alias("a"), F.greatest("v", "n").alias("b")))
        if ring is not None:
            dead = dead.union(ring)
        removed.append(cut(gone, "removed"))
        left = e.join(dead.distinct(), ["a", "b"], "left_anti")
        if ends is not None:
            left = left.union(ends.filter("lo < hi").select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        new = cut(left.distinct(), "left")
        if len(removed) > 1:  # the first edges are read once more for the vertices
            drop(e)
        e = new
        rest = e.count()
        if not rest:
            return rings or [e], removed
        if rest <= local:
            return [e, *rings], removed
    raise RuntimeError(f"the graph did not reduce in {MAX_ROUNDS} rounds")


def linked_groups(pairs: DataFrame, a: str, b: str, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``row_id, group_id``: each record linked to another, with the smallest record of its group.

    Pairs may repeat and come in either order; pairs with a null side or of a record with itself link
    nothing. Empty input gives no rows. Other columns are ignored.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    links = pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), x.isNull().alias("nx"), y.isNull().alias("ny"))
    first = cut(links.filter("NOT nx AND NOT ny AND a < b").select("a", "b").distinct(), "links")
    total = first.count()
    left, removed = _reduce(first, local_edges)
    rest = left[0]
    for x in left[1:]:
        rest = rest.union(x)
    core = components(rest, local_edges=local_edges)
    labelled = core.select("v", F.col("root").alias("g"))
    if removed:
        forest = removed[0]
        for r in removed[1:]:
            forest = forest.union(r)
        # a parent leaves in a later round than its children, so the depth is at most the rounds
        reach = 1
        while reach < len(removed):
            up = forest.select(F.col("v").alias("parent"), F.col("parent").alias("above"))
            risen = spread_join(forest, up, ["parent"], hot_keys(forest, ["parent"], total), "left")
            forest = cut(risen.select("v", F.coalesce("above", "parent").alias("parent")), "forest")
            reach *= 2
        core = cut(core, "core")
        roots = core.select(F.col("v").alias("parent"), "root")
        back = cut(spread_join(forest, roots, ["parent"], hot_keys(forest, ["parent"], total), "left"), "restored")
        # the last vertex of a tree is in no edge that is left
        last = back.filter("root IS NULL").select(F.col("parent").alias("v")).distinct()
        labelled = core.select("v", F.col("root").alias("g")).union(back.select("v", F.coalesce("root", "parent"))).union(last.select("v", "v"))
    labelled = cut(labelled, "labelled")
    smallest = labelled.groupBy("g").agg(F.min("v").alias("group_id"), F.count("*").alias("k"))
    hot = smallest.filter(F.col("k") > hot_limit(pairs.sparkSession, total)).select("g")
    return spread_join(labelled, smallest.drop("k"), ["g"], hot).select(F.col("v").alias("row_id"), "group_id")
