"""People from shared phones: greedy clustering in key order under a size cap.

The rule is sequential: keys come by (occurrences, key); a key joins the clusters of its rows unless
they would hold more than ``cap`` rows together, in which case the whole key is refused. It splits
exactly into independent parts:

1. Keys on fewer than two rows join nothing; keys on more than ``cap`` rows are always refused, since
   their clusters hold all those rows. This also takes the hot keys out of every join that follows.
2. Over the other keys (at most ``cap`` rows each) connected components are independent of each other.
3. Within a component the keys are replayed in order, as a stream sorted by component and key.
4. Components too large for one task are replayed by all of them, in rounds. Cluster sizes only grow, so
   a key whose clusters hold more than ``cap`` rows now will be refused in its turn and can go at once. A
   key that is the earliest of those pending at every cluster it touches cannot be affected by any key
   before it, so all such keys take their turn together. Where a round takes few links off, as on a chain whose
   keys rise along it, one task streams the rest in key order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import LOCAL_EDGES, components
from .contacts import ContactTable, key_index, phone_occurrences, without_spam
from .skew import hot_limit, spread_join

# Fixed value: rows a cluster may hold.
CLUSTER_CAP = 10
#: Rows of a component, or links still pending after some rounds, that one task replays alone.
REPLAY_ROWS = 200_000
#: A round that takes off no more than one in so many pending links is the last one.
SLOW_SHARE = 100

_EVENT_SCHEMA = "kind string, node long, cluster long, size int, key string, n_occ long, total long"


@dataclass(frozen=True)
class Clusters:
    """``members``: row_id, cluster_id (smallest row of the cluster), every row off the blocklist.

    ``conflicts``: key, occurrences, total; ``conflict_rows``: key, row_id, phone_ord, source_file, source_row;
    ``phones``: the ``phone_occurrences`` they came from, written.
    """

    members: DataFrame
    conflicts: DataFrame
    conflict_rows: DataFrame
    phones: DataFrame


def key_order(key: Column) -> Column:
    """Sorts strings by UTF-16 code units, as the replay's tie-break asks."""
    return F.encode(key, "UTF-16BE")


class _Replay:
    """Union-find of one component under the cap; nodes are rows, or clusters of several rows."""

    def __init__(self, cap: int) -> None:
        self.cap = cap
        self.root: dict[int, int] = {}
        self.nodes: dict[int, list[int]] = {}
        self.size: dict[int, int] = {}

    def key(self, nodes: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int, int]]]:
        """Would-be total of a key's (node, rows), 0 where there is nothing to join; (node, cluster, size) of nodes that moved."""
        for v, weight in nodes:
            if v not in self.root:
                self.root[v], self.nodes[v], self.size[v] = v, [v], weight
        roots = list(dict.fromkeys(self.root[v] for v, _ in nodes))
        if len(roots) < 2:
            return 0, []
        total = sum(self.size[r] for r in roots)
        if total > self.cap:
            return total, []
        name, merged = min(roots), []
        for r in roots:
            merged += self.nodes.pop(r)
            del self.size[r]
        self.nodes[name], self.size[name] = merged, total
        for v in merged:
            self.root[v] = name
        return total, [(v, name, total) for v in merged]


def _replay(cap: int):
    """Replay of rows (root, n_occ, key, node, weight), sorted by component and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in ("kind", "node", "cluster", "size", "key", "n_occ", "total")}

        def emit(*values) -> None:
            for k, v in zip(out, values):
                out[k].append(v)

        def flush() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))
            for v in out.values():
                v.clear()
            return batch

        part, group, state = None, None, _Replay(cap)
        nodes: list[tuple[int, int]] = []

        def close() -> None:
            if group is None:
                return
            key, n_occ = group
            total, moved = state.key(nodes)
            if total > cap:
                emit("refused", None, None, None, key, n_occ, total)
            for v, name, size in moved:
                emit("moved", v, name, size, key, n_occ, None)

        for b in batches:
            for c, n, k, v, w in zip(*(x.to_pylist() for x in b.columns)):
                if c != part or (k, n) != group:
                    close()
                    if c != part:
                        part, state = c, _Replay(cap)
                    group, nodes = (k, n), []
                nodes.append((v, w))
            if len(out["kind"]) > 20_000:
                yield flush()
        close()
        yield flush()

    return run


def _stream(links: DataFrame, cap: int) -> DataFrame:
    """Events of links (root, n_occ, key, node, weight), each component in one task as a sorted stream."""
    at = key_order(F.col("key"))
    ordered = links.withColumn("at", at).repartition("root").sortWithinPartitions("root", "n_occ", "at", "node")
    return ordered.select("root", "n_occ", "key", "node", "weight").mapInArrow(_replay(cap), _EVENT_SCHEMA)


def _in_rounds(links: DataFrame, cap: int, alone: int) -> list[DataFrame]:
    """Events of links (n_occ, key, row_id) replayed by rounds of keys that cannot affect each other.

    A key has at most ``cap`` rows, so every array here is as short. Once at most ``alone`` links are
    pending, or rounds take hardly any off, one task replays the rest, on clusters instead of rows. So the
    pending links fall by a hundredth in every round but the last, which bounds the rounds.
    """
    state = cut(links.select("row_id", F.col("row_id").alias("cluster"), F.lit(1).alias("size")).distinct(), "state")
    pending, events = links.select("n_occ", "key", "row_id"), []
    cluster = F.struct("cluster", "size")
    before = None
    while True:
        keys = pending.join(state, "row_id").groupBy("n_occ", "key").agg(F.collect_set(cluster).alias("cs"), F.collect_list("row_id").alias("rs"))
        total = F.aggregate("cs", F.lit(0), lambda x, c: x + c["size"])
        keys = cut(keys.filter(F.size("cs") > 1).withColumn("total", total), "pending")
        events.append(
            keys.filter(F.col("total") > cap).select(
                F.lit("refused").alias("kind"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("cluster"),
                F.lit(None).cast("int").alias("size"), "key", "n_occ", F.lit(None).cast("long").alias("total"),
            )
        )
        live = keys.filter(F.col("total") <= cap)
        left = live.agg(F.sum(F.size("cs"))).first()[0] or 0
        if left <= alone or (before is not None and before - left <= before / SLOW_SHARE):
            flat = live.select(F.lit(0).cast("long").alias("root"), "n_occ", "key", F.explode("cs").alias("c"))
            rest = cut(_stream(flat.select("root", "n_occ", "key", F.col("c.cluster").alias("node"), F.col("c.size").alias("weight")), cap), "events")
            moved = rest.filter("kind = 'moved'").select(F.col("node").alias("c"), F.col("cluster").alias("to"), F.col("size").alias("grown"), "key", "n_occ")
            rows = state.join(moved, F.col("cluster") == F.col("c"))
            events += [rest.filter("kind = 'refused'"), _row_moves(rows)]
            return events
        before = left
        turn = F.struct("n_occ", key_order(F.col("key")).alias("at"))
        touch = live.select("n_occ", "key", turn.alias("turn"), F.explode("cs.cluster").alias("cluster"))
        first = touch.groupBy("cluster").agg(F.min("turn").alias("first"))
        ready = touch.join(first, "cluster").groupBy("n_occ", "key").agg(F.min(F.col("turn") == F.col("first")).alias("ready"))
        marked = cut(live.join(ready, ["n_occ", "key"]), "marked")
        moves = marked.filter("ready").select(
            "key", "n_occ", F.explode("cs.cluster").alias("c"), F.array_min("cs.cluster").alias("to"), F.col("total").cast("int").alias("grown")
        )
        rows = cut(state.join(moves, F.col("cluster") == F.col("c"), "left"), "state")
        events.append(_row_moves(rows.filter("c IS NOT NULL")))
        state = rows.select("row_id", F.coalesce("to", "cluster").alias("cluster"), F.coalesce("grown", "size").alias("size"))
        pending = marked.filter("NOT ready").select("n_occ", "key", F.explode("rs").alias("row_id"))


def _row_moves(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.lit("moved").alias("kind"), F.col("row_id").alias("node"), F.col("to").alias("cluster"), F.col("grown").alias("size"), "key", "n_occ",
        F.lit(None).cast("long").alias("total"),
    )


def capped_clusters(t: ContactTable, cap: int = CLUSTER_CAP, local_edges: int = LOCAL_EDGES, replay_rows: int = REPLAY_ROWS) -> Clusters:
    """Cluster rows by shared phone under ``cap``; see the module text.

    Rows without phones are clusters of one; blocklisted rows take no part. Empty tables give empty
    results. A component of at most ``replay_rows`` rows is replayed as one sorted stream, a larger one
    in rounds.
    """
    spark = t.df.sparkSession
    occ = cut(phone_occurrences(t), "occ")
    total = occ.count()
    index = cut(key_index(occ).filter("n_rows >= 2"), "keys")
    # hot keys are hubs; they are kept out of joins by key, which would put each into one task
    is_hot = (F.col("n_rows") > cap) & (F.col("n_occ") > hot_limit(spark, total))
    hot = F.broadcast(cut(index.filter(is_hot).select("key", F.col("n_occ").alias("occurrences")), "hot"))
    held = occ.select("key", "row_id").distinct()
    cold = held.join(hot, "key", "left_anti")
    usable = index.filter(F.col("n_rows") <= cap).select("key", "n_occ", "first_row")
    links = cut(cold.join(usable, "key"), "links")
    comp = cut(components(links.select("first_row", "row_id"), "first_row", "row_id", local_edges), "components")
    sizes = comp.groupBy("root").agg(F.count("*").alias("rows"))
    placed = links.join(comp, links.row_id == comp.v).select("root", "n_occ", "key", "row_id")
    placed = cut(spread_join(placed, sizes, ["root"], sizes.filter(F.col("rows") > hot_limit(spark, total) / cap).select("root")), "placed")
    small = placed.filter(F.col("rows") <= replay_rows).select("root", "n_occ", "key", F.col("row_id").alias("node"), F.lit(1).alias("weight"))
    events = cut(_stream(small, cap), "events")
    large = placed.filter(F.col("rows") > replay_rows)
    if not large.isEmpty():
        for e in _in_rounds(large, cap, replay_rows):
            events = events.unionByName(e)
    moved = events.filter("kind = 'moved'").withColumnRenamed("node", "row_id")
    final = moved.groupBy("row_id").agg(F.min("cluster").alias("cluster"))
    rows = without_spam(t).df.select("row_id")
    members = rows.join(final, "row_id", "left").select("row_id", F.coalesce("cluster", "row_id").alias("cluster_id"))

    # The total of a key refused ahead of its turn counts the clusters as they stood when that came.
    refused = events.filter("kind = 'refused'").select("key", F.col("n_occ").alias("occurrences"), "total")
    hubs = index.filter((F.col("n_rows") > cap) & ~is_hot).select("key", F.col("n_occ").alias("occurrences"))
    hubs = hubs.union(refused.filter("total IS NULL").select("key", "occurrences"))
    at = lambda n, k: F.struct(F.col(n).alias("n"), key_order(F.col(k)).alias("k"))
    hub_rows = held.join(hot, "key").unionByName(cold.join(hubs, "key"))
    past = moved.select(F.col("row_id").alias("r"), "cluster", "size", at("n_occ", "key").alias("at"))
    stood = (
        hub_rows.withColumn("turn", at("occurrences", "key"))
        .join(past, (F.col("row_id") == F.col("r")) & (F.col("at") < F.col("turn")), "left")
        .groupBy("key", "occurrences", "row_id")
        .agg(F.max(F.struct("at", "cluster", "size")).alias("last"))
        .select("key", "occurrences", F.coalesce("last.cluster", "row_id").alias("cluster"), F.coalesce("last.size", F.lit(1)).alias("size"))
        .distinct()
    )
    hub_totals = stood.groupBy("key", "occurrences").agg(F.sum("size").alias("total"))
    conflicts = refused.filter("total IS NOT NULL").union(hub_totals)
    where = t.df.select("row_id", "source_file", "source_row")
    refused_rows = occ.join(hot, "key", "left_semi").union(occ.join(hot, "key", "left_anti").join(conflicts.select("key"), "key", "left_semi"))
    conflict_rows = refused_rows.join(where, "row_id").select("key", "row_id", "phone_ord", "source_file", "source_row")
    return Clusters(members, conflicts, conflict_rows, occ)
