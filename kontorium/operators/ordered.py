"""Running numbers and predecessors over ordered groups, of which one may hold most rows.

A window over such a group would put it into one task. Here rows are range-partitioned by group and
order, so a large group spans many partitions; what crosses a partition border is carried over from a
table with a few rows per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _ranged(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    # without a number, so that adaptive execution may join small neighbouring ranges
    return cut(df.repartitionByRange(*group, *order).withColumn("_pid", F.spark_partition_id()), "ranged")


def number_within(df: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Add ``name``: 1, 2, ... within each group by ``order`` (null first, as in an ascending sort).

    ``order`` must be unique within a group. Null group values form one group. Empty input gives none.
    """
    ranged = _ranged(df, group, order)
    g = F.struct(*[F.col(c) for c in group])
    edges = ranged.groupBy("_pid").agg(F.min(g).alias("first")).select("_pid", "first.*")
    # rows of each partition's first group in the partitions before it: at most two rows a partition
    starts = edges.select(*group).distinct()
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]
    counts = (
        ranged.groupBy("_pid", *group).agg(F.count("*").alias("k")).alias("r")
        .join(F.broadcast(starts.alias("s")), same, "left_semi")
    )
    before = counts.select(
        "_pid", *group,
        F.coalesce(F.sum("k").over(Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    on = [F.col("a._pid") == F.col("b._pid"), *[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]]
    here = F.row_number().over(Window.partitionBy("_pid", *group).orderBy(*order))
    numbered = ranged.withColumn("_here", here).alias("a").join(F.broadcast(before.alias("b")), on, "left")
    total = (F.col("_here") + F.coalesce(F.col("_before"), F.lit(0))).cast("long")
    return numbered.select(*[F.col(f"a.`{c}`") for c in df.columns], total.alias(name))


def with_previous(df: DataFrame, group: list[str], order: list[str], values: list[str], prefix: str = "prev_") -> DataFrame:
    """Add ``prefix`` + value of the row before, within each group by ``order``; null for the first.

    ``order`` must be unique within a group. Null group values form one group. Empty input gives none.
    """
    ranged = _ranged(df, group, order)
    w = Window.partitionBy("_pid", *group).orderBy(*order)
    rec = F.struct(F.lit(True).alias("is"), *[F.col(c).alias(c) for c in values])
    here = ranged.withColumn("_prev", F.lag(rec).over(w))
    # the last row of a partition precedes the first row of the next partition that holds any
    last = ranged.groupBy("_pid").agg(F.max(F.struct(*[F.col(c) for c in [*group, *order]], F.struct(*values).alias("_v"))).alias("m"))
    tails = last.select(
        "_pid",
        *[F.lag(f"m.{c}").over(Window.orderBy("_pid")).alias(f"_t_{c}") for c in group],
        F.lag(F.struct(F.lit(True).alias("is"), *[F.col(f"m._v.{c}").alias(c) for c in values])).over(Window.orderBy("_pid")).alias("_tail"),
    )
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    joined = here.join(F.broadcast(tails), "_pid", "left")
    prev = F.when(F.col("_prev").isNotNull(), F.col("_prev")).when(same, F.col("_tail"))
    full = joined.withColumn("_p", prev)
    return full.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_p.{c}").alias(prefix + c) for c in values])
