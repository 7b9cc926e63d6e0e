"""Joins by keys of which a few may hold most rows.

A key is hot if it has more rows than a quarter of an average shuffle partition. So few can be that their
side of a join is broadcast, whatever the table: at most four times the number of shuffle partitions. The
other keys go through an ordinary join, where none of them makes a partition stand out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_width


def hot_limit(spark: SparkSession, total: int) -> int:
    """Rows of one key, of ``total`` in all, beyond which it is hot."""
    return max(1, total // (4 * shuffle_width(spark)))


def hot_keys(df: DataFrame, on: list[str], total: int, counted: bool = False) -> DataFrame:
    """The hot keys of a table of ``total`` rows; null is none. Counts are combined before the shuffle.

    ``counted`` adds ``rows``, how many rows a key has.
    """
    full = " AND ".join(f"`{c}` IS NOT NULL" for c in on)
    per = df.filter(full).groupBy(*on).agg(F.count("*").alias("rows")).filter(F.col("rows") > hot_limit(df.sparkSession, total))
    return per if counted else per.drop("rows")


def spread_join(big: DataFrame, small: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``big`` joined (inner or left) with ``small``, which has one row per key; ``hot`` lists the hot keys of ``big``.

    Rows of hot keys meet a broadcast of at most as many rows as there are hot keys and are not shuffled.
    Rows with a null key find nothing; a left join keeps them, unshuffled.
    """
    few = F.broadcast(hot.select(*on))
    warm = big.join(few, on, "left_semi").join(F.broadcast(small.join(few, on, "left_semi")), on, how)
    full = " AND ".join(f"`{c}` IS NOT NULL" for c in on)
    cold = big.filter(full).join(few, on, "left_anti").join(small, on, how)
    out = warm.unionByName(cold)
    if how == "left":
        lost = big.filter(f"NOT ({full})")
        out = out.unionByName(lost, allowMissingColumns=True)
    return out


def salted_join(big: DataFrame, small: DataFrame, on: list[str], hot: DataFrame, total: int, by: str) -> DataFrame:
    """Inner join as ``spread_join``, where single rows of ``small`` may be too large to broadcast.

    ``hot`` has counts. A hot key's rows are spread by the column ``by`` over as many salts as it takes for none to be
    hot, and its row of ``small`` is repeated for each; together no more than the hot keys and four rows per shuffle partition for every ``total`` rows of ``big``.
    """
    salts = F.ceil(F.col("rows") / F.lit(hot_limit(big.sparkSession, total))).cast("int")
    few = F.broadcast(hot.select(*on, salts.alias("_salts")))
    spread = big.join(few, on).withColumn("_salt", F.pmod(F.xxhash64(by), F.col("_salts")).cast("int")).drop("_salts")
    repeated = small.join(few, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    warm = spread.join(repeated, [*on, "_salt"]).drop("_salt")
    return warm.unionByName(big.join(few.drop("_salts"), on, "left_anti").join(small, on))
