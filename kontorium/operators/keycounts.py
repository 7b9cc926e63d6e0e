"""Counts per key where a few keys hold most rows: dense accumulator arrays over equal splits.

Rows are first reduced to the distinct items and owners of each key, spread by both, so splits are equal whatever the keys.
Each split encodes its keys by a dictionary of its own, counts with ``numpy.bincount`` into dense arrays
and emits these cut into blocks by key hash. Blocks of the same number are summed by scattering into the
array of the merged dictionary. The hottest key thus costs one array entry per split, not its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width

#: Dictionary entries after which a split or block folds what it has gathered.
FOLD_AT = 500_000

_BLOCK_SCHEMA = "block int, keys array<string>, items array<long>, owners array<long>"


def _encode_key(columns: list[str]) -> Column:
    """One string for several key columns, nulls told from text; ``_decode_key`` undoes it."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns]
    return F.concat(*parts)


def _decode_key(columns: list[str]) -> list[Column]:
    rest, out = F.col("key"), []
    for c in columns:
        null = rest.startswith("-")
        n = F.when(null, F.lit(0)).otherwise(F.substring_index(rest, ":", 1).cast("int"))
        head = F.when(null, F.lit(1)).otherwise(F.length(F.substring_index(rest, ":", 1)) + 2)
        out.append(F.when(~null, F.substr(rest, head, n)).alias(c))
        rest = F.substr(rest, F.when(null, F.lit(2)).otherwise(head + n))
    return out


class _Dense:
    """A dictionary of keys and the dense arrays counted under its codes."""

    def __init__(self) -> None:
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.folded = 0

    def add(self, keys: pa.Array, blocks: np.ndarray, items: np.ndarray, owners: np.ndarray) -> None:
        code = keys.dictionary_encode()
        at = code.indices.to_numpy(zero_copy_only=False)
        n = len(code.dictionary)
        block = np.zeros(n, np.int64)
        block[at] = blocks
        # float64 sums are exact up to 2**53
        self.parts.append((code.dictionary, block, np.bincount(at, items, n).astype(np.int64), np.bincount(at, owners, n).astype(np.int64)))
        self.size += n
        if self.size - self.folded > FOLD_AT:
            self.fold()

    def fold(self) -> None:
        parts, self.parts, self.size, self.folded = self.parts, [], 0, 0
        if not parts:
            return
        keys = pa.concat_arrays([p[0] for p in parts])
        code = keys.dictionary_encode()
        at, n = code.indices.to_numpy(zero_copy_only=False), len(code.dictionary)
        block = np.zeros(n, np.int64)
        block[at] = np.concatenate([p[1] for p in parts])
        sums = [np.bincount(at, np.concatenate([p[i] for p in parts]), n).astype(np.int64) for i in (2, 3)]
        self.parts, self.size, self.folded = [(code.dictionary, block, *sums)], n, n

    def blocks(self) -> Iterator[pa.RecordBatch]:
        self.fold()
        if not self.parts:
            return
        keys, block, items, owners = self.parts[0]
        order = np.argsort(block, kind="stable")
        ids, starts = np.unique(block[order], return_index=True)
        offsets = pa.array(np.append(starts, len(order)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, v) for v in (keys.take(pa.array(order)), pa.array(items[order]), pa.array(owners[order]))]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *lists], ["block", "keys", "items", "owners"])


def _count_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    dense = _Dense()
    for b in batches:
        if b.num_rows:
            dense.add(b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy())
            if dense.size > 2 * FOLD_AT:  # a split of mostly distinct keys hands over what it has
                yield from dense.blocks()
                dense = _Dense()
    yield from dense.blocks()


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the parts of each block; rows come sorted by block."""

    def result(d: _Dense) -> Iterator[pa.RecordBatch]:
        d.fold()
        for keys, _, items, owners in d.parts:
            yield pa.RecordBatch.from_arrays([keys, pa.array(items), pa.array(owners)], ["key", "items", "owners"])

    current, dense = None, _Dense()
    for b in batches:
        ids = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(ids)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
            if lo == hi:
                continue
            if ids[lo] != current:
                yield from result(dense)
                current, dense = ids[lo], _Dense()
            part = b.slice(lo, hi - lo)
            keys, items, owners = (part.column(i).flatten() for i in (1, 2, 3))
            dense.add(keys, np.zeros(len(keys)), items.to_numpy(), owners.to_numpy())
    yield from result(dense)


def counts_per_key(df: DataFrame, keys: list[str], item: str, owner: str) -> DataFrame:
    """``keys..., items, owners``: distinct ``item`` and distinct ``owner`` values of each key.

    Rows delivered twice count once, and so does an item under several owners. Key columns are strings; a
    null among them is a key value of its own, null items and owners are not counted, as in SQL. Other
    columns are ignored, whatever their names. Empty input gives no rows.
    """
    spark = df.sparkSession
    kinds = dict(df.select(F.col(item).alias("item"), F.col(owner).alias("owner")).dtypes)
    one_type = "string" if kinds["item"] != kinds["owner"] else kinds["item"]
    values = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(c).cast(one_type).alias("value")) for n, c in enumerate((item, owner))])
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(c).cast("string").alias(k) for c, k in zip(keys, names)], F.explode(values).alias("x"))
    # spread by key and value, so that the splits are equal whatever the keys
    once = rows.select(*names, "x.kind", "x.value").distinct()
    n_blocks = 8 * shuffle_width(spark)
    counts = [(F.col("value").isNotNull() & (F.col("kind") == n)).cast("long").alias(c) for n, c in enumerate(("items", "owners"))]
    splits = once.select(_encode_key(names).alias("key"), *counts)
    splits = splits.select("key", F.pmod(F.hash("key"), F.lit(n_blocks)).alias("block"), "items", "owners")
    parts = splits.mapInArrow(_count_split, _BLOCK_SCHEMA).repartition("block").sortWithinPartitions("block")
    summed = parts.mapInArrow(_sum_blocks, "key string, items long, owners long")
    return summed.select(*[c.alias(k) for c, k in zip(_decode_key(names), keys)], "items", "owners")
