"""Filling containers of a fixed token capacity with whole texts.

Texts are measured where they lie. Only ids and lengths are then spread by hash, since neighbours in a
source are often alike and best fit wants sizes mixed. Each task places its share online, text by text as
they come: a fixed number of bins is open, kept in a bitset with one bit per amount of free space; a text goes
into the bin that it fills most, found by bit arithmetic, and when too many bins are open the fullest closes.
The bins still open at the end of a share are few; what they hold is placed again in the same way, many
shares together, until one task has seen it all.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

CAPACITY = 4096
OPEN_BINS = 1024
#: Shares whose open bins are packed again together.
MERGE_SPLITS = 16
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are tokenized at once; longer texts go in pieces, cut where a token must begin.
PIECE_CHARS = 1 << 20


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a rank file; loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of a whole text. Very long texts are cut before a blank that follows a letter, where the
    pattern always begins a new token, so the count is that of the whole."""
    enc = encoder(path)
    if len(text) <= PIECE_CHARS:
        return len(enc.encode_ordinary(text))
    total, lo = 0, 0
    while lo < len(text):
        hi = min(lo + PIECE_CHARS, len(text))
        while hi < len(text) and not (text[hi] == " " and text[hi - 1].isalpha() and text[hi + 1 : hi + 2].isalpha()):
            hi += 1
        total, lo = total + len(enc.encode_ordinary(text[lo:hi])), hi
    return total


class BestFit:
    """Open bins by free space: a bitset of the amounts that occur and the bins of each amount."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.most = capacity, open_bins
        self.bits, self.n = 0, 0
        self.bins: dict[int, list[list]] = {}

    def _push(self, free: int, items: list) -> None:
        self.bins.setdefault(free, []).append(items)
        self.bits |= 1 << free
        self.n += 1

    def _pop(self, free: int) -> list:
        stack = self.bins[free]
        items = stack.pop()
        if not stack:
            del self.bins[free]
            self.bits &= ~(1 << free)
        self.n -= 1
        return items

    def add(self, item: tuple, size: int) -> list | None:
        """Place an item of at most the capacity; the items of a bin that closes, if one does."""
        room = self.bits >> size
        if room:
            free = size + (room & -room).bit_length() - 1
            items = self._pop(free)
        else:
            free, items = self.capacity, []
        items.append(item)
        free -= size
        if free == 0:
            return items
        self._push(free, items)
        if self.n > self.most:
            return self._pop((self.bits & -self.bits).bit_length() - 1)
        return None

    def rest(self) -> Iterator[list]:
        while self.n:
            yield self._pop((self.bits & -self.bits).bit_length() - 1)


_SCHEMA = "part int, bin int, closed boolean, doc_id long, piece int, start long, n_tokens long"
_TYPES = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]


class _Out:
    """Rows of closed and leftover bins of one task."""

    def __init__(self, part: int) -> None:
        self.part, self.bin, self.rows = part, 0, []

    def put(self, items: list | None, closed: bool) -> None:
        if items:
            self.rows += [(self.part, self.bin, closed, *i) for i in items]
            self.bin += 1

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [()] * len(_TYPES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], [f.split()[0] for f in _SCHEMA.split(", ")])


def _measure(path: str):
    """Tokens of each text; the tokenizer's file comes with the job, so hosts need no copy of their own."""
    name = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        own = SparkFiles.get(name)
        for b in batches:
            n = [count_tokens(t.as_py() or "", own) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return run


def _pack(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fit, out = BestFit(capacity, open_bins), _Out(TaskContext.get().partitionId())
        for b in batches:
            for doc, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                piece, start = 0, 0
                while n - start > capacity:  # only a text above the capacity is divided
                    out.put([(doc, piece, start, capacity)], True)
                    piece, start = piece + 1, start + capacity
                out.put(fit.add((doc, piece, start, n - start), n - start), True)
            yield out.flush()
        for items in fit.rest():
            out.put(items, False)
        yield out.flush()

    return run


def _repack(capacity: int, open_bins: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Place what the open bins held again; rows come sorted by group."""
        group, fit, out = None, None, None

        def close() -> Iterator[pa.RecordBatch]:
            if fit is not None:
                for items in fit.rest():
                    out.put(items, last)
                yield out.flush()

        for b in batches:
            for g, doc, piece, start, n in zip(*(c.to_pylist() for c in b.columns)):
                if g != group:
                    yield from close()
                    group, fit, out = g, BestFit(capacity, open_bins), _Out(g)
                out.put(fit.add((doc, piece, start, n), n), True)
        yield from close()

    return run


def packed_documents(
    docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tokenizer: str = TOKENIZER, merge_splits: int = MERGE_SPLITS
) -> DataFrame:
    """``doc_id, piece, token_start, n_tokens, container_id``: where each text went.

    Every text is in one container, whole, unless it has more than ``capacity`` tokens: then full pieces
    have a container each and its rest is packed like a text. Null and empty texts are items of no
    tokens. Containers never exceed the capacity. Empty input gives no rows.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer)
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure(tokenizer), "doc_id long, n_tokens long")
    mixed = items.withColumn("h", F.xxhash64("doc_id")).repartition("h").sortWithinPartitions("h", "doc_id", "n_tokens")
    level = cut(mixed.select("doc_id", "n_tokens").mapInArrow(_pack(capacity, open_bins), _SCHEMA), "packed")
    done = [level.filter("closed").withColumn("level", F.lit(0))]
    depth, width = 1, level.agg(F.max("part")).first()[0]
    while width is not None:
        width //= merge_splits
        left = level.filter("NOT closed").select((F.col("part") / merge_splits).cast("int").alias("g"), "doc_id", "piece", "start", "n_tokens")
        left = left.repartition("g").sortWithinPartitions("g", F.xxhash64("doc_id", "piece"), "doc_id", "piece")
        level = cut(left.mapInArrow(_repack(capacity, open_bins, width == 0), _SCHEMA), "packed")
        done.append(level.filter("closed").withColumn("level", F.lit(depth)))
        depth += 1
        if width == 0:
            break
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    container = F.shiftleft(F.col("level").cast("long"), 60).bitwiseOR(F.shiftleft(F.col("part").cast("long"), 30)).bitwiseOR(F.col("bin").cast("long"))
    return out.select("doc_id", "piece", F.col("start").alias("token_start"), "n_tokens", container.alias("container_id"))


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``container_id, items, tokens, unused`` of each container."""
    g = packed.groupBy("container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    return g.withColumn("unused", F.lit(capacity) - F.col("tokens"))
