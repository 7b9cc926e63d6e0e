"""Copies hidden by formatting: canonical bytes, recursive radix partitions, tries that count.

Each split first counts its own canonical keys in a trie, so a text with any number of copies enters the
shuffle once per split. Radix partitions then begin with the first bytes of the keys: while a bucket holds
more entries than a task should get, it is split by further bytes before the shuffle; a bucket that still
holds more keys than fit is split by further bytes after it, again and again. Each bucket that fits is
counted in a trie of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_line, words
from ..operators.packed import LABELS, packed_values
from ..operators.skew import hot_limit
from ..session import cut

#: Keys a split's trie holds before it hands them over.
SPLIT_KEYS = 100_000
#: Keys that fit into a bucket.
BUCKET_KEYS = 10_000
#: Bytes of the keys that the first partition uses.
FIRST_BYTES = 8

_STRIDE = 4
NAME_FIELDS = ["first_name", "middle_name", "last_name", "name_prefix", "name_suffix", "nickname"]


class CountingTrie:
    """Counts byte strings: four bytes an edge, a terminal counter and smallest id at each end.

    A path that only one key takes is kept as that key's remaining bytes until another key joins it.
    """

    def __init__(self) -> None:
        self.root: dict = {}
        self.size = 0

    def add(self, key: bytes, n: int, row: int) -> None:
        node, i = self.root, 0
        while True:
            edge, i = key[i : i + _STRIDE], i + _STRIDE
            x = node.get(edge)
            if x is None:
                node[edge] = [key[i:], n, row]
                self.size += 1
                return
            if type(x) is list:
                if x[0] == key[i:]:
                    x[1] += n
                    x[2] = min(x[2], row)
                    return
                tail = x[0]
                x[0] = tail[_STRIDE:]
                x = node[edge] = {tail[:_STRIDE]: x}
            node = x

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            path, node = stack.pop()
            for edge, x in node.items():
                if type(x) is list:
                    yield path + edge + x[0], x[1], x[2]
                else:
                    stack.append((path + edge, x))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    k, n, r = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(n, pa.int64()), pa.array(r, pa.int64())], ["key", "n", "row_id"])


def _count_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = CountingTrie()
    for b in batches:
        for key, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            trie.add(key, 1, row)
        if trie.size > SPLIT_KEYS:
            yield _batch(list(trie.items()))
            trie = CountingTrie()
    yield _batch(list(trie.items()))


def _label(depth: Column) -> Column:
    """The bucket of a key: the hash of its first ``depth`` bytes. A clash only joins two buckets."""
    return F.xxhash64(F.substring("key", F.lit(1), depth))


def radix_labels(keys: DataFrame) -> DataFrame:
    """``key, n, row_id, depth, label``: entries by their first bytes, so that no label is hot.

    Begins with the first ``FIRST_BYTES`` bytes. Labels with more entries than a quarter of an average
    shuffle partition are split by as many bytes again, until none is left but those of equal keys, which
    have one entry per split. At most four labels per shuffle partition are split at a time; they are
    broadcast as numbers, and no key leaves the executors.
    """
    limit = hot_limit(keys.sparkSession, keys.count())
    depth = FIRST_BYTES
    out = keys.withColumn("depth", F.lit(depth)).withColumn("label", _label(F.col("depth")))
    while True:
        sizes = out.filter(F.col("depth") == depth).groupBy("label").agg(F.count("*").alias("k"), F.max(F.octet_length("key")).alias("longest"))
        hot = cut(sizes.filter((F.col("k") > limit) & (F.col("longest") > depth)).select(F.col("label").alias("hot")), "hot")
        if hot.isEmpty():
            return out
        marked = out.join(F.broadcast(hot), (F.col("label") == F.col("hot")) & (F.col("depth") == depth), "left")
        split = F.col("hot").isNotNull()
        out = marked.select(
            "key", "n", "row_id", F.when(split, F.lit(2 * depth)).otherwise(F.col("depth")).alias("depth"),
            F.when(split, _label(F.lit(2 * depth))).otherwise(F.col("label")).alias("label"),
        )
        depth *= 2


_ENTRY = "closed boolean, label long, depth int, key binary, n long, row_id long"


def _count_buckets(fit: int):
    """Count each bucket in its trie; rows come sorted by label.

    A bucket that turns out to hold more than ``fit`` keys hands over what it has counted and all that
    follows as open entries, to be split by further bytes. So a task never holds more keys than fit.
    """
    types = [pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        current, trie, opened, longest = None, CountingTrie(), False, 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * len(types)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.split()[0] for f in _ENTRY.split(", ")])

        def close() -> None:
            if not opened:
                rows.extend((True, current, None, None, n, r) for _, n, r in trie.items())

        for b in batches:
            for label, depth, key, n, row in zip(*(c.to_pylist() for c in b.columns)):
                if label != current:
                    close()
                    current, trie, opened, longest = label, CountingTrie(), False, 0
                if opened:
                    rows.append((False, label, depth, key, n, row))
                    continue
                trie.add(key, n, row)
                longest = max(longest, len(key))
                # keys that end within the bytes already used cannot be told apart by more of them
                if trie.size > fit and longest > depth:
                    rows.extend((False, label, depth, *x) for x in trie.items())
                    trie, opened = CountingTrie(), True
            yield flush()
        close()
        yield flush()

    return run


def counted_buckets(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """``label, row_id, copies``: the keys of entries ``key, n, row_id`` counted, bucket by bucket.

    A bucket that does not fit is split by as many bytes again as it has used and shuffled once more, so
    there are at most as many passes as the longest key can be doubled; each carries open buckets only.
    """
    placed, done = radix_labels(keys), None
    while True:
        spread = placed.select("label", "depth", "key", "n", "row_id").repartition("label").sortWithinPartitions("label")
        level = cut(spread.mapInArrow(_count_buckets(bucket_keys), _ENTRY), "buckets")
        closed = level.filter("closed").select("label", "row_id", F.col("n").alias("copies"))
        done = closed if done is None else done.union(closed)
        left = level.filter("NOT closed")
        if left.isEmpty():
            return done
        deeper = 2 * F.col("depth")
        placed = left.select("key", "n", "row_id", deeper.alias("depth"), _label(deeper).alias("label"))


def count_copies(keyed: DataFrame, key: str, row: str, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """``row_id, copies``: for each distinct ``key`` (text) its smallest ``row`` and number of rows.

    A null key counts as the empty one; rows without ``row`` are left out. Empty input gives no rows.
    """
    source = keyed.filter(F.col(row).isNotNull()).select(F.encode(F.coalesce(F.col(key), F.lit("")), "UTF-8").alias("key"), F.col(row).cast("long").alias("row_id"))
    counted = cut(source.mapInArrow(_count_split, "key binary, n long, row_id long"), "counted")
    return counted_buckets(counted, bucket_keys).select("row_id", "copies")


def _line_set(values: Column) -> Column:
    """The non-empty texts of an array, each once, in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda v: v != ""))), "\x1e")


def canonical_contacts(rows: DataFrame, phones: DataFrame) -> DataFrame:
    """``row_id, canonical``: what two contacts must share to be copies, as one text.

    In order: the words of all name fields, sorted; the e-mails, as a set; the numbers (kind and digits,
    anomalies left out), as a set; the words of organization, address, photo, website and notes; the
    labels, as a set. Null, blank and wordless cells are empty; a contact without anything has a key of
    separators only, which all such contacts share.
    """
    numbers = phones.filter("key_type IS NOT NULL").select(
        "row_id", F.concat("key_type", F.lit(":"), F.regexp_replace(F.coalesce("canonical_key", F.lit("")), "[^0-9]", "")).alias("number")
    )
    numbers = numbers.distinct().groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_list("number")), "\x1e").alias("numbers"))
    names = F.array_join(F.array_sort(F.flatten(F.array(*[words(F.col(c)) for c in NAME_FIELDS]))), " ")
    mails = _line_set(F.array(word_line(F.col("email_1_value")), word_line(F.col("email_2_value"))))
    lines = [word_line(F.col(c)) for c in ("organization_name", "address_1_formatted", "photo", "website_1_value", "notes")]
    flat = rows.select(
        "row_id", F.coalesce("labels", F.lit("")).alias("labels"), F.concat_ws("\x1f", names, mails).alias("head"), F.concat_ws("\x1f", *lines).alias("body")
    )
    split = packed_values(flat, "row_id", {"labels": LABELS}, least=0, keep=["head", "body"])
    labels = _line_set(F.transform("values", word_line))
    split = split.select("row_id", "head", "body", labels.alias("labels"))
    joined = split.join(numbers, "row_id", "left")
    return joined.select("row_id", F.concat_ws("\x1f", "head", F.coalesce("numbers", F.lit("")), "body", "labels").alias("canonical"))
