"""Test items that stand in a corpus: a positional inverted index and phrase search from rare terms.

The index is built once, written, and serves any test items. It is sharded by document: a shard covers a few
megabytes of text and holds, per term, the sorted places at which it stands, counted in words over the shard with
a gap between documents. From the shards' term counts each window of an item picks its rarest term;
that term's places, shifted to the start of the window, are the candidates, and the lists of the terms
beside it are intersected with them, offset by offset. A shard answers alone, so no posting is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Consecutive words that make a leak.
RUN = 12
#: Text of one index shard, in bytes; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Words of test items that one pass over the index may carry into every task; more take more passes.
PASS_WORDS = 2_000_000
#: Places left free between two documents of a shard; no window may be longer.
GAP = 4096
#: Share of a window's weight, rare words weighing more, that must be there for an altered passage.
WEIGHT = 0.85

_NO_WORD = r"[^\p{L}\p{Nd}]+"
_INDEX = "docs array<long>, starts array<long>, terms array<string>, counts array<int>, places binary"


def split_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text in lower case; empty strings may stand at either end of a list."""
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), _NO_WORD)


@dataclass(frozen=True)
class TestItems:
    """A block of test items: ids, the words of each by number, and the words themselves, sorted."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: pa.Array

    @staticmethod
    def of(rows: list[tuple[int, str | None]]) -> TestItems:
        lists = split_words(pa.array([t for _, t in rows], pa.string()))
        flat = lists.flatten()
        vocabulary = pc.unique(flat.filter(pc.not_equal(flat, ""))).sort() if len(flat) else pa.array([], pa.string())
        words = []
        for x in lists:
            w = pa.array([s for s in x.as_py() if s], pa.string())
            words.append(pc.index_in(w, value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64))
        return TestItems([i for i, _ in rows], words, vocabulary)


def _shards(texts: pa.Array) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(texts):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + SHARD_BYTES, "right")))
        yield lo, hi
        lo = hi


def build_shard(ids: np.ndarray, texts: pa.Array) -> tuple:
    """(documents, first place of each, terms, places of each term, all places) of one shard, sorted by term and place."""
    lists = split_words(texts)
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    starts = ends[:-1] + GAP * np.arange(len(ids))
    flat = lists.flatten()
    code = pc.dictionary_encode(flat)
    term = code.indices.to_numpy()
    place = np.arange(len(flat)) + GAP * np.repeat(np.arange(len(ids)), np.diff(ends))
    order = np.argsort(term, kind="stable")  # places stay sorted within a term
    counts = np.bincount(term, minlength=len(code.dictionary))
    blank = pc.index(code.dictionary, "").as_py() if len(flat) else -1
    if blank >= 0:  # empty strings at the ends of a text are no words
        order = order[term[order] != blank]
        counts[blank] = 0
    return ids, starts, code.dictionary, counts, place[order]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in _shards(b.column(1)):
            docs, starts, terms, counts, places = build_shard(ids[lo:hi], b.column(1).slice(lo, hi - lo))
            row = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), terms, pa.array(counts, pa.int32())]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in row]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([_pack_places(places, counts)], types[4])], [f.split()[0] for f in _INDEX.split(", ")])


def _pack_places(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Steps from place to place, each term's beginning from 0, the bytes of equal weight together, compressed."""
    steps = np.diff(places, prepend=0)
    first = (np.cumsum(counts) - counts)[counts > 0]
    steps[first] = places[first]
    return pa.compress(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpack_places(data: bytes, counts: np.ndarray) -> np.ndarray:
    n = int(counts.sum())
    raw = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel().astype(np.int64)
    total = np.cumsum(steps)
    # what earlier terms have added is taken off again
    before = np.concatenate([[0], total])[np.cumsum(counts) - counts]
    return total - np.repeat(before, counts)


def build_index(docs: DataFrame) -> DataFrame:
    """The shards of a corpus (``doc_id``, ``text``) over all its terms, written; rows without an id are left out."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    return cut(source.mapInArrow(_build, _INDEX), "index")


def _count_terms(vocabulary: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at = pc.index_in(b.column(0)[i].values, value_set=vocabulary)
                known = pc.is_valid(at)
                yield pa.RecordBatch.from_arrays([at.filter(known), pc.cast(b.column(1)[i].values.filter(known), pa.int64())], ["term", "n"])

    return run


def term_counts(index: DataFrame, vocabulary: pa.Array) -> np.ndarray:
    """How often each term of the vocabulary stands in the corpus; as many numbers as the test items have terms."""
    rows = index.select("terms", "counts").mapInArrow(_count_terms(vocabulary), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary), np.int64)
    for r in rows.collect():
        out[r["term"]] = r["n"]
    return out


def rare_anchors(items: TestItems, counts: np.ndarray, run: int, rarest: int = 1, absent: int = 0) -> dict[int, list[tuple[int, int]]]:
    """term -> [(item, position)]: the ``rarest`` terms of each window of ``run`` words, each once.

    A window with more than ``absent`` terms that the corpus lacks stands nowhere and needs none.
    """
    out: dict[int, list[tuple[int, int]]] = {}
    for k, w in enumerate(items.words):
        picked: set[int] = set()
        n = counts[w] if len(w) else w
        for lo in range(len(w) - run + 1):
            window = n[lo : lo + run]
            if (window == 0).sum() > absent:
                continue
            order = np.argsort(window, kind="stable")
            picked.update(int(lo + p) for p in order[: rarest + int((window == 0).sum())] if window[p])
        for p in picked:
            out.setdefault(int(w[p]), []).append((k, p))
    return out


class Shard:
    """One shard in memory; ``places(term)`` is the sorted list of a term of the vocabulary."""

    def __init__(self, docs: np.ndarray, starts: np.ndarray, terms: pa.Array, counts: np.ndarray, places: bytes, vocabulary: pa.Array) -> None:
        self.docs, self.starts, self.all = docs, starts, _unpack_places(places, counts)
        self.ends = np.cumsum(counts)
        self.at = pc.fill_null(pc.index_in(vocabulary, value_set=terms), -1).to_numpy()
        self.terms = np.flatnonzero(self.at >= 0)

    def places(self, term: int) -> np.ndarray:
        i = self.at[term]
        return self.all[:0] if i < 0 else self.all[(self.ends[i - 1] if i else 0) : self.ends[i]]

    def documents(self, places: np.ndarray) -> np.ndarray:
        """Ordinals of the documents in which places lie, each once."""
        return np.unique(np.searchsorted(self.starts, places, "right") - 1)


def _stands(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of ``at`` are among ``places`` (sorted)."""
    i = np.searchsorted(places, at)
    i[i == len(places)] = 0
    return places[i] == at if len(places) else np.zeros(len(at), bool)


def phrase_hits(shard: Shard, items: TestItems, anchors: dict[int, list[tuple[int, int]]], run: int) -> set[tuple[int, int]]:
    """(item, document ordinal) of every run of ``run`` item words that stand in a row in a document."""
    hits: set[tuple[int, int]] = set()
    for term in np.intersect1d(shard.terms, np.fromiter(anchors, np.int64, len(anchors))):
        start = shard.places(int(term))
        for k, p in anchors[int(term)]:
            w = items.words[k]
            length = np.ones(len(start), np.int64)
            for step in (1, -1):
                alive, q = np.arange(len(start)), p + step
                while len(alive) and 0 <= q < len(w) and abs(q - p) < run:
                    alive = alive[_stands(start[alive] + (q - p), shard.places(int(w[q])))]
                    length[alive] += 1
                    q += step
            hits.update((k, int(d)) for d in shard.documents(start[length >= run]))
    return hits


def near_hits(
    shard: Shard, items: TestItems, anchors: dict[int, list[tuple[int, int]]], run: int, least: int, slop: int, weights: np.ndarray, share: float
) -> set[tuple[int, int]]:
    """(item, document ordinal) where ``least`` of ``run`` item words, with ``share`` of their weight, stand within ``slop`` of their places."""
    hits: set[tuple[int, int]] = set()
    for term in np.intersect1d(shard.terms, np.fromiter(anchors, np.int64, len(anchors))):
        start = shard.places(int(term))
        for k, p in anchors[int(term)]:
            w = items.words[k]
            lo, hi = max(0, p - run + 1), min(len(w), p + run)
            there = np.zeros((hi - lo, len(start)))
            for q in range(lo, hi):
                places = shard.places(int(w[q]))
                want = start + (q - p)
                there[q - lo] = np.searchsorted(places, want + slop, "right") > np.searchsorted(places, want - slop)
            there[p - lo] = 1
            if hi - lo < run:
                continue
            heavy = weights[w[lo:hi]][:, None]
            total, weight, whole = (np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)]) for x in (there, there * heavy, heavy))
            enough = (total[run:] - total[:-run] >= least) & (weight[run:] - weight[:-run] >= share * (whole[run:] - whole[:-run]))
            hits.update((k, int(d)) for d in shard.documents(start[enough.any(axis=0)]))
    return hits


def _search(items: TestItems, anchors: dict[int, list[tuple[int, int]]], find, *args):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                docs, starts, terms, counts = (b.column(c)[i].values for c in range(4))
                shard = Shard(docs.to_numpy(), starts.to_numpy(), terms, counts.to_numpy(), b.column(4)[i].as_py(), items.vocabulary)
                hits = sorted(find(shard, items, anchors, *args))
                item = pa.array([items.ids[k] for k, _ in hits], pa.int64())
                yield pa.RecordBatch.from_arrays([item, pa.array([int(shard.docs[d]) for _, d in hits], pa.int64())], ["item_id", "doc_id"])

    return run


def _blocks(items: DataFrame, pass_words: int) -> Iterator[list[tuple[int, str | None]]]:
    """The test items in blocks of bounded size; a block is what a pass carries into every task."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL")
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r["text"] or "") // 2 + 1
        if block and size + n > pass_words:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def _over_blocks(docs: DataFrame, items: DataFrame, index: DataFrame | None, pass_words: int, search) -> DataFrame:
    """The pairs that ``search`` finds of each block of test items, all in one index."""
    out = None
    for block in _blocks(items, pass_words):
        index = build_index(docs) if index is None else index
        part = TestItems.of(block)
        found = search(index, part, term_counts(index, part.vocabulary))
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, doc_id long")
    return out.distinct()


def leaked_items(docs: DataFrame, items: DataFrame, run: int = RUN, pass_words: int = PASS_WORDS, index: DataFrame | None = None) -> DataFrame:
    """``item_id, doc_id``: pairs where ``run`` consecutive words of the item stand in a row in the document.

    Words are runs of letters and digits without regard to case; what lies between them does not matter.
    Null and empty texts match nothing, items shorter than ``run`` words neither. Each pair comes once.
    ``index`` is the corpus's ``build_index``, if it is at hand.
    """
    if run > GAP:
        raise ValueError(f"windows of at most {GAP} words")

    def search(index: DataFrame, part: TestItems, counts: np.ndarray) -> DataFrame:
        return index.mapInArrow(_search(part, rare_anchors(part, counts, run), phrase_hits, run), "item_id long, doc_id long")

    return _over_blocks(docs, items, index, pass_words, search)


def near_items(
    docs: DataFrame, items: DataFrame, run: int = RUN, least: int = 10, slop: int = 2, share: float = WEIGHT, pass_words: int = PASS_WORDS, index: DataFrame | None = None
) -> DataFrame:
    """``item_id, doc_id``: pairs where ``least`` of ``run`` consecutive item words stand near their places.

    A word counts if it stands within ``slop`` words of where the window's alignment puts it. The words that
    count must also have ``share`` of the window's weight: a word weighs the cube of the logarithm of how rare it is
    in the corpus, so sentences of common words around other names are no match. Windows are aligned on one of their
    ``run - least + 1`` rarest terms, of which at least one must be there.
    """
    if run + slop > GAP:
        raise ValueError(f"windows of at most {GAP - slop} words")
    rarest = run - least + 1

    def search(index: DataFrame, part: TestItems, counts: np.ndarray) -> DataFrame:
        anchors = rare_anchors(part, counts, run, rarest, run - least)
        all_words = index.select(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, n: x + n))).first()[0] or 0
        weights = np.log((all_words + 1) / (counts + 1)) ** 3
        return index.mapInArrow(_search(part, anchors, near_hits, run, least, slop, weights, share), "item_id long, doc_id long")

    return _over_blocks(docs, items, index, pass_words, search)
