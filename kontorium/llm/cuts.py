"""Texts cut off before their end.

Texts are joined with themselves by the hashes of fixed-length prefixes; those that share one are hashed up
to the length of the shorter, which finds every text that is a strict prefix of longer copies; where it was cut
shows in the copies. Only hashes and lengths are shuffled for all texts, whole texts only for those that share
a beginning with a shorter one. Most cut texts have no longer copy. For these the ending itself is judged, and each source's
limit is learned from where its broken texts pile up, which also gives the texts cut at a sentence's end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, hot_limit, salted_join, spread_join
from ..session import cut

# Marks that a broken transfer leaves, and abbreviations whose point ends no sentence.
RESIDUE = "…�<[({"
ABBREVIATIONS = ["fig", "figs", "abb", "no", "nr", "nos", "vgl", "bzw", "ca", "approx", "e.g", "i.e", "z.b", "d.h", "cf", "p.ej", "resp", "incl"]
#: Texts of one length that can make a source's limit.
LEAST_AT_LIMIT = 3

_END = re.compile(r"[.!?][\"'’”»)\]]*$")
_FENCE = re.compile(r"([-=*_#~])\1+.*\1\1+")
_TAG = re.compile(r"</\w[\w:.-]*>")
_REMARK = re.compile(r"\([^()]*\)")
_NOTICE = re.compile(r"(\(c\)|©|copyright\b)", re.I)
_SIGN = re.compile(r"\d{1,5}[a-z]?['’]?[ \t]+[^\W\d_]")
_NUMBER_ONLY = re.compile(r"[\[(]?\d+[\])]?\s*[.)-]?")
_ABBREVIATED = re.compile(r"(?:^|[^\w.])(" + "|".join(re.escape(a) for a in sorted(ABBREVIATIONS, key=len, reverse=True)) + r")\.$", re.I)


def _tail_line(line: str) -> bool:
    """A line that may follow a complete text: signs, a fenced or bracketed remark, a tag, a notice."""
    if not any(ch.isalnum() for ch in line):
        return not line or (line[-1] not in RESIDUE and set(line) != {"."})
    return bool(_FENCE.fullmatch(line) or _TAG.fullmatch(line) or _REMARK.fullmatch(line) or _NOTICE.match(line))


def ends_broken(text: str | None) -> bool:
    """True where a text stops inside a word or sentence.

    Lines that may follow a complete text are passed over first, a list of signs with its heading too.
    Null, empty and blank texts, and such of tail lines only, are not broken.
    """
    t = (text or "").rstrip()
    while t:
        head, _, last = t.rpartition("\n")
        last = last.strip()
        if _tail_line(last):
            t = head.rstrip()
            continue
        if _SIGN.match(last) and not _END.search(last):
            rest = t
            while rest:
                head, _, line = rest.rpartition("\n")
                line = line.strip()
                if not line:
                    rest = head
                elif _SIGN.match(line) and not _END.search(line):
                    rest = head
                else:
                    break
            head, _, line = rest.rpartition("\n")
            line = line.strip()
            # a list stands under a heading: a short line of its own that is no sentence
            if rest and head and len(line) <= 60 and not _END.search(line) and line[:1].isupper() and line[-1] not in ",;" + RESIDUE:
                t = head.rstrip()
                continue
        break
    if not t:
        return False
    if not _END.search(t) or t.endswith(("..", "…")):
        return True
    last = t.rpartition("\n")[2].strip()
    return bool(_NUMBER_ONLY.fullmatch(last) or _ABBREVIATED.search(last[-24:]))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        broken = [ends_broken(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(broken, pa.bool_())], [*b.schema.names[1:], "broken"])


def _marked(docs: DataFrame) -> DataFrame:
    """``text, doc_id, source, chars, bytes, size, mark, steps`` of each text.

    ``size`` and ``mark`` are the length in bytes and the hash (128 bits) of its bare text; ``steps`` the hashes of
    the bare text's first 1, 4, 16, ... bytes, as far as it reaches.
    """
    t, bare = F.coalesce("text", F.lit("")), F.encode(bare_text(F.col("text")), "UTF-8")
    rows = docs.filter("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"),
        t.alias("text"), bare.alias("bare"), F.octet_length(bare).alias("size"),
    )
    reached = F.filter(F.array(*[F.lit(4**i) for i in range(16)]), lambda n: n <= F.col("size"))
    steps = F.transform(reached, lambda n: F.xxhash64(F.substring("bare", F.lit(1), n)))
    return rows.select("text", "doc_id", "source", "chars", "bytes", "size", F.unhex(F.md5("bare")).alias("mark"), steps.alias("steps"))


def judged_endings(docs: DataFrame) -> DataFrame:
    """``doc_id, source, chars, bytes, size, mark, steps, broken`` of each text with an id.

    A null text has no length and is not broken.
    """
    rows = _marked(docs)
    return rows.mapInArrow(_judge, "doc_id long, source string, chars long, bytes long, size int, mark binary, steps array<long>, broken boolean")


def _pile(judged: DataFrame, length: str) -> DataFrame:
    """``s, limit, held``: per source the greatest length at which texts pile up, and how many have it.

    At least ``LEAST_AT_LIMIT`` texts have it, two thirds of them or more end broken, and at most half
    as many are longer (what a transfer leaves behind may lengthen some). The window runs over the
    different lengths of a source, counted before, not over its texts.
    """
    counts = judged.groupBy("source", F.col(length).alias("len")).agg(F.count("*").alias("n"), F.count_if("broken").alias("k"))
    w = Window.partitionBy("source").orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)
    piles = counts.withColumn("longer", F.coalesce(F.sum("n").over(w), F.lit(0))).filter(
        (F.col("n") >= LEAST_AT_LIMIT) & (3 * F.col("k") >= 2 * F.col("n")) & (2 * F.col("longer") <= F.col("n"))
    )
    top = piles.groupBy("source").agg(F.max(F.struct("len", "n")).alias("t"))
    return top.select(F.col("source").alias("s"), F.col("t.len").alias("limit"), F.col("t.n").alias("held"))


def source_limits(judged: DataFrame) -> DataFrame:
    """``source, char_limit, byte_limit``: where a source cuts; sources that show no limit are left out.

    Where a source's texts pile up at a number of characters and at one of bytes, the larger pile is the
    limit. Before a wide character a byte limit leaves some bytes unused; such a text ends inside a word
    or sentence and needs no limit to be found.
    """
    chars, size = _pile(judged, "chars"), _pile(judged, "bytes")
    both = chars.select("s", F.struct("held", F.lit(1).alias("by_chars"), "limit").alias("p")).union(
        size.select("s", F.struct("held", F.lit(0).alias("by_chars"), "limit").alias("p"))
    )
    best = both.groupBy("s").agg(F.max("p").alias("p"))
    kind = F.col("p.by_chars") == 1
    return best.select(F.col("s").alias("source"), F.when(kind, F.col("p.limit")).alias("char_limit"), F.when(~kind, F.col("p.limit")).alias("byte_limit"))


# The white space that may stand at the end of a text.
_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bare_text(c: Column) -> Column:
    """A text without white space and the marks of a broken transfer at its end."""
    marks = F.lit(_SPACE + RESIDUE)
    t = F.rtrim(F.coalesce(c, F.lit("")), marks)
    return F.when(t.endswith("..."), F.rtrim(F.rtrim(t, F.lit(".")), marks)).otherwise(t)


def _inside(short: bytes, then: bytes) -> bool:
    """True where a text that goes on with ``then`` does so within the line and sentence in which the shorter one stops."""
    return then not in (b"\r", b"\n") and not _END.search(short[-64:].decode("utf-8", "ignore"))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each text up to each of the lengths asked for, in one pass over the text."""
    for b in batches:
        rows: list[tuple] = []
        for doc, text, sizes in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            data, h, at = text.as_py(), hashlib.md5(usedforsecurity=False), 0
            for n in sorted(set(sizes)):
                h.update(data[at:n])
                at = n
                rows.append((n, h.copy().digest(), doc, _inside(data[max(0, n - 64) : n], data[n : n + 1])))
        cols = list(zip(*rows)) if rows else [()] * 4
        types = [pa.int32(), pa.binary(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["size", "mark", "longer_id", "inside"])


def prefix_texts(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``mark, copies, longer_id, inside``: every distinct bare text, with the smallest id of a longer text that begins with it.

    A text and a longer copy of it agree on the longest of the fixed lengths 1, 4, 16, ... that the shorter one
    reaches. So each distinct text asks at its own such length, and longer ones that share it are hashed up
    to the asker's end, each once for all lengths. How many lengths a text is hashed to is bounded by its
    own length, however many texts share its beginning. Equal texts have been folded into one before.
    ``longer_id`` is null where there is none; ``inside`` says whether any longer text goes on in the line
    and sentence where this one stops.
    """
    spark = docs.sparkSession
    texts = judged.filter("size > 0").groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("steps").alias("steps"))
    texts = cut(texts, "texts")
    asked = texts.select((F.size("steps") - 1).alias("step"), F.element_at("steps", -1).alias("start"), "size")
    # lengths asked for at each beginning: no more than the beginning has bytes, times three
    asked = asked.groupBy("step", "start").agg(F.count("*").alias("askers"), F.sort_array(F.collect_set("size")).alias("sizes"))
    reach = texts.select("doc_id", F.col("size").alias("own"), F.posexplode("steps").alias("step", "start"))
    total = texts.count()
    # beginnings that many texts share, at which many lengths may be asked for
    shared = cut(hot_keys(reach, ["step", "start"], total, counted=True), "shared")
    found = salted_join(reach, asked, ["step", "start"], shared, total, "doc_id")
    found = found.withColumn("sizes", F.filter("sizes", lambda n: n < F.col("own"))).filter(F.size("sizes") > 0)
    probes = cut(found.groupBy("doc_id").agg(F.flatten(F.collect_list("sizes")).alias("sizes")), "probes")
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(bare_text(F.col("text")), "UTF-8").alias("text"))
    hits = probes.join(bare, "doc_id").select("doc_id", "text", "sizes").mapInArrow(_probe, "size int, mark binary, longer_id long, inside boolean")
    hits = hits.groupBy("size", "mark").agg(F.min("longer_id").alias("longer_id"), F.max("inside").alias("inside"))
    return texts.select("size", "mark", "copies").join(hits, ["size", "mark"], "left").drop("size")


def longer_copies(docs: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """``doc_id, longer_id, inside``: texts that are strict prefixes of another text, with the smallest such one.

    Marks of a broken transfer at a text's end do not count. ``inside``: a longer text goes on in the
    line and sentence where the shorter stops. Empty texts are prefixes of nothing; rows without an id are
    left out. Ids should be unique; of equal texts the smallest id stands for all as the longer one.
    """
    judged = cut(judged_endings(docs), "endings") if judged is None else judged
    texts = cut(prefix_texts(docs, judged), "prefixes")
    hot = texts.filter(F.col("copies") > hot_limit(docs.sparkSession, judged.count())).select("mark")
    found = texts.filter("longer_id IS NOT NULL").select("mark", "longer_id", "inside")
    return spread_join(judged.filter("size > 0").select("doc_id", "mark"), found, ["mark"], hot).select("doc_id", "longer_id", "inside")


def cut_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, source, at_limit, broken, inside, longer_id``: every text that stops before its own end, and why.

    A text is cut if a longer copy goes on inside the line where it stops, if it ends inside a word or
    sentence, or if it has the length at which its source cuts. A complete text that is a prefix of a
    longer one is not cut. Rows without an id are left out.
    """
    judged = cut(judged_endings(docs), "endings")
    total = judged.count()
    limits = cut(source_limits(judged).filter("source IS NOT NULL"), "limits")
    none = cut(source_limits(judged.filter("source IS NULL")).select("char_limit", "byte_limit"), "limits")
    rows = judged.select("doc_id", "source", "chars", "bytes", "broken")
    hot = cut(hot_keys(rows, ["source"], total), "sources")
    named = spread_join(rows.filter("source IS NOT NULL"), limits, ["source"], hot, "left")
    # texts without a source are one source, with one limit at most
    loose = rows.filter("source IS NULL").join(F.broadcast(none), how="left")
    limited = named.unionByName(loose)
    at_limit = F.coalesce(F.col("chars") == F.col("char_limit"), F.lit(False)) | F.coalesce(F.col("bytes") == F.col("byte_limit"), F.lit(False))
    copies = longer_copies(docs, judged)
    full = limited.select("doc_id", "source", at_limit.alias("at_limit"), "broken").join(copies, "doc_id", "left")
    inside = F.coalesce("inside", F.lit(False))
    return full.select("doc_id", "source", "at_limit", "broken", inside.alias("inside"), "longer_id").filter("at_limit OR broken OR inside")


def cut_shares(docs: DataFrame) -> DataFrame:
    """``source, documents, cut, share`` of each source; null is a source of its own."""
    found = cut_documents(docs).groupBy("source").agg(F.count("*").alias("cut")).select(F.col("source").alias("s"), "cut")
    total = docs.groupBy("source").agg(F.count("*").alias("documents"))
    both = total.join(found, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    return both.select("source", "documents", "cut", (F.col("cut") / F.col("documents")).alias("share"))
