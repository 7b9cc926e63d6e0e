"""Unparsed records of raw files: structure, headers and path-value rows.

Records are parsed in bulk by pyarrow's CSV reader, all of one width together whatever their file, with
every cell as text. Its invalid-row callback names the records whose cell count is wrong. A file is
spread over chunks of records, each joined to its header, so a file with most records is no task of its own.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Records of a file that are joined to their header together.
CHUNK_RECORDS = 4096
#: Bytes of text that one call of the CSV reader gets.
PARSE_BYTES = 8 << 20
#: Header names a mapping table may hold; it is kept in every task.
MAX_ALIASES = 100_000

_CELL = r'(?:[^",]*|"(?:[^"]|"")*")'
#: Cells apart by commas; quotes only around a whole cell, or doubled inside such a cell.
WELL_QUOTED = rf"^{_CELL}(?:,{_CELL})*$"
_HEADER_NOISE = re.compile(r"[\s_\-\u00a0\ufeff]+")


def header_key(name: str) -> str:
    """A header name without letter case, blanks, hyphens, underscores and byte order mark."""
    return _HEADER_NOISE.sub("", name).casefold()


def alias_map(aliases: DataFrame) -> dict[str, str]:
    """Header key to field name, from the fixed mapping table (at most ``MAX_ALIASES`` rows, checked)."""
    rows = aliases.select("header_name", "field_name").filter("header_name IS NOT NULL AND field_name IS NOT NULL").limit(MAX_ALIASES + 1).collect()
    if len(rows) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} header names")
    return {header_key(r["header_name"]): r["field_name"] for r in rows}


def parse_header(line: str | None) -> list[str]:
    """The cells of a header record, without a byte order mark and outer blanks; null gives none."""
    if line is None:
        return []
    line = line.removeprefix("\ufeff")
    return [c.strip() for c in next(csv.reader(io.StringIO(line), strict=False), [""])]


def headers(raw: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """``file_id, names, keys, fields``: a file's header cells, their keys and the fields they mean.

    A header name that the mapping lacks stands for itself. If a file repeats its header record, the
    first in text order holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [parse_header(x) for x in b.column(1).to_pylist()]
            keys = [[header_key(n) for n in row] for row in names]
            fields = [[aliases.get(k, n) for k, n in zip(ks, ns)] for ks, ns in zip(keys, names)]
            lists = [pa.array(x, pa.list_(pa.string())) for x in (names, keys, fields)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["file_id", "names", "keys", "fields"])

    heads = raw.filter("source_row_number = 1").groupBy("file_id").agg(F.min("line").alias("line"))
    return heads.mapInArrow(run, "file_id long, names array<string>, keys array<string>, fields array<string>")


def _shelter(lines: pa.Array) -> tuple[pa.Array, list[tuple[str, str]]]:
    """Line breaks inside records replaced by characters that occur in none, and how to undo it."""
    undo = []
    spare = (chr(c) for c in range(0xE000, 0xF8FF))
    for mark in ("\n", "\r"):
        if not pc.any(pc.match_substring(lines, mark)).as_py():
            continue
        free = next(c for c in spare if not pc.any(pc.match_substring(lines, c)).as_py())
        lines = pc.replace_substring(lines, mark, free)
        undo.append((free, mark))
    return lines, undo


def _read_width(lines: pa.Array, width: int) -> tuple[np.ndarray, pa.ListArray, list[int]]:
    """(position and cells of the records that have ``width`` cells; positions of those that pyarrow's callback names)."""
    rejected: list[int] = []

    def invalid(row: pacsv.InvalidRow) -> str:
        rejected.append(int(row.text.split(",", 1)[0]))
        return "skip"

    lines, undo = _shelter(lines)
    numbered = pc.binary_join_element_wise(pc.cast(pa.array(np.arange(len(lines))), pa.string()), lines, ",")
    text = "\n".join(numbered.to_pylist()).encode() + b"\n"
    names = ["at", *(f"c{i}" for i in range(width))]
    table = pacsv.read_csv(
        io.BytesIO(text),
        read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=len(text) + 1),
        parse_options=pacsv.ParseOptions(newlines_in_values=False, invalid_row_handler=invalid),
        convert_options=pacsv.ConvertOptions(
            column_types={"at": pa.int64(), **{n: pa.string() for n in names[1:]}}, strings_can_be_null=False
        ),
    ).combine_chunks()
    at = table.column("at").to_numpy()
    n = len(at)
    columns = [table.column(c).combine_chunks() for c in names[1:]]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    if not n:
        return at, pa.array([], pa.list_(pa.string())), rejected
    flat = pa.concat_arrays(columns).take(pa.array((np.arange(width)[None, :] * n + np.arange(n)[:, None]).ravel()))
    for free, mark in undo:
        flat = pc.replace_substring(flat, free, mark)
    return at, pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), flat), rejected


def parse_lines(lines: pa.Array, widths: np.ndarray) -> tuple[list[str | None], pa.Array]:
    """Reason (null where the record is sound) and cells of each record, given the width its header asks for."""
    lines = pc.fill_null(lines, "")
    quoted = pc.match_substring_regex(lines, WELL_QUOTED).to_numpy(zero_copy_only=False)
    # a record of a file without a header has no right number of cells
    reason = np.where(quoted, np.where(widths == 0, "column_count", None), "broken_quoting").astype(object)
    places, lists = [], []
    for width in np.unique(widths[quoted]):
        if width == 0:
            continue
        here = np.flatnonzero(quoted & (widths == width))
        at, cells, rejected = _read_width(lines.take(pa.array(here)), int(width))
        reason[here[rejected]] = "column_count"
        if len(at) + len(rejected) != len(here):
            raise ValueError("the CSV reader lost records")
        places.append(here[at])
        lists.append(cells)
    slot = np.full(len(lines), -1)
    if places:
        slot[np.concatenate(places)] = np.arange(sum(map(len, places)))
    joined = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.string()))
    return list(reason), joined.take(pa.array(slot, mask=slot < 0))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False) + 24)
        group = (ends // PARSE_BYTES).astype(int)
        for lo, hi in ((np.searchsorted(group, g), np.searchsorted(group, g, "right")) for g in np.unique(group)):
            part = b.slice(lo, hi - lo)
            reason, cells = parse_lines(part.column(2), part.column(4).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(reason, pa.string()), cells, part.column(3)],
                ["file_id", "source_row_number", "reason", "cells", "fields"],
            )


def parse_records(raw: DataFrame, heads: DataFrame) -> DataFrame:
    """``file_id, source_row_number, reason, cells, fields`` of every record but the headers.

    ``reason``: broken_quoting, column_count or null. ``cells`` is null where there is a reason. A record
    of null counts as an empty one. Where a file has no header no record can have its column count.
    """
    records = raw.filter("source_row_number > 1").select(
        "file_id", "source_row_number", "line", F.floor(F.col("source_row_number") / CHUNK_RECORDS).alias("chunk")
    )
    last = records.groupBy("file_id").agg(F.max("chunk").alias("last"))
    spread = last.join(heads.select("file_id", "fields"), "file_id", "left").select(
        "file_id", F.coalesce("fields", F.array().cast("array<string>")).alias("fields"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("chunk")
    )
    joined = records.join(spread, ["file_id", "chunk"]).select(
        "file_id", "source_row_number", "line", "fields", F.size("fields").alias("width")
    )
    return joined.mapInArrow(_parse, "file_id long, source_row_number int, reason string, cells array<string>, fields array<string>")


def cell_of(field: str, fields: str = "fields", cells: str = "cells") -> Column:
    """The cell of a field in a parsed record, the first if its header repeats; null where it is absent."""
    at = F.array_position(fields, F.lit(field))
    return F.when(at > 0, F.get(F.col(cells), (at - 1).cast("int")))
