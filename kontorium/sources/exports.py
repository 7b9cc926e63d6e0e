"""Contact exports: file listing, the CSV dialect, header union and row alignment."""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.contacts import ContactTable
from . import files

_MARK = re.compile('[",\r\n]')
_CHUNK = 1 << 20
#: Bytes of small files that one task reads, and what opening a file is taken to cost.
_PARTITION_BYTES, _OPEN_BYTES = 16 << 20, 256 << 10


def list_exports(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path or URI, bytes) of what matches *.csv in a folder, not below it, in path order; names may begin with _ or a dot."""
    return files.list_files(spark, folder, ".csv")


def tokenize(chunks: Iterable[str]) -> Iterator[list[str]]:
    """Records of a CSV text that comes in chunks.

    A quote anywhere in a cell opens or closes quoting; a doubled one inside quotes is a quote. Outside
    quotes carriage returns vanish and a line feed ends the record; inside, both stay. A blank line is a
    record of one empty cell. At the end a record is given only if it has a finished cell or text; an
    open quote takes the rest of the file.
    """
    cells: list[str] = []
    cell: list[str] = []
    quoted, held = False, ""
    for chunk in chunks:
        text, held = held + chunk, ""
        at = 0
        while at < len(text):
            if quoted:
                end = text.find('"', at)
                if end < 0:
                    cell.append(text[at:])
                    break
                cell.append(text[at:end])
                if end == len(text) - 1:  # whether it is doubled shows in the next chunk
                    held = '"'
                    break
                if text.startswith('""', end):
                    cell.append('"')
                    at = end + 2
                else:
                    quoted, at = False, end + 1
                continue
            m = _MARK.search(text, at)
            if not m:
                cell.append(text[at:])
                break
            cell.append(text[at : m.start()])
            at = m.end()
            if m[0] == '"':
                quoted = True
            elif m[0] == ",":
                cells.append("".join(cell))
                cell = []
            elif m[0] == "\n":
                yield [*cells, "".join(cell)]
                cells, cell = [], []
    rest = "".join(cell)
    if rest or cells:
        yield [*cells, rest]


def read_text(path: str) -> Iterator[str]:
    """Chunks of a UTF-8 file, wrong bytes replaced, one leading byte order mark dropped."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    first = True
    with files.open_input(path) as f:
        while True:
            raw = f.read(_CHUNK)
            text = decode(raw, final=not raw)
            if first and text:
                text, first = text.removeprefix("\ufeff"), False
            if text:
                yield text
            if not raw:
                return


def read_csv(path: str) -> list[list[str]]:
    """All records of one file."""
    return list(tokenize(read_text(path)))


class _Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]) -> None:
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict, width: int | None) -> None:
        self.files = json.loads(options["files"])
        self.header = json.loads(options["header"]) if "header" in options else None
        self.heads_only = options.get("headsonly", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        """Neighbouring files together up to ``_PARTITION_BYTES``; opening one counts as reading some."""
        parts: list[list[tuple[int, str]]] = []
        room = 0
        for i, (p, size) in enumerate(self.files):
            cost = _OPEN_BYTES + (0 if self.heads_only else size)
            if not parts or cost > room:
                parts.append([])
                room = _PARTITION_BYTES
            parts[-1].append((i, p))
            room -= cost
        return [_Files(x) for x in parts]

    def _records(self, path: str) -> Iterator[list[str]]:
        for i, r in enumerate(tokenize(read_text(path))):
            yield r
            if self.heads_only:
                return

    def read(self, part: _Files) -> Iterator[pa.RecordBatch]:
        for rank, path in part.files:
            yield from self._read_file(rank, path)

    def _read_file(self, rank: int, path: str) -> Iterator[pa.RecordBatch]:
        name = os.path.basename(path)
        place: list[int] | None = None
        rows: list[tuple[int, list[str]]] = []
        width = len(self.header) if self.header is not None else 0
        at = {h: i for i, h in enumerate(self.header)} if self.header is not None else {}

        def batch() -> pa.RecordBatch:
            n = len(rows)
            fixed = [pa.array([rank] * n, pa.int32()), pa.array([name] * n), pa.array([r for r, _ in rows], pa.int32())]
            if self.header is None:
                return pa.RecordBatch.from_arrays([*fixed, pa.array([c for _, c in rows], pa.list_(pa.string()))], ["file_rank", "source_file", "record_ord", "cells"])
            cells = [pa.array([c[i] for _, c in rows], pa.string()) for i in range(width)]
            return pa.RecordBatch.from_arrays([*fixed, *cells], ["file_rank", "source_file", "record_ord", *(f"c{i}" for i in range(width))])

        for ord_, cells in enumerate(self._records(path), 1):
            if self.header is None:
                rows.append((ord_, cells))
            elif place is None:
                place = [at[h] for h in cells]
            else:
                aligned = [""] * width
                for i, v in zip(place, cells):
                    aligned[i] = v
                rows.append((ord_, aligned))
            if len(rows) == 2000:
                yield batch()
                rows = []
        if rows:
            yield batch()


class ContactExports(DataSource):
    """``contact_exports``: the records of exports; a file is read by one task, since whether a line break ends a record
    depends on all quotes before it; small files are read together.

    Options: ``files`` (a JSON list of paths and sizes, as ``list_exports`` gives them); ``headsOnly`` reads only each first record; ``header`` (a JSON list) aligns the
    records after the first to these columns: the last of a repeated name wins, missing cells are ''
    and surplus ones are dropped.
    """

    @classmethod
    def name(cls) -> str:
        return "contact_exports"

    def _header(self) -> list[str] | None:
        return json.loads(self.options["header"]) if "header" in self.options else None

    def schema(self) -> str:
        h = self._header()
        tail = "cells array<string>" if h is None else ", ".join(f"c{i} string" for i in range(len(h)))
        return "file_rank int, source_file string, record_ord int" + (", " + tail if tail else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), None)


def read_records(spark: SparkSession, folder: str, heads_only: bool = False) -> DataFrame:
    """``file_rank, source_file, record_ord, cells`` of every record; record 1 is a file's header."""
    spark.dataSource.register(ContactExports)
    found = json.dumps(list_exports(spark, folder))
    return spark.read.format("contact_exports").option("files", found).option("headsOnly", str(heads_only).lower()).load()


def header_union(records: DataFrame) -> list[str]:
    """Header names in the order in which they first appear over the files, compared exactly."""
    names = records.filter("record_ord = 1").select("file_rank", F.posexplode("cells").alias("pos", "name"))
    first = names.groupBy("name").agg(F.min(F.struct("file_rank", "pos")).alias("at"))
    return [r["name"] for r in first.orderBy("at").collect()]  # as many rows as the table has columns


def read_contacts(spark: SparkSession, folder: str) -> ContactTable:
    """The exports of a folder as one table under the union of their headers.

    ``row_id`` orders rows by file and record; a blank line is a row. A folder without records gives
    an empty table.
    """
    header = header_union(read_records(spark, folder, heads_only=True))
    found = json.dumps(list_exports(spark, folder))
    df = spark.read.format("contact_exports").option("files", found).option("header", json.dumps(header)).load()
    cols = [f"c{i}" for i in range(len(header))]
    row_id = F.col("file_rank").cast("long") * F.lit(1 << 32) + F.col("record_ord")
    return ContactTable(df.select(row_id.alias("row_id"), "source_file", F.col("record_ord").alias("source_row"), *cols), header, cols)
