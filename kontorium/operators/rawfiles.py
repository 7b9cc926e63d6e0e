"""Raw types of cells, changes between a file and its predecessor, and rejects with their reason."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phones import parse_phones
from ..functions.text import trim_blank
from ..session import cut
from ..sources.rawlines import CHUNK_RECORDS, alias_map, cell_of, headers, parse_records
from .ordered import with_previous

#: Fields whose change of type counts.
TYPED_FIELDS = ["Birthday", "Starred", "Times Contacted", "Postal Code"]
#: Fields whose cells are checked against the file's main type.
CHECKED_FIELDS = ["Birthday", "Starred", "Times Contacted"]

# The words of a flag.
FLAG_WORDS = ["true", "false", "yes", "no"]

NUMBER = r"^[0-9]+([.,][0-9]+)?$"
DATE = r"^([0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./]([0-9]{4}|[0-9]{2}))$"
_DAY = r"^(?:(?P<y1>[0-9]{4})[-./](?P<m1>[0-9]{1,2})[-./](?P<d1>[0-9]{1,2})|(?P<d2>[0-9]{1,2})[-./](?P<m2>[0-9]{1,2})[-./](?P<y2>[0-9]{4})|(?P<y3>[0-9]{4})(?P<m3>[0-9]{2})(?P<d3>[0-9]{2}))$"
_MAIL = r"^[^\s@]+@[^\s@]+$"


def trimmed_type(v: Column) -> Column:
    """number, date, flag or text, for a trimmed cell; null where it is null or empty."""
    digit = (v >= "0") & (v < ":")  # patterns are tried on what begins with a digit only
    return (
        F.when(v.isNull() | (v == ""), F.lit(None).cast("string"))
        .when(digit, F.when(v.rlike(NUMBER), "number").when(v.rlike(DATE), "date").otherwise("text"))
        .when(F.lower(v).isin(*FLAG_WORDS), "flag").otherwise("text")
    )


def raw_type(c: Column) -> Column:
    """The type of a cell; null where the cell is blank."""
    return trimmed_type(trim_blank(c))


def _snake(field: str) -> str:
    return "_".join("".join(ch if ch.isalnum() else " " for ch in field.lower()).split())


def load_raw(raw: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, records): both written, since several steps read them."""
    heads = cut(headers(raw, alias_map(aliases)), "headers")
    return heads, cut(parse_records(raw, heads), "records")


def path_values(records: DataFrame) -> DataFrame:
    """Sound records as ``file_id, source_row_number, path_values``: a map from field to raw cell."""
    good = records.filter("reason IS NULL")
    paired = F.arrays_zip(F.col("fields").alias("k"), F.col("cells").alias("v"))
    # the first cell of a repeated field holds; few headers repeat one
    first = F.map_from_entries(F.filter(paired, lambda x, i: F.array_position(F.col("fields"), x["k"]) == i + 1))
    plain = F.size(F.array_distinct("fields")) == F.size("fields")
    return good.select("file_id", "source_row_number", F.when(plain, F.map_from_arrays("fields", "cells")).otherwise(first).alias("path_values"))


def path_types(records: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``file_id, field_name, raw_type, cells``: how many cells of each path of a file have each raw type.

    With ``fields`` only of these.
    """
    paths = F.col("path_values") if fields is None else F.map_filter("path_values", lambda k, _: k.isin(*fields))
    cells = path_values(records).select("file_id", F.explode(paths).alias("field_name", "cell"))
    # trimmed in a step of its own, and blank cells left out by that, so that each cell is looked at once
    filled = cells.select("file_id", "field_name", trim_blank(F.col("cell")).alias("v")).filter("v <> ''")
    return filled.groupBy("file_id", "field_name", trimmed_type(F.col("v")).alias("raw_type")).agg(F.count("*").alias("cells"))


def main_types(types: DataFrame) -> DataFrame:
    """``file_id, field_name, raw_type``: the type of most cells; on a tie the first in name order."""
    best = types.groupBy("file_id", "field_name").agg(F.min(F.struct((-F.col("cells")).alias("n"), "raw_type")).alias("b"))
    return best.select("file_id", "field_name", F.col("b.raw_type").alias("raw_type"))


def schema_changes(files: DataFrame, heads: DataFrame, types: DataFrame) -> DataFrame:
    """``file_id, field_name, change_kind`` of each raw file against its account's previous one.

    Kinds: added, removed, renamed (another header key for the field), retyped (another main type, for
    ``TYPED_FIELDS`` only). A file without account has no predecessor; a file without header has no fields.
    Where ``exported_at`` ties, the file id decides the order.
    """
    raw = files.filter("stage = 'raw' AND account IS NOT NULL").select("account", "exported_at", "file_id")
    order = with_previous(raw, ["account"], ["exported_at", "file_id"], ["file_id"]).filter("prev_file_id IS NOT NULL").select("file_id", "prev_file_id")
    pair = F.explode(F.arrays_zip(F.col("fields").alias("field_name"), F.col("keys").alias("key"))).alias("x")
    flat = heads.select("file_id", pair).select("file_id", "x.*").groupBy("file_id", "field_name").agg(F.min("key").alias("key"))
    flat = flat.join(main_types(types).filter(F.col("field_name").isin(*TYPED_FIELDS)), ["file_id", "field_name"], "left")
    now = flat.join(order, "file_id").select("file_id", "field_name", F.struct("key", "raw_type").alias("now"), F.lit(None).alias("was"))
    was = flat.withColumnRenamed("file_id", "prev_file_id").join(order, "prev_file_id").select(
        "file_id", "field_name", F.lit(None).alias("now"), F.struct("key", "raw_type").alias("was")
    )
    both = now.unionByName(was).groupBy("file_id", "field_name").agg(F.max("now").alias("now"), F.max("was").alias("was"))
    kinds = F.array(
        F.when(F.col("was").isNull(), "added"),
        F.when(F.col("now").isNull(), "removed"),
        F.when(F.col("now.key") != F.col("was.key"), "renamed"),
        F.when(F.col("now.raw_type") != F.col("was.raw_type"), "retyped"),
    )
    return both.select("file_id", "field_name", F.explode(F.array_compact(kinds)).alias("change_kind"))


def typed_table(records: DataFrame, fields: list[str]) -> DataFrame:
    """Sound records with one column per field, in one schema, and ``failed_casts``.

    Birthday is a date, Starred a boolean (also from 0 and 1), Times Contacted a number; all others are
    text. A filled cell that does not cast comes out null and its field in ``failed_casts``.
    """
    rows = path_values(records)
    cols, failed = [], []
    for f in fields:
        cell = trim_blank(F.col("path_values")[f])
        v = F.when(cell != "", cell)
        if f == "Birthday":
            d = F.replace(F.replace(v, F.lit("."), F.lit("-")), F.lit("/"), F.lit("-"))
            parts = F.split(d, "-")
            iso = F.when(d.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), d).when(
                d.rlike("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"), F.concat_ws("-", F.get(parts, F.lit(2)), F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))
            ).when(d.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))
            c = iso.try_cast("date")
        elif f == "Starred":
            low = F.lower(v)
            c = F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)
        elif f == "Times Contacted":
            c = F.when(v.rlike(NUMBER), F.replace(v, F.lit(","), F.lit(".")).try_cast("decimal(18,3)"))
        else:
            c = v
        cols.append(c.alias(_snake(f)))
        failed.append(F.when(v.isNotNull() & c.isNull(), F.lit(f)))
    return rows.select("file_id", "source_row_number", *cols, F.array_join(F.array_compact(F.array(*failed)), "|").alias("failed_casts"))


def _real_days(v: pa.Array) -> np.ndarray:
    """Which texts are calendar days, year first, day first, or eight digits year first."""
    m = pc.extract_regex(v, _DAY)
    filled = pc.fill_null(pc.is_valid(m), False).to_numpy(zero_copy_only=False)

    def part(*names: str) -> np.ndarray:
        total = np.zeros(len(v), int)
        for n in names:
            s = pc.fill_null(pc.struct_field(m, n), "")
            total += pc.cast(pc.if_else(pc.equal(s, ""), "0", s), pa.int64()).to_numpy(zero_copy_only=False)
        return total

    y, mo, d = part("y1", "y2", "y3"), part("m1", "m2", "m3"), part("d1", "d2", "d3")
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    inside = (mo >= 1) & (mo <= 12) & (y >= 1)
    most = days[np.where(inside, mo, 0)] + ((mo == 2) & leap)
    return filled & inside & (d >= 1) & (d <= most)


def _failing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label the failing cells of each record: ``bad`` lists their fields."""
    for b in batches:
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}

        def blank(name: str) -> np.ndarray:
            return pc.fill_null(pc.equal(col[name], ""), True).to_numpy(zero_copy_only=False)

        def differs(kind: str, main: str) -> np.ndarray:
            return pc.fill_null(pc.not_equal(col[kind], col[main]), False).to_numpy(zero_copy_only=False)

        mail = pc.fill_null(pc.match_substring_regex(col["mail"], _MAIL), True).to_numpy(zero_copy_only=False)
        texty = pc.fill_null(pc.equal(col["birthday_main"], "text"), False).to_numpy(zero_copy_only=False)
        marks = [
            ("Phone 1 - Value", col["phone_bad"].to_numpy(zero_copy_only=False)),
            ("E-mail 1 - Value", ~blank("mail") & ~mail),
            ("Birthday", ~blank("birthday") & ~_real_days(pc.fill_null(col["birthday"], "")) & ~texty),
            ("Starred", differs("starred", "starred_main")),
            ("Times Contacted", differs("times", "times_main")),
        ]
        hit = np.array([m for _, m in marks]).T
        bad = [[f for (f, _), x in zip(marks, row) if x] for row in hit]
        yield pa.RecordBatch.from_arrays([col["file_id"], col["source_row_number"], pa.array(bad, pa.list_(pa.string()))], ["file_id", "source_row_number", "bad"])


def value_failures(records: DataFrame, types: DataFrame) -> DataFrame:
    """``file_id, source_row_number, bad``: the fields of a sound record whose cells cannot hold their value.

    Blank cells never fail. What a file's cells mostly are (``types``) decides what Starred, Times
    Contacted and Birthday may be.
    """
    good = records.filter("reason IS NULL")
    mains = main_types(types).filter(F.col("field_name").isin(*CHECKED_FIELDS)).groupBy("file_id").agg(
        *[F.max(F.when(F.col("field_name") == f, F.col("raw_type"))).alias(a) for f, a in zip(CHECKED_FIELDS, ("birthday_main", "starred_main", "times_main"))]
    )
    chunk = F.floor(F.col("source_row_number") / CHUNK_RECORDS)
    last = good.groupBy("file_id").agg(F.max(chunk).alias("last"))
    spread = last.join(mains, "file_id", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    cells = good.select(
        "file_id", "source_row_number", chunk.alias("chunk"),
        F.exists(parse_phones(cell_of("Phone 1 - Value")), lambda p: p["key_type"].isNull()).alias("phone_bad"),
        trim_blank(cell_of("E-mail 1 - Value")).alias("mail"), trim_blank(cell_of("Birthday")).alias("birthday"),
        raw_type(cell_of("Starred")).alias("starred"), raw_type(cell_of("Times Contacted")).alias("times"),
    )
    return cells.join(spread, ["file_id", "chunk"]).drop("chunk").mapInArrow(_failing, "file_id long, source_row_number int, bad array<string>")


def rejects(records: DataFrame, types: DataFrame) -> DataFrame:
    """``file_id, source_row_number, reason, fields``: failing records with their first reason.

    ``fields`` names the failing cells of an invalid_value, joined by bars, and is null otherwise.
    """
    shape = records.filter("reason IS NOT NULL").select("file_id", "source_row_number", "reason", F.lit(None).cast("string").alias("fields"))
    values = value_failures(records, types).filter(F.size("bad") > 0)
    return shape.union(values.select("file_id", "source_row_number", F.lit("invalid_value"), F.array_join("bad", "|")))
