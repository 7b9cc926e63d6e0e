"""Queries over the driver's tables, one per operator; each takes (spark, folder) and reads whole tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phones import phone_tokens, render_phone
from ..functions.text import dedupe_name_tokens, strip_accents
from ..operators import contacts as c
from ..operators import merge as m
from ..operators.clusters import capped_clusters
from ..operators.components import components
from ..operators.keycounts import counts_per_key
from ..operators.packed import LABELS, NOTES, split_packed
from ..operators.rawfiles import CHECKED_FIELDS, load_raw, path_types, path_values, rejects, schema_changes, typed_table
from ..operators.skew import hot_limit, spread_join
from ..session import cut, shared_folder, ship, written
from ..sources.exports import header_union, read_contacts, read_records
from ..sources.sink import csv_line, header_line
from .pipeline import resolve

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _contacts(spark: SparkSession, folder: str) -> c.ContactTable:
    return c.from_table(table(spark, folder, "contact_rows"))


def _members(t: c.ContactTable) -> DataFrame:
    return cut(capped_clusters(t).members, "members")


@query
def phone_parse(spark, d):
    """Every token of both phone cells with its key, rule and confidence."""
    p = c.explode_phones(_contacts(spark, d), anomalies=True)
    return p.select("row_id", F.col("phone_ord").cast("long").alias("phone_ord"), "raw", "cleaned_display", "canonical_key", "key_type", "country", "category", "confidence", "warning")


@query
def phone_anomalies(spark, d):
    """Tokens without a usable number, with the reason."""
    p = c.explode_phones(_contacts(spark, d), anomalies=True).filter("key_type IS NULL")
    return p.select("row_id", "raw", F.col("warning").alias("reason"))


@query
def phone_category_counts(spark, d):
    p = c.explode_phones(_contacts(spark, d), anomalies=True)
    return p.groupBy("category").agg(F.count("*").alias("tokens"), F.countDistinct("row_id").alias("contacts"))


@query
def phone_render(spark, d):
    """The value written out for each usable phone."""
    p = c.explode_phones(_contacts(spark, d))
    return p.select("row_id", F.col("phone_ord").cast("long").alias("phone_ord"), render_phone(F.col("key_type"), F.col("country"), F.col("canonical_key")).alias("shown"))


@query
def phone_explode(spark, d):
    """Usable phones of rows off the blocklist with the label beside their cell."""
    p = c.explode_phones(c.without_spam(_contacts(spark, d)))
    return p.select("row_id", F.col("phone_ord").cast("long").alias("phone_ord"), "key_type", "canonical_key", "source_label")


@query
def phone_tokens_split(spark, d):
    """The tokens of both phone cells, before any rule."""
    slots = F.array(*[F.struct(F.lit(n).alias("slot"), phone_tokens(F.col(f"phone_{n}_value")).alias("tokens")) for n in (1, 2)])
    r = table(spark, d, "contact_rows").select("row_id", F.explode(slots).alias("x")).select("row_id", "x.slot", F.posexplode("x.tokens").alias("nth", "token"))
    return r.select("row_id", "slot", F.col("nth").cast("long").alias("nth"), "token")


@query
def accent_strip(spark, d):
    r = table(spark, d, "contact_rows")
    bare = r.select("row_id", F.transform(F.array(*c.TABLE_HEADERS), strip_accents).alias("cells"))
    return bare.select("row_id", *[F.get("cells", F.lit(i)).alias(x) for i, x in enumerate(c.TABLE_HEADERS)])


@query
def name_token_dedupe(spark, d):
    t = _contacts(spark, d)
    parts = F.array(*[t.cell(h) for h in m.NAME_ORDER])
    return t.df.select("row_id", F.array_join(dedupe_name_tokens(F.filter(parts, lambda p: p != "")), " - ").alias("name"))


@query
def spam_filter(spark, d):
    return c.without_spam(_contacts(spark, d)).df.select("row_id", "source_file", F.col("source_row").cast("long").alias("source_row"))


@query
def phone_key_index(spark, d):
    return c.key_index(c.phone_occurrences(_contacts(spark, d))).select("key", "n_occ", "n_rows", "first_row")


@query
def components_uncapped(spark, d):
    """Contacts linked by shared phones, directly or indirectly, however many hold one."""
    occ = cut(c.phone_occurrences(_contacts(spark, d)).select("key", "row_id"), "occ")
    keys = cut(c.key_index(occ).filter("n_rows >= 2"), "keys")
    hot = keys.filter(F.col("n_occ") > hot_limit(spark, occ.count())).select("key")
    links = spread_join(occ, keys.select("key", "first_row"), ["key"], hot)
    return components(links, "first_row", "row_id").select(F.col("v").alias("row_id"), F.col("root").alias("component"))


@query
def clusters_capped(spark, d):
    return capped_clusters(_contacts(spark, d)).members


@query
def merge_conflicts(spark, d):
    return capped_clusters(_contacts(spark, d)).conflicts


@query
def merge_conflict_rows(spark, d):
    """The occurrences behind each refused key, one per row (a hub key's are too many for one cell)."""
    r = capped_clusters(_contacts(spark, d)).conflict_rows
    return r.select("key", "row_id", F.col("phone_ord").cast("long").alias("phone_ord"), "source_file", F.col("source_row").cast("long").alias("source_row"))


@query
def base_row(spark, d):
    t = _contacts(spark, d)
    return m.base_rows(t, _members(t)).select("cluster_id", "base_row", F.col("score").cast("long").alias("score"))


@query
def scalar_backfill(spark, d):
    t = _contacts(spark, d)
    b = m.backfilled(t, _members(t))
    return b.select("cluster_id", *[F.col(f"s{i}").alias(t.columns[i]) for i in t.scalars()])


@query
def name_variants(spark, d):
    t = _contacts(spark, d)
    return m.name_variants(t, _members(t)).select("cluster_id", F.array_join("variants", " | ").alias("variants"))


@query
def phone_union(spark, d):
    t = _contacts(spark, d)
    return m.phone_union(t, _members(t)).select("cluster_id", "row_id", F.col("ord").cast("long").alias("ord"), "label", "value")


@query
def email_union(spark, d):
    t = _contacts(spark, d)
    return m.slot_union(t, _members(t), "E-mail", False).select("cluster_id", "row_id", F.col("ord").cast("long").alias("ord"), "label", "value")


@query
def website_union(spark, d):
    t = _contacts(spark, d)
    return m.slot_union(t, _members(t), "Website", True).select("cluster_id", "row_id", F.col("ord").cast("long").alias("ord"), "label", "value")


@query
def duplicate_name_suffix(spark, d):
    """Contacts of the table numbered by the first segment of their first name, in row order."""
    t = _contacts(spark, d)
    return m.numbered_names(t.df.select("row_id", t.cell("First Name").alias("name")), "name", "row_id")


@query
def slot_stats(spark, d):
    """Widest record and totals of the run."""
    t = _contacts(spark, d)
    out = resolve(t)
    out = m.Merged(cut(out.df, "merged"), out.header, out.scalars)
    return m.stats(t.df, out)


@query
def merged_contacts(spark, d):
    """The run's output: every contact as its record, with the header the records have."""
    t = _contacts(spark, d)
    out = resolve(t)
    out = m.Merged(cut(out.df, "merged"), out.header, out.scalars)
    header, columns = m.output_columns(out, m.slot_widths(out))
    return out.df.select("cluster_id", F.lit(header_line(header)).alias("header"), csv_line(columns).alias("line"))


@query
def csv_lines(spark, d):
    """The records of the table as CSV lines."""
    t = _contacts(spark, d)
    return t.df.select("row_id", csv_line([F.col(x) for x in t.columns]).alias("line"))


def _mounted(spark: SparkSession, folder: str) -> str:
    """The folder as a path that every host opens; an error where it is on no mounted file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    uri = hadoop.Path(folder).toUri()
    scheme = uri.getScheme() or hadoop.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()
    if scheme != "file":
        raise ValueError(f"exports are read by path, but the shared folder {folder} is on {scheme}; name a mounted one in spark.checkpoint.dir")
    return uri.getPath()


def _write_exports(spark: SparkSession, lines: DataFrame, head: str | None = None) -> str:
    """``source_file, at, line`` written out as one file per source, after a common header line if one is given."""
    path = os.path.join(_mounted(spark, shared_folder(spark)), f"kontorium-exports-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    written(spark, path)

    def records(batches):
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())

    def write(batches):
        for name, rows in groupby(records(batches), lambda r: r[0]):
            part = os.path.join(path, f"{name}.{uuid.uuid4().hex}.part")  # a task that runs twice leaves one whole file
            with open(part, "w", encoding="utf-8", newline="") as f:
                if head is not None:
                    f.write(head + "\r\n")
                f.writelines(line + "\r\n" for _, line in rows)
            os.replace(part, os.path.join(path, name))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], ["source_file"])

    placed = lines.filter("source_file IS NOT NULL").repartition("source_file").sortWithinPartitions("source_file", "at").select("source_file", "line")
    placed.mapInArrow(write, "source_file string").count()
    return path


def _export_folder(spark: SparkSession, d: str) -> str:
    """The loaded files of contact_rows written out as exports, all with one header."""
    t = _contacts(spark, d)
    return _write_exports(spark, t.df.select("source_file", F.col("source_row").alias("at"), csv_line([F.col(x) for x in t.columns]).alias("line")), header_line(t.header))


def _raw_folder(spark: SparkSession, d: str) -> str:
    """The raw files as they were, whose headers differ and some of whose records are damaged."""
    raw = table(spark, d, "raw_lines")
    return _write_exports(spark, raw.select("source_file", F.col("source_row_number").alias("at"), F.coalesce("line", F.lit("")).alias("line")))


@query
def csv_tokenize(spark, d):
    """The raw files read by the tokenizer: cells per record."""
    r = read_records(spark, _raw_folder(spark, d))
    return r.select("source_file", "record_ord", F.size("cells").alias("cells"), F.array_join("cells", "\x1f").alias("text"))


@query
def header_union_of_exports(spark, d):
    """The header names of the raw files, in the order in which they first appear."""
    names = header_union(read_records(spark, _raw_folder(spark, d), heads_only=True))
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, name string")


@query
def aligned_exports(spark, d):
    """Exports of one header, written from the table and read back as one table."""
    t = read_contacts(spark, _export_folder(spark, d))
    return t.df.select("source_file", "source_row", csv_line([F.col(x) for x in t.columns]).alias("line"))


@query
def aligned_raw_exports(spark, d):
    """The raw files as one table under the union of their headers."""
    t = read_contacts(spark, _raw_folder(spark, d))
    return t.df.select("source_file", "source_row", csv_line([F.col(x) for x in t.columns]).alias("line"))


@query
def p1_found(spark, d):
    p = counts_per_key(table(spark, d, "phones").filter("key_type IS NOT NULL"), ["key_type", "canonical_key"], "phone_id", "row_id")
    return p.filter("owners >= 2").select("key_type", "canonical_key", F.col("items").alias("phones"), F.col("owners").alias("contacts"))


@query
def p1_all_keys(spark, d):
    """Every key, those of one contact and the anomalies' null key included."""
    p = counts_per_key(table(spark, d, "phones"), ["key_type", "canonical_key"], "phone_id", "row_id")
    return p.select("key_type", "canonical_key", F.col("items").alias("phones"), F.col("owners").alias("contacts"))


@query
def p2_found(spark, d):
    return split_packed(table(spark, d, "contact_rows"), "row_id", {"labels": LABELS, "notes": NOTES}, least=2)


@query
def p2_values(spark, d):
    """Every value, also of cells that hold one."""
    return split_packed(table(spark, d, "contact_rows"), "row_id", {"labels": LABELS, "notes": NOTES})


def _raw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return load_raw(table(spark, d, "raw_lines"), table(spark, d, "field_aliases"))


@query
def p6_found(spark, d):
    heads, records = _raw(spark, d)
    return schema_changes(table(spark, d, "contact_files"), heads, path_types(records))


@query
def p6_table(spark, d):
    """All sound records of all files in one schema, with the cells that did not cast."""
    fields = [r[0] for r in table(spark, d, "field_aliases").select("field_name").filter("field_name IS NOT NULL").distinct().orderBy("field_name").collect()]  # fixed table
    return typed_table(_raw(spark, d)[1], fields)


@query
def p6_types(spark, d):
    """How many cells of each path of a file have each raw type."""
    return path_types(_raw(spark, d)[1])


@query
def p7_found(spark, d):
    _, records = _raw(spark, d)
    return rejects(records, path_types(records, CHECKED_FIELDS)).select("file_id", "source_row_number", "reason")


@query
def p7_cells(spark, d):
    """The failing cells behind each invalid value."""
    _, records = _raw(spark, d)
    return rejects(records, path_types(records, CHECKED_FIELDS)).filter("fields IS NOT NULL")


@query
def p7_loaded(spark, d):
    """All records without a reason, one row per field."""
    _, records = _raw(spark, d)
    bad = rejects(records, path_types(records, CHECKED_FIELDS)).select("file_id", "source_row_number")
    good = path_values(records).join(bad, ["file_id", "source_row_number"], "left_anti")
    return good.select("file_id", "source_row_number", F.explode("path_values").alias("field_name", "cell"))


def all_queries() -> dict[str, Query]:
    return dict(_ALL)
