"""Contact tables: header lookup, blocklist filter, phone explode, slots and identity."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phones import PHONE_FIELDS, identity_key, parse_phones, render_phone
from ..functions.text import jtrim, non_blank

# Header names of an export.
NAME_HEADERS = ["First Name", "Middle Name", "Last Name", "Name Prefix", "Name Suffix", "Nickname"]
IDENTITY_HEADERS = ["First Name", "Last Name", "Organization Name", "E-mail 1 - Value", "Address 1 - Formatted", "Photo"]
SLOT = re.compile(r"(Phone|E-mail|Website) (\d+) - (Label|Value)")

#: The columns of a contact_rows table under the export's header names.
TABLE_HEADERS = {
    "first_name": "First Name", "middle_name": "Middle Name", "last_name": "Last Name", "name_prefix": "Name Prefix",
    "name_suffix": "Name Suffix", "nickname": "Nickname", "organization_name": "Organization Name",
    "address_1_formatted": "Address 1 - Formatted", "photo": "Photo", "phone_1_label": "Phone 1 - Label",
    "phone_1_value": "Phone 1 - Value", "phone_2_label": "Phone 2 - Label", "phone_2_value": "Phone 2 - Value",
    "email_1_value": "E-mail 1 - Value", "email_2_value": "E-mail 2 - Value", "website_1_value": "Website 1 - Value",
    "notes": "Notes", "labels": "Labels",
}


@dataclass(frozen=True)
class ContactTable:
    """Rows with ``row_id`` (global order), ``source_file``, ``source_row`` and one string column per header.

    ``columns[i]`` is the physical column of ``header[i]``; headers may hold dots or differ in case only.
    """

    df: DataFrame
    header: list[str]
    columns: list[str]

    def col(self, name: str) -> Column | None:
        """The column of an exact header name, or None."""
        return F.col(f"`{self.columns[self.header.index(name)]}`") if name in self.header else None

    def cell(self, name: str) -> Column:
        """The trimmed cell; '' where it is null or its header absent."""
        c = self.col(name)
        return F.lit("") if c is None else F.coalesce(jtrim(c), F.lit(""))

    def with_df(self, df: DataFrame) -> ContactTable:
        return ContactTable(df, self.header, self.columns)

    def scalars(self) -> list[int]:
        """Indexes of the columns with one value per contact: all but slots, Notes and Labels."""
        return [i for i, h in enumerate(self.header) if not SLOT.fullmatch(h) and h not in ("Notes", "Labels")]

    def slots(self, family: str) -> list[tuple[int, Column, Column | None]]:
        """(n, value, label) of a family's slots from 1 up to the first gap."""
        out, n = [], 1
        while (v := self.col(f"{family} {n} - Value")) is not None:
            out.append((n, v, self.col(f"{family} {n} - Label")))
            n += 1
        return out

    def phone_slots(self) -> list[tuple[int, Column, Column | None]]:
        """(order, value, label) of every phone slot in header order; gaps are allowed."""
        out = []
        for i, h in enumerate(self.header):
            if re.fullmatch(r"Phone \d+ - Value", h):
                out.append((len(out), F.col(f"`{self.columns[i]}`"), self.col(h.replace(" - Value", " - Label"))))
        return out


def from_table(rows: DataFrame) -> ContactTable:
    """A contact_rows table as a ContactTable; its null cells count as empty ones."""
    have = [c for c in TABLE_HEADERS if c in rows.columns]
    cells = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in have]
    df = rows.select("row_id", "source_file", F.col("source_row_number").alias("source_row"), *cells)
    return ContactTable(df, [TABLE_HEADERS[c] for c in have], have)


def is_spam(t: ContactTable) -> Column:
    """True where a name cell contains SPAM in any letter case, also inside a word."""
    flag = F.lit(False)
    for h in NAME_HEADERS:
        if (c := t.col(h)) is not None:
            flag = flag | F.coalesce(F.upper(c).contains("SPAM"), F.lit(False))
    return flag


def without_spam(t: ContactTable) -> ContactTable:
    """The rows that are not on the blocklist."""
    return t.with_df(t.df.filter(~is_spam(t)))


def explode_phones(t: ContactTable, anomalies: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per phone token: ``row_id``, ``phone_ord`` (from 1 in slot order), the phone fields, ``source_label``.

    The label beside a cell holds for all its tokens and is null where its column is absent. With
    ``anomalies`` rejected tokens (null ``key_type``) stay in and count for ``phone_ord``.
    """
    ids = ["row_id", *(keep or [])]
    slots = t.phone_slots()
    schema = ", ".join(f"{c}: string" for c in PHONE_FIELDS)
    if not slots:
        empty = f"array<struct<{schema}, source_label: string>>"
        cells = F.lit(None).cast(empty)
    else:
        def with_label(v: Column, lab: Column | None) -> Column:
            label = F.lit(None).cast("string") if lab is None else lab
            return F.transform(parse_phones(v), lambda p: p.withField("source_label", label))

        cells = F.concat(*[with_label(v, lab) for _, v, lab in slots])
        if not anomalies:
            cells = F.filter(cells, lambda p: p["key_type"].isNotNull())
    df = t.df.select(*ids, F.posexplode(cells).alias("at", "phone"))
    return df.select(*ids, (F.col("at") + 1).alias("phone_ord"), "phone.*")


def labelled(label: Column, default: str) -> Column:
    """The trimmed label, or the default where it is null or blank."""
    l = jtrim(F.coalesce(label, F.lit("")))
    return F.when(l == "", F.lit(default)).otherwise(l)


def phone_occurrences(t: ContactTable) -> DataFrame:
    """``row_id, phone_ord, key, label, value`` of the phones of rows off the blocklist, as they are written out."""
    p = explode_phones(without_spam(t))
    return p.select(
        "row_id", "phone_ord", identity_key(F.col("key_type"), F.col("canonical_key")).alias("key"),
        labelled(F.col("source_label"), "Mobile").alias("label"),
        render_phone(F.col("key_type"), F.col("country"), F.col("canonical_key")).alias("value"),
    )


def key_index(occurrences: DataFrame) -> DataFrame:
    """``key, n_occ, n_rows, first_row``: occurrences, distinct rows and smallest row of each phone key.

    A row that lists a number twice counts twice in ``n_occ``. Rows are pre-aggregated per key and row
    before they are shuffled, so a key that fills a third of the table is no task of its own.
    """
    per_row = occurrences.groupBy("key", "row_id").agg(F.count("*").alias("k"))
    return per_row.groupBy("key").agg(
        F.sum("k").alias("n_occ"), F.count("*").alias("n_rows"), F.min("row_id").alias("first_row")
    )


def identity_score(t: ContactTable) -> Column:
    """How many of the identity cells are filled, 0 to 6."""
    score = F.lit(0)
    for h in IDENTITY_HEADERS:
        if (c := t.col(h)) is not None:
            score = score + non_blank(c).cast("int")
    return score
