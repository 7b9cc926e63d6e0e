"""One record per cluster: base row, backfill, name variants, slot unions, names and numbering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phones import identity_key, render_phone
from ..functions.text import dedupe_name_tokens, jtrim, non_blank, strip_accents
from ..session import cut
from .contacts import SLOT, ContactTable, explode_phones, identity_score, labelled, phone_occurrences
from .ordered import number_within

# Phones a record may hold, and the order in which names are collapsed.
PHONE_SLOTS = 20
NAME_ORDER = ["Name Prefix", "First Name", "Middle Name", "Last Name", "Name Suffix", "Nickname"]


@dataclass(frozen=True)
class Merged:
    """``df``: cluster_id, one column s<i> per scalar header, phones/emails/websites arrays of (label, value)."""

    df: DataFrame
    header: list[str]
    scalars: list[int]


def full_name(t: ContactTable) -> Column:
    """First and last name, trimmed and joined, without accents."""
    return strip_accents(jtrim(F.concat(t.cell("First Name"), F.lit(" "), t.cell("Last Name"))))


def base_rows(t: ContactTable, members: DataFrame) -> DataFrame:
    """``cluster_id, base_row, score``: the row with most identity cells filled, the earliest on ties."""
    scored = t.df.select("row_id", identity_score(t).alias("score")).join(members, "row_id")
    best = scored.groupBy("cluster_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "row_id")).alias("b"))
    return best.select("cluster_id", F.col("b.row_id").alias("base_row"), (-F.col("b.s")).alias("score"))


def backfilled(t: ContactTable, members: DataFrame) -> DataFrame:
    """``cluster_id, s<i>...``: the base row's cells, blank ones filled from the first row that has one.

    The base's own cell stays untrimmed; where no row has anything, the base's blank stays as it is.
    Accents are stripped at the end.
    """
    rows = t.df.join(members, "row_id").withColumn("_o", F.struct((-identity_score(t)).alias("s"), F.col("row_id").alias("r")))
    aggs = []
    for i in t.scalars():
        c = F.col(f"`{t.columns[i]}`")
        base, fill = F.min_by(c, "_o"), F.min_by(F.when(non_blank(c), c), F.when(non_blank(c), F.col("row_id")))
        aggs += [base.alias(f"_b{i}"), fill.alias(f"_f{i}")]
    out = rows.groupBy("cluster_id").agg(*aggs, F.count("*").alias("n_rows")) if aggs else rows.groupBy("cluster_id").agg(F.count("*").alias("n_rows"))
    cells = [
        strip_accents(F.when(non_blank(F.col(f"_b{i}")), F.col(f"_b{i}")).otherwise(F.coalesce(f"_f{i}", f"_b{i}", F.lit("")))).alias(f"s{i}")
        for i in t.scalars()
    ]
    return out.select("cluster_id", "n_rows", *cells)


def name_variants(t: ContactTable, members: DataFrame) -> DataFrame:
    """``cluster_id, variants``: the other full names of a cluster, each once, by first row.

    A cluster has at most as many rows as the clustering's cap, so its array is small.
    """
    o = F.struct((-identity_score(t)).alias("s"), F.col("row_id").alias("r"))
    rows = t.df.select("row_id", full_name(t).alias("name"), o.alias("o")).join(members, "row_id")
    g = rows.groupBy("cluster_id").agg(
        F.min_by("name", "o").alias("base"), F.sort_array(F.collect_list(F.struct("row_id", "name"))).alias("all")
    )
    names = F.array_distinct(F.filter(F.transform("all", lambda x: x["name"]), lambda n: n != ""))
    return g.select("cluster_id", F.array_remove(names, F.col("base")).alias("variants"))


def phone_union(t: ContactTable, members: DataFrame) -> DataFrame:
    """``cluster_id, ord, label, value``: each number of a cluster once, as its first row wrote it."""
    p = explode_phones(t).join(members, "row_id").repartition("cluster_id")
    first = p.groupBy("cluster_id", identity_key(F.col("key_type"), F.col("canonical_key")).alias("key")).agg(
        F.min(
            F.struct(
                "row_id", "phone_ord", labelled(F.col("source_label"), "Mobile").alias("label"),
                render_phone(F.col("key_type"), F.col("country"), F.col("canonical_key")).alias("value"),
            )
        ).alias("p")
    )
    return first.select("cluster_id", "p.row_id", F.col("p.phone_ord").alias("ord"), "p.label", "p.value")


def slot_union(t: ContactTable, members: DataFrame, family: str, case_sensitive: bool) -> DataFrame:
    """``cluster_id, row_id, ord, label, value``: distinct slot values of a cluster, the first writing of each."""
    slots = t.slots(family)
    if not slots:
        return members.sparkSession.createDataFrame([], "cluster_id long, row_id long, ord int, label string, value string")
    cells = F.array(
        *[
            F.struct(
                F.lit(n).alias("ord"), labelled(F.lit("") if lab is None else lab, "Other").alias("label"),
                F.coalesce(jtrim(v), F.lit("")).alias("value"),
            )
            for n, v, lab in slots
        ]
    )
    e = t.df.select("row_id", F.explode(F.filter(cells, lambda x: x["value"] != "")).alias("x")).select("row_id", "x.*")
    e = e.join(members, "row_id").repartition("cluster_id")
    key = F.col("value") if case_sensitive else F.lower("value")
    first = e.groupBy("cluster_id", key.alias("key")).agg(F.min(F.struct("row_id", "ord", "label", "value")).alias("p"))
    return first.select("cluster_id", "p.*")


def _slot_rows(t: ContactTable, phones: DataFrame) -> DataFrame:
    """``row_id, family, key, ord, label, value`` of all filled slots; 0 phones, 1 e-mails, 2 websites."""
    cells = []
    for family, name, case_sensitive in ((1, "E-mail", False), (2, "Website", True)):
        for n, v, lab in t.slots(name):
            value = F.coalesce(jtrim(v), F.lit(""))
            label = labelled(F.lit("") if lab is None else lab, "Other")
            key = value if case_sensitive else F.lower(value)
            cells.append(F.struct(F.lit(family).alias("family"), key.alias("key"), F.lit(n).alias("ord"), label.alias("label"), value.alias("value")))
    out = phones.select("row_id", F.lit(0).alias("family"), "key", F.col("phone_ord").alias("ord"), "label", "value")
    if cells:
        filled = F.filter(F.array(*cells), lambda x: x["value"] != "")
        out = out.union(t.df.select("row_id", F.explode(filled).alias("x")).select("row_id", "x.*"))
    return out


def gathered_slots(t: ContactTable, members: DataFrame, phones: DataFrame) -> DataFrame:
    """``cluster_id, phones, emails, websites``: distinct slot values of a cluster in order, as arrays of (label, value)."""
    e = _slot_rows(t, phones).join(members, "row_id").repartition("cluster_id")
    first = e.groupBy("cluster_id", "family", "key").agg(F.min(F.struct("row_id", "ord", "label", "value")).alias("p"))
    rows = first.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("family", "p.row_id", "p.ord", "p.label", "p.value"))).alias("a"))

    def of(family: int) -> Column:
        own = F.filter("a", lambda x: x["family"] == family)
        return F.transform(own, lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value")))

    return rows.select("cluster_id", of(0).alias("phones"), of(1).alias("emails"), of(2).alias("websites"))


def _cells_and_names(t: ContactTable, members: DataFrame) -> DataFrame:
    """``backfilled`` and ``name_variants`` in one pass over the rows."""
    scalars = t.scalars()
    rows = t.df.join(members, "row_id").withColumn("_o", F.struct((-identity_score(t)).alias("s"), F.col("row_id").alias("r"))).withColumn("_n", full_name(t))
    aggs = [F.count("*").alias("n_rows"), F.min_by("_n", "_o").alias("_base"), F.sort_array(F.collect_list(F.struct("row_id", "_n"))).alias("_all")]
    for i in scalars:
        c = F.col(f"`{t.columns[i]}`")
        aggs += [F.min_by(c, "_o").alias(f"_b{i}"), F.min_by(F.when(non_blank(c), c), F.when(non_blank(c), F.col("row_id"))).alias(f"_f{i}")]
    out = rows.groupBy("cluster_id").agg(*aggs)
    raw = [F.when(non_blank(F.col(f"_b{i}")), F.col(f"_b{i}")).otherwise(F.coalesce(f"_f{i}", f"_b{i}", F.lit(""))) for i in scalars]
    names = F.array_distinct(F.filter(F.transform("_all", lambda x: x["_n"]), lambda n: n != ""))
    # one expression for all cells: the accent tables are planned once
    bare = F.transform(F.array(*raw), strip_accents) if raw else F.array()
    out = out.select("cluster_id", "n_rows", F.array_remove(names, F.col("_base")).alias("variants"), bare.alias("_s"))
    return out.select("cluster_id", "n_rows", "variants", *[F.get("_s", F.lit(k)).alias(f"s{i}") for k, i in enumerate(scalars)])


def merged_contacts(t: ContactTable, members: DataFrame, phones: DataFrame | None = None, phone_slots: int = PHONE_SLOTS) -> Merged:
    """One record per cluster in cluster order, names collapsed and numbered.

    ``t`` must hold the rows of ``members`` (blocklisted rows are dropped by the join). Null cells count
    as empty. Phones beyond ``phone_slots`` are left out of the record, as the output format has it.
    ``phones`` are the table's ``phone_occurrences``, if they are at hand.
    """
    phones = phone_occurrences(t) if phones is None else phones
    none = F.array().cast("array<struct<label: string, value: string>>")
    out = _cells_and_names(t, members).join(gathered_slots(t, members, phones), "cluster_id", "left")
    scalars = t.scalars()
    at = {t.header[i]: i for i in reversed(scalars)}
    cells = {i: F.col(f"s{i}") for i in scalars}
    if "First Name" in at:
        parts = [jtrim(F.col(f"s{at[h]}")) for h in NAME_ORDER if h in at]
        shown = F.filter(F.array(*parts), lambda p: p != "")
        variants = F.filter(F.transform("variants", jtrim), lambda v: v != "")
        cells[at["First Name"]] = F.array_join(dedupe_name_tokens(F.concat(shown, variants), stripped=True), " - ")
        for h in NAME_ORDER:
            if h in at and h != "First Name":
                cells[at[h]] = F.lit("")
    df = out.select(
        "cluster_id", "n_rows", *[c.alias(f"s{i}") for i, c in cells.items()],
        F.slice(F.coalesce("phones", none), 1, phone_slots).alias("phones"),
        F.coalesce("emails", none).alias("emails"), F.coalesce("websites", none).alias("websites"),
    )
    if "First Name" in at:
        df = numbered_names(df, f"s{at['First Name']}", "cluster_id")
    return Merged(df, t.header, scalars)


def display_key(name: Column) -> Column:
    """What numbering groups by: the first ' - ' segment of the name in lower case."""
    base = jtrim(strip_accents(F.coalesce(name, F.lit(""))))
    head = jtrim(F.get(F.split(base, " - ", 2), F.lit(0)))
    return F.lower(F.when(head == "", base).otherwise(head))


def numbered_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Append 2, 3, ... to the second, third, ... name of the same first segment, by ``order``.

    Empty names stay empty and are not counted. A segment that most names share is counted over range
    partitions, not in one task.
    """
    keyed = cut(df.withColumn("_key", display_key(F.col(name))), "named")
    n = number_within(keyed.filter("_key != ''").select("_key", order), ["_key"], [order], "_n").select(order, "_n")
    base = jtrim(strip_accents(F.coalesce(F.col(name), F.lit(""))))
    new = F.when(F.col("_n") > 1, F.concat(base, F.lit(" "), F.col("_n").cast("string"))).otherwise(F.col(name))
    return keyed.join(n, order, "left").withColumn(name, new).select(*df.columns)


def final_header(header: list[str], phones: int, emails: int, websites: int) -> list[str]:
    """The output header: each slot family as 1..k Label/Value pairs where its first column stood."""
    width = {"Phone": max(phones, 1), "E-mail": max(emails, 1), "Website": max(websites, 1)}
    out, done = [], set()
    for h in header:
        m = SLOT.fullmatch(h)
        if not m:
            out.append(h)
        elif m[1] not in done:
            done.add(m[1])
            out += [f"{m[1]} {k} - {side}" for k in range(1, width[m[1]] + 1) for side in ("Label", "Value")]
    return out


def slot_widths(m: Merged) -> tuple[int, int, int]:
    """Most phones, e-mails and websites of any record; 0 for an empty result."""
    r = m.df.agg(*[F.max(F.size(c)) for c in ("phones", "emails", "websites")]).first()
    return tuple(x or 0 for x in r)


def output_columns(m: Merged, widths: tuple[int, int, int]) -> tuple[list[str], list[Column]]:
    """The final header and the column of each of its fields; Notes and Labels come out empty."""
    array = {"Phone": "phones", "E-mail": "emails", "Website": "websites"}
    first = {m.header[i]: i for i in reversed(m.scalars)}
    header, cols = final_header(m.header, *widths), []
    for h in header:
        if s := SLOT.fullmatch(h):
            c = F.get(F.col(array[s[1]]), F.lit(int(s[2]) - 1))[s[3].lower()]
        elif h in first:
            c = F.col(f"s{first[h]}")
        else:
            c = F.lit("")
        cols.append(F.coalesce(c, F.lit("")))
    return header, cols


def stats(all_rows: DataFrame, m: Merged) -> DataFrame:
    """One row: source rows (blocklisted ones included), contacts, clusters of more than one row, and the most
    phones, e-mails and websites of any record."""
    counts, widths = ("source_rows", "contacts", "merged_clusters"), ("phones", "emails", "websites")
    rows = all_rows.select(F.lit(1).alias("source_rows"), *[F.lit(0).alias(c) for c in (*counts[1:], *widths)])
    made = m.df.select(F.lit(0), F.lit(1), (F.col("n_rows") > 1).cast("int"), *[F.size(c) for c in widths])
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts]
    return rows.union(made).agg(*sums, *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(f"most_{c}") for c in widths])
