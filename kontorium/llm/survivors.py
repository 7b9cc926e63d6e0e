"""Which member's value survives in a group of duplicates: partial orders of currency.

For each group and field the members that say something form a partial order: a more trusted source
comes later than a less trusted one, and a later time later than an earlier one. Where times are
missing, a value is as current as its latest timed writing in the group; failing that, transitions between
value classes (how values look, such as upper case or abbreviated) that were learned from timestamped members
say which of two is the later. The order is sorted topologically and a value that nothing follows survives.

A group's members are first folded to the few that can matter: per trust and class the latest and the
untimed one. What reaches the resolving task per group is thus bounded, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_line
from ..operators.ordered import with_previous
from ..operators.skew import hot_keys, spread_join
from ..session import cut

# Phrases that say no value is known, as word sequences.
PLACEHOLDERS = [
    "n a", "null", "none", "nil", "unknown", "not known", "not provided", "not available", "not specified", "no tiene", "sin dato", "sin datos",
    "no data", "no value", "desconocido", "no aplica", "not applicable", "undefined", "unbekannt", "keine angabe", "inconnu", "tbd",
]

FIELDS = ["first_name", "last_name", "organization_name", "address_1_formatted", "photo", "email_1_value"]

#: Source tables up to this measured length are broadcast to the members.
BROADCAST_FILES = 200_000
#: Stands for a missing trust.
NO_TRUST = -(1 << 31)
#: Value forms there can be; the bound on what a group holds per trust level.
FORMS = 16


def says_something(c: Column) -> Column:
    """True where a cell has words and these are no phrase for a missing value."""
    line = word_line(c)
    return (line != "") & ~line.isin(*PLACEHOLDERS)


def value_form(c: Column) -> Column:
    """How a value looks, 0 to 15: one bit each for all upper case, all lower case, marks, and accents."""
    v = F.coalesce(c, F.lit(""))
    bits = [(F.upper(v) == v, 1), (F.lower(v) == v, 2), (v.rlike(r"[^\p{L}\p{Nd}\s]"), 4), (v.rlike(r"[^\x00-\x7F]"), 8)]
    return sum((F.when(x, n).otherwise(0) for x, n in bits), F.lit(0)).cast("int")


def candidates(members: DataFrame, rows: DataFrame, files: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """``group_id, field_name, row_id, trust, updated_at, form, value`` of members that say something.

    Repeated members count once; members without a row or group are left out. A missing trust is below any.
    """
    m = members.select("group_id", "row_id").filter("group_id IS NOT NULL").distinct()
    full = m.join(rows.select("row_id", "source_file", "updated_at", *fields), "row_id")
    trust = files.select("source_file", F.coalesce("trust", F.lit(NO_TRUST)).alias("trust"))
    trust = trust.groupBy("source_file").agg(F.max("trust").alias("trust"))
    if files.count() <= BROADCAST_FILES:
        full = full.join(F.broadcast(trust), "source_file", "left")
    else:
        full = spread_join(full, trust, ["source_file"], hot_keys(full, ["source_file"], m.count()), "left")
    cells = F.array(*[F.when(says_something(F.col(f)), F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"))) for f in fields])
    flat = full.select("group_id", "row_id", F.coalesce("trust", F.lit(NO_TRUST)).alias("trust"), "updated_at", F.explode(F.array_compact(cells)).alias("x"))
    return flat.select("group_id", "x.field_name", "row_id", "trust", "updated_at", value_form(F.col("x.value")).alias("form"), "x.value")


def learn_precedence(cands: DataFrame) -> dict[str, set[tuple[int, int]]]:
    """Per field the pairs (earlier form, later form) that timestamped members follow more often than not.

    Counted over all neighbours in time within a group and field, of whatever trust; equal forms and
    ties teach nothing. Pairs count by how much they outweigh their reverse; one that would close a ring
    with stronger ones is left out, so what comes back is an order. At most ``FORMS`` squared pairs a field
    reach the driver.
    """
    timed = cands.filter("updated_at IS NOT NULL").select("group_id", "field_name", "updated_at", "row_id", "form")
    steps = with_previous(timed, ["group_id", "field_name"], ["updated_at", "row_id"], ["form"]).filter("prev_form IS NOT NULL AND prev_form <> form")
    counts = {(r["field_name"], r["prev_form"], r["form"]): r["n"] for r in steps.groupBy("field_name", "prev_form", "form").agg(F.count("*").alias("n")).collect()}
    lead = {(f, a, b): n - counts.get((f, b, a), 0) for (f, a, b), n in counts.items()}
    out: dict[str, set[tuple[int, int]]] = {}
    for (field, a, b), n in sorted(lead.items(), key=lambda x: (-x[1], x[0])):
        kept = out.get(field, set())
        if n > 0 and not _leads(kept, b, a):
            out.setdefault(field, set()).add((a, b))
    return out


def _leads(edges: set[tuple[int, int]], a: int, b: int) -> bool:
    """True where a path of edges leads from a to b."""
    seen, todo = {a}, [a]
    while todo:
        x = todo.pop()
        if x == b:
            return True
        new = {w for v, w in edges if v == x} - seen
        seen |= new
        todo += new
    return False


def partial_order(nodes: list[dict], later: set[tuple[int, int]] | None) -> set[tuple[int, int]]:
    """The edges (earlier, later), by place in ``nodes``, of members of one trust; without rings.

    Times order timed members. By ``later`` a learned transition orders an untimed member and any other, unless
    others contradict it. An untimed member that nothing orders against a timed one precedes it, as all do
    without ``later``.
    """
    timed = sorted((i for i, n in enumerate(nodes) if n["at"] is not None), key=lambda i: nodes[i]["at"])
    loose = [i for i, n in enumerate(nodes) if n["at"] is None]
    edges: set[tuple[int, int]] = set()
    ranks = sorted({nodes[i]["at"] for i in timed})
    for a, b in zip(ranks, ranks[1:]):
        edges |= {(i, j) for i in timed if nodes[i]["at"] == a for j in timed if nodes[j]["at"] == b}
    if later is None:
        return edges | {(i, j) for i in loose for j in timed}
    form = [n["form"] for n in nodes]
    learned = {(i, j) for i in range(len(nodes)) for j in range(len(nodes)) if (i in loose or j in loose) and (form[i], form[j]) in later}
    every = edges | learned
    edges |= {(i, j) for i, j in learned if not _leads(every, j, i)}
    for i in loose:
        edges |= {(i, j) for j in timed if not _leads(edges, j, i)}
    return edges


def latest(nodes: list[dict], later: set[tuple[int, int]] | None) -> int:
    """The row of the topologically latest node of one group and field.

    Nodes: ``trust, form, at`` (None if missing) and ``row``. Only nodes of the top trust can be the latest. Among
    them those that no other follows end the topological order; the smallest row of these survives.
    """
    top = max(n["trust"] for n in nodes)
    nodes = [n for n in nodes if n["trust"] == top]  # all others precede these
    if len(nodes) == 1:
        return nodes[0]["row"]
    followed = {i for i, _ in partial_order(nodes, later)}
    return min(n["row"] for i, n in enumerate(nodes) if i not in followed)


def _resolve(learned: dict[str, set[tuple[int, int]]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                latest(nodes, None if learned is None else learned.get(field, set()))
                for field, nodes in zip(b.column(1).to_pylist(), b.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.int64())], ["group_id", "field_name", "row_id"])

    return run


def surviving_values(cands: DataFrame, missing_time: str = "earliest") -> DataFrame:
    """``group_id, field_name, row_id``: the member whose value survives, one per group and field.

    ``missing_time``: "earliest" puts untimed members before all timed ones of the same trust; "learned"
    places them by their value's other writings and by the transitions of value forms. Full ties go to the smallest row. A group where no
    member says anything gives no row.
    """
    if missing_time not in ("earliest", "learned"):
        raise ValueError(missing_time)
    learned = None
    if missing_time == "learned":
        cands = cut(cands, "candidates")
        learned = learn_precedence(cands)
        # an untimed member is as current as the latest timed one of the same trust and value
        newest = F.struct("updated_at", (-F.col("row_id")).alias("r"))
        values = cands.groupBy("group_id", "field_name", "trust", "form", word_line(F.col("value")).alias("value")).agg(
            F.max(F.when(F.col("updated_at").isNotNull(), newest)).alias("m"), F.min(F.when(F.col("updated_at").isNull(), F.col("row_id"))).alias("loose")
        )
        row = F.when(F.col("m").isNull(), F.col("loose")).otherwise(F.least(-F.col("m.r"), "loose"))
        cands = values.select("group_id", "field_name", "trust", "form", F.col("m.updated_at").alias("updated_at"), row.alias("row_id"))
    folded = cands.select("group_id", "field_name", "trust", "form", F.col("updated_at").alias("at"), "row_id").groupBy(
        "group_id", "field_name", "trust", "form", F.col("at").isNull().alias("untimed")
    ).agg(F.max(F.struct("at", (-F.col("row_id")).alias("r"))).alias("m"))
    node = F.struct("trust", "form", F.col("m.at").alias("at"), (-F.col("m.r")).alias("row"))
    nodes = folded.groupBy("group_id", "field_name").agg(F.collect_list(node).alias("nodes"))
    return nodes.mapInArrow(_resolve(learned), "group_id long, field_name string, row_id long")
