import random
from datetime import datetime, timedelta

import pytest

from helpers import rows
from kontorium.llm.survivors import FIELDS, candidates, latest, learn_precedence, surviving_values, value_form

T0 = datetime(2024, 1, 1)


def frames(spark, members, contacts, files):
    m = spark.createDataFrame([(g, r, T0, 1) for g, r in members], "group_id long, row_id long, added_at timestamp, trust int")
    c = spark.createDataFrame(
        [(r, f, t, *[v.get(x) for x in FIELDS], "extra") for r, f, t, v in contacts],
        "row_id long, source_file string, updated_at timestamp, " + ", ".join(f"{x} string" for x in FIELDS) + ", value string",
    )
    f = spark.createDataFrame(files, "source_file string, trust int")
    return candidates(m, c, f)


def test_order_of_reasons(spark):
    contacts = [
        (1, "low", T0 + timedelta(9), {"first_name": "a", "photo": "p1"}),
        (2, "high", None, {"first_name": "b", "last_name": "N/A"}),
        (3, "high", T0, {"first_name": "c", "last_name": "(none)"}),
        (4, "high", T0, {"first_name": "d", "photo": " - "}),
        (5, "none", T0 + timedelta(99), {"first_name": "e", "photo": "p5"}),
        (6, "lost", None, {"organization_name": "x"}),
        (7, "low", None, {}),
    ]
    files = [("low", 1), ("high", 5), ("none", None)]
    c = frames(spark, [(1, i) for i in (1, 2, 3, 4, 5, 5, 6)] + [(2, 7), (3, 99), (None, 1)], contacts, files)
    assert rows(surviving_values(c)) == sorted([(1, "first_name", 3), (1, "photo", 1), (1, "organization_name", 6)], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_against_sorting(spark, seed):
    r = random.Random(seed)
    contacts = [
        (i, r.choice("abc"), r.choice([None, T0, T0 + timedelta(r.randint(0, 3))]), {f: r.choice([None, "", "n/a", "Unknown", "x", "Y z", "?"]) for f in FIELDS})
        for i in range(1, 120)
    ]
    files = [("a", 1), ("b", None), ("c", 3)]
    members = [(r.randint(1, 6), i) for i in range(1, 120)]
    trust, by_row = dict(files), {c[0]: c for c in contacts}
    best = {}
    for g, i in members:
        _, f, t, v = by_row[i]
        for x in FIELDS:
            if v[x] in ("x", "Y z"):
                k = (trust[f] or 0, t or datetime.min, -i)
                if (g, x) not in best or k > best[g, x]:
                    best[g, x] = k
    assert rows(surviving_values(frames(spark, members, contacts, files))) == sorted(((g, x, -k[2]) for (g, x), k in best.items()), key=repr)


def test_learned_precedence(spark):
    # capitals give way to mixed case in three groups, the other way round in one
    contacts, members = [], []
    for g, (first, then) in enumerate([("ANA", "Ana"), ("EVA", "Eva"), ("LUZ", "Luz"), ("Sol", "SOL")], 1):
        for k, v in enumerate((first, then)):
            contacts.append((10 * g + k, "f", T0 + timedelta(k), {"first_name": v}))
            members.append((g, 10 * g + k))
    contacts += [(91, "f", T0, {"first_name": "IDA"}), (92, "f", None, {"first_name": "Ida"}), (93, "f", None, {"first_name": "ida"})]
    members += [(9, 91), (9, 92), (9, 93)]
    contacts += [(81, "f", T0, {"first_name": "Pia"}), (82, "f", None, {"first_name": "PIA"})]
    members += [(8, 81), (8, 82)]
    c = frames(spark, members, contacts, [("f", 1)])
    assert learn_precedence(c) == {"first_name": {(1, 0)}}
    got = {g: r for g, _, r in rows(surviving_values(c, "learned"))}
    assert got[9] == 92 and got[8] == 81 and got[1] == 11
    assert {g: r for g, _, r in rows(surviving_values(c))}[9] == 91


def test_latest_of_rings_and_untimed():
    node = lambda form, row, at=None, trust=1: {"trust": trust, "form": form, "at": at, "row": row}
    ring = {(0, 1), (1, 2), (2, 0)}
    assert latest([node(0, 5), node(1, 4), node(2, 3)], ring) == 3
    assert latest([node(0, 5), node(1, 9)], {(0, 1)}) == 9
    assert latest([node(0, 5), node(0, 4)], None) == 4
    assert latest([node(0, 5, 7), node(0, 4, 7), node(0, 1, 9, 0)], None) == 4


def test_forms_and_empty(spark):
    df = spark.createDataFrame([("ABC",), ("abc",), ("A-b",), ("Á",), ("1",), (None,)], "v string")
    assert [r[0] for r in df.select(value_form(df.v)).collect()] == [1, 2, 4, 9, 3, 3]
    c = frames(spark, [], [], [])
    assert rows(surviving_values(c)) == [] and rows(surviving_values(c, "learned")) == []
    with pytest.raises(ValueError):
        surviving_values(c, "newest")
