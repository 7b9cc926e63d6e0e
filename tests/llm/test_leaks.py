import random
import re

import pytest

from helpers import rows
from kontorium.llm import leaks
from kontorium.llm.leaks import leaked_items, near_items

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id int"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, run):
    out = set()
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for k, x in items:
            v = words(x)
            if any(tuple(v[i : i + run]) in grams for i in range(len(v) - run + 1)):
                out.add((k, d))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS)


@pytest.mark.parametrize("seed, run", [(0, 12), (1, 3), (2, 5)])
def test_against_brute_force(spark, seed, run, monkeypatch):
    monkeypatch.setattr(leaks, "SHARD_BYTES", 2000)
    r = random.Random(seed)
    vocabulary = ["der", "THE", "the", "of", "x1", "é", "É", "valve", "a", "b", "12"] + [f"w{i}" for i in range(30)]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "-", "_"]) for _ in range(n))
    items = [(i, text(r.randint(0, 30))) for i in range(25)] + [(90, None), (91, ""), (92, " , ")]
    docs = []
    for i in range(120):
        t = text(r.randint(0, 60))
        if r.random() < 0.4:
            w = words(r.choice(items)[1])
            lo = r.randint(0, len(w))
            t += " | ".join(w[lo : lo + run + r.randint(-1, 3)]) + " " + text(5)
        docs.append((i, t))
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    d, i = frames(spark, docs, items)
    want = brute(docs, items, run)
    assert rows(leaked_items(d, i, run)) == want
    assert rows(leaked_items(d.repartition(3), i, run, pass_words=40)) == want


def test_starts_ends_and_repeats(spark):
    w = [f"w{i}" for i in range(12)]
    item = " ".join(w)
    docs = [(1, item), (2, item.upper() + "!"), (3, "x " + item), (4, " ".join(w[:11])), (5, "w0 " * 40 + item), (6, " ".join(w[:6] + ["z"] + w[6:])), (7, item[:-1])]
    d, i = frames(spark, docs, [(1, item), (2, item), (3, "w0 " * 13)])
    assert rows(leaked_items(d, i)) == sorted([(k, x) for k in (1, 2) for x in (1, 2, 3, 5)] + [(3, 5)], key=repr)


def test_near(spark):
    w = [f"w{i}" for i in range(30)]
    docs = [(1, " ".join(w)), (2, " ".join(w[:5] + ["z"] + w[6:14])), (3, " ".join(w[:6] + ["z"] + w[6:13])), (4, " ".join(w[:9])), (5, " ".join(reversed(w)))]
    d, i = frames(spark, docs, [(1, " ".join(w))])
    assert rows(near_items(d, i)) == [(1, 1), (1, 2), (1, 3)]
    assert rows(leaked_items(d, i)) == [(1, 1)]


def test_texts_without_words(spark):
    d, i = frames(spark, [(1, ""), (2, None), (3, " , ")], [(1, "b c d"), (2, " ")])
    assert rows(leaked_items(d, i, 3)) == [] and rows(near_items(d, i)) == []
    with pytest.raises(ValueError):
        leaked_items(d, i, leaks.GAP + 1)


def test_near_against_planted_alterations(spark, sf):
    """Passages of the table's own items with words changed, added or left out, put into its own texts."""
    r = random.Random(4)
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    pool = [w for _, t in docs for w in words(t)]
    long = [(k, words(t)) for k, t in items if len(words(t)) >= 16]
    planted = set()
    for n in range(0, len(docs), 2):
        k, w = r.choice(long)
        size = r.randint(14, min(26, len(w)))
        lo = r.randint(0, len(w) - size)
        p = w[lo : lo + size]
        for _ in range(1 if size < 20 else 2):
            at, how = r.randrange(1, len(p) - 1), r.choice("cad")
            p = p[:at] + ([] if how == "d" else [r.choice(pool)]) + p[at + (how != "a") :]
        doc, t = docs[n]
        docs[n] = (doc, f"{t} {' '.join(p)}.")
        planted.add((k, doc))
    d, i = frames(spark, docs, items)
    index = leaks.build_index(d)
    exact = {tuple(x) for x in leaked_items(d, i, index=index).collect()}
    near = {tuple(x) for x in near_items(d, i, index=index).collect()}
    assert len(near & planted) >= 0.9 * len(planted) and len(near & (planted | exact)) >= 0.7 * len(near)


def test_empty_and_long(spark):
    d, i = frames(spark, [(1, "a " * 300_000 + "b c d e")], [(1, "b c d"), (2, "a a a")])
    assert rows(leaked_items(d, i, 3)) == [(1, 1), (2, 1)]
    assert rows(leaked_items(d.limit(0), i, 3)) == [] and rows(leaked_items(d, i.limit(0), 3)) == []
    assert rows(near_items(d.limit(0), i)) == []
