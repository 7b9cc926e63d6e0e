"""Cells that hold several values: delimiter skeletons, one splitting rule per distinct skeleton.

A cell is cut into tokens: runs of separators, quotes, bullets, blanks, and runs of ordinary text. Its skeleton
has one letter per token, so ordinary text is masked, and so are the separators' kinds, their number and the
blanks around them. Rules (which tokens form which value) are worked out once per distinct skeleton and field,
joined to the cells and applied by token position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .skew import hot_limit, spread_join

#: Rules up to this measured size are broadcast; beyond it they are joined by skeleton.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    """How a field packs values: patterns of what always separates and of what does so between white space, and
    whether list bullets before a value are dropped."""

    separators: str
    spaced: str
    bullets: bool = False


LABELS = Rule(":::|[;|,]", "/")
NOTES = Rule(":::|[;|]", "//", True)

# Skeleton letters: x separators, n line breaks only, s blanks, q quote, b bullet, a anything else.
_SPACE = r"[\s\p{Z}\x{85}\x1C-\x1F]"
_BLANK = r"[\s\p{Z}\x{85}\x1C-\x1F&&[^\r\n]]"
_FREE_BULLETS, _DASH_BULLETS = "•‣◦▪●·", "*–-"


def _token_pattern(rule: Rule) -> str:
    """One token of a cell. Separators run on over blanks and each other; ordinary text runs on over blanks and
    bullets, since these mean something only at the start of a value.

    Loops are possessive: java.util.regex runs these in place, but calls itself once per turn of any other loop
    over a group, which overflows the stack on long text. No match changes, as nothing after them can fail."""
    spaced = f"(?<={_SPACE}){rule.spaced}(?={_SPACE})"
    separator = rf"(?:{rule.separators}|[\r\n]|{spaced})"
    comma = "," if "," in rule.separators else ""
    bullet = rf"[{_FREE_BULLETS}]|[*–\-](?={_BLANK})" if rule.bullets else ""
    special = rf"{_FREE_BULLETS}*–\-" if rule.bullets else ""
    kinds = [rf"[^\s\p{{Z}}\x{{85}}\x1C-\x1F\";|:/{comma}{special}]", ":(?!::)", f"(?!{spaced})/"]
    if rule.bullets:
        kinds.append(rf"[*–\-](?!{_BLANK})")
    plain = f"(?:{'|'.join(kinds)})"
    inner = f"(?:{_BLANK}|{bullet})" if bullet else _BLANK
    tokens = [rf"{_BLANK}*+(?:{separator}{_BLANK}*+)++", *([bullet] if bullet else []), f"{_BLANK}++", f"{plain}++(?:{inner}*+{plain}++)*+", "."]
    return "(?s)" + "|".join(tokens)


def _letters(rule: Rule) -> Column:
    """The skeleton of the column ``tokens``. A token's first character tells its kind: only separators may begin with a
    blank and hold more, and a dash is a bullet only before a blank."""

    def letter(t: Column, i: Column) -> Column:
        first = F.substring(t, 1, 1)
        spaced = F.when(t.rlike(f"[^{_SPACE[1:]}"), "x").when(t.rlike(r"[\r\n]"), "n").otherwise("s")
        out = F.when(first == '"', "q").when(first.isin(";", "|", *([","] if "," in rule.separators else [])) | t.startswith(":::"), "x").when(first.rlike(_SPACE), spaced)
        if rule.bullets:
            before_blank = F.coalesce(F.get("tokens", i + 1), F.lit("")).rlike(f"^{_BLANK}")
            out = out.when(t.isin(*_FREE_BULLETS) | (t.isin(*_DASH_BULLETS) & before_blank), "b")
        return out.otherwise("a")

    return F.array_join(F.transform("tokens", letter), "")


def resolve_skeleton(rule: Rule, k: str) -> list[tuple[int, int, bool]]:
    """(first token, number of tokens, quoted) of each value of a skeleton, in order; empty ones left out."""
    n, out = len(k), []

    def separates(i: int) -> bool:
        return k[i] in "xn"

    def skip(i: int) -> int:
        while i < n and k[i] == "s":
            i += 1
        return i

    i = 0
    while i < n:
        i = skip(i)
        while rule.bullets and i < n and k[i] == "b":
            i = skip(i + 1)
        if i < n and k[i] == "q":
            j = i + 1
            while j < n and (k[j] != "q" or k[j : j + 2] == "qq"):
                j += 2 if k[j] == "q" else 1
            after = skip(j + 1)
            if j < n and (after >= n or separates(after)):
                if k[i + 1 : j].strip("sn"):
                    out.append((i + 1, j - i - 1, True))
                i = after + 1
                continue
        end = i
        while end < n and not separates(end):
            end += 1
        last = end
        while last > i and k[last - 1] == "s":
            last -= 1
        if last > i:
            out.append((i, last - i, False))
        i = end + 1
    return out


def _resolver(rules: dict[str, Rule], least: int):
    """Rules of skeletons that give at least ``least`` values; one number a value: first token, tokens, quoted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [
                (f, k, n, [s << 32 | m << 1 | q for s, m, q in v])
                for f, k, n in zip(*(c.to_pylist() for c in b.columns))
                if len(v := resolve_skeleton(rules[f], k)) >= least
            ]
            cols = list(zip(*found)) if found else [()] * 4
            types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["field", "skeleton", "cells", "rule"])

    return run


def _cell(field: str, rule: Rule, least: int) -> Column:
    """The field's name, tokens and skeleton; null where the cell is null or, without a separator, has too few values."""
    wanted = F.col(field).isNotNull()
    if least > 1:
        wanted = wanted & F.col(field).rlike(rf"{rule.separators}|[\r\n]|{rule.spaced}")
    return F.when(wanted, F.struct(F.lit(field).alias("field"), F.regexp_extract_all(F.col(field), F.lit(_token_pattern(rule)), F.lit(0)).alias("tokens")))


def packed_values(
    df: DataFrame, key: str, rules: dict[str, Rule], least: int = 1, keep: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``key, field_name, values`` (and the columns to ``keep``): the values of each cell as an array.

    Cells with fewer than ``least`` values are left out; null cells always. See ``split_packed``.
    """
    keep = keep or []
    cells = df.select(
        F.col(key).alias("_key"), *keep,
        F.explode(F.array_compact(F.array(*[_cell(f, r, least) for f, r in rules.items()]))).alias("x"),
    )
    letters = F.coalesce(*[F.when(F.col("field") == f, _letters(r)) for f, r in rules.items()])
    shaped = cells.select("_key", *keep, "x.*").withColumn("skeleton", letters)
    counted = shaped.groupBy("field", "skeleton").agg(F.count("*").alias("cells"))
    resolved = cut(counted.mapInArrow(_resolver(rules, least), "field string, skeleton string, cells long, rule array<long>"), "rules")
    # what a row of rules takes in memory: its texts, eight bytes a value, and about 100 for the row
    size, total = resolved.agg(F.sum(F.octet_length("skeleton") + 8 * F.size("rule") + 100), F.sum("cells")).first()
    found = resolved.drop("cells")
    if (size or 0) <= broadcast_bytes:
        joined = shaped.join(F.broadcast(found), ["field", "skeleton"])
    else:
        hot = resolved.filter(F.col("cells") > hot_limit(df.sparkSession, total)).select("field", "skeleton")
        joined = spread_join(shaped, found, ["field", "skeleton"], hot)

    def text(v: Column) -> Column:
        first, n = F.shiftright(v, 32).cast("int"), F.shiftright(v.bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")
        raw = F.array_join(F.slice("tokens", first + 1, n), "")
        return F.when(v.bitwiseAND(F.lit(1)) == 1, F.replace(raw, F.lit('""'), F.lit('"'))).otherwise(raw)

    return joined.select(F.col("_key").alias(key), *keep, F.col("field").alias("field_name"), F.transform("rule", text).alias("values"))


def split_packed(
    df: DataFrame, key: str, rules: dict[str, Rule], least: int = 1, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``key, field_name, item_pos, item_value``: the values of each cell with at least ``least`` of them.

    Double quotes around a whole value protect what is inside, where a doubled quote is one quote; the
    inside is left as it is. Other values lose white space around them and, by rule, bullets before
    them. Empty values are dropped and positions count from 1 over the rest. Null, empty and blank
    cells give nothing; a quote that never closes is ordinary text.
    """
    out = packed_values(df, key, rules, least, None, broadcast_bytes)
    out = out.select(key, "field_name", F.posexplode("values").alias("at", "item_value"))
    return out.select(key, "field_name", (F.col("at") + 1).alias("item_pos"), "item_value")
