"""String functions as native columns."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_TOKEN = r"[\p{L}\p{Nd}']+"
WORD = r"[\p{L}\p{Nd}]+"
# White space, the no-break and typographic spaces included; the characters up to U+0020.
BLANK_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CONTROL_CHARS = "".join(map(chr, range(0x21)))


def jtrim(c: Column) -> Column:
    """Strip every character up to U+0020 from both ends; a no-break space stays. Null gives null."""
    return F.btrim(c, F.lit(CONTROL_CHARS))


def trim_blank(c: Column) -> Column:
    """Strip white space of any kind from both ends. Null gives null."""
    return F.btrim(c, F.lit(BLANK_CHARS))


def non_blank(c: Column) -> Column:
    """True where ``jtrim`` leaves something; null and blank are false."""
    return F.coalesce(jtrim(c) != "", F.lit(False))


def says_something(c: Column) -> Column:
    """True where any character is neither white space nor missing."""
    return F.coalesce(trim_blank(c) != "", F.lit(False))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Characters whose decomposition without marks is one other character, and that character."""
    src, dst = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        bare = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x)[0] != "M")
        if len(bare) == 1 and bare != ch:
            src.append(ch)
            dst.append(bare)
    return "".join(src), "".join(dst)


def _split_hangul(c: Column) -> Column:
    """Decompose Hangul syllables by their arithmetic: 19 leads, 21 vowels, 27 optional tails."""
    lead = F.array(*[F.lit(chr(0x1100 + i)) for i in range(19)])
    vowel = F.array(*[F.lit(chr(0x1161 + i)) for i in range(21)])
    tail = F.array(F.lit(""), *[F.lit(chr(0x11A7 + i)) for i in range(1, 28)])

    def one(ch: Column) -> Column:
        n = F.conv(F.hex(F.encode(ch, "UTF-16BE")), 16, 10).cast("int") - F.lit(0xAC00)
        parts = F.concat(
            F.get(lead, (n / 588).cast("int")), F.get(vowel, ((n % 588) / 28).cast("int")), F.get(tail, n % 28)
        )
        return F.when(ch.between("가", "힣"), parts).otherwise(ch)

    return F.array_join(F.transform(F.split(c, ""), one), "")


def strip_accents(c: Column) -> Column:
    """Canonical decomposition without the marks: ``José`` becomes ``Jose``; ``ø`` and ``ß`` stay.

    Null gives null. Hangul syllables come out as their letters, as decomposition has them.
    """
    src, dst = _accent_table()
    # plain text, by far the most, is given back as it is
    return (
        F.when(~c.rlike(r"[^\x00-\x7F]"), c)
        .when(c.rlike("[가-힣]"), F.regexp_replace(F.translate(_split_hangul(c), src, dst), r"\p{M}+", ""))
        .otherwise(F.regexp_replace(F.translate(c, src, dst), r"\p{M}+", ""))
    )


def dedupe_name_tokens(parts: Column, stripped: bool = False) -> Column:
    """Of an array of name parts, keep the first writing of each word over all parts.

    ``stripped`` says that the parts have no accents any more. Words are runs of letters, digits and apostrophes without accents, compared in lower case. Parts
    that keep no word drop out. Null parts count as empty; a null array gives null.
    """
    filled = F.transform(parts, lambda p: F.coalesce(p, F.lit("")))
    words = F.transform(
        filled if stripped else F.transform(filled, strip_accents),
        lambda p, i: F.transform(
            F.regexp_extract_all(p, F.lit(NAME_TOKEN), F.lit(0)),
            lambda w: F.struct(i.alias("part"), w.alias("word"), F.lower(w).alias("low")),
        ),
    )
    flat = F.flatten(words)
    # an array of one struct holds the words' low forms, so that they are gathered once and not for every word
    held = F.array(F.struct(flat.alias("words"), F.transform(flat, lambda w: w["low"]).alias("lows")))
    first = F.flatten(F.transform(held, lambda h: F.filter(h["words"], lambda w, j: F.array_position(h["lows"], w["low"]) == j + 1)))
    parted = F.transform(F.array(first), lambda h: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(parts), F.lit(1)) - 1),
        lambda k: F.array_join(F.transform(F.filter(h, lambda w: w["part"] == k), lambda w: w["word"]), " "),
    ))
    return F.filter(F.flatten(parted), lambda s: s != "")


def words(c: Column) -> Column:
    """The maximal runs of letters and digits, in lower case; accents count. Null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def word_line(c: Column) -> Column:
    """The words joined by single spaces; '' where there are none."""
    return F.array_join(words(c), " ")


def csv_escape(c: Column) -> Column:
    """Quote a cell that holds a comma, quote or line break; double its quotes. Null becomes ''."""
    v = F.coalesce(c, F.lit(""))
    return F.when(v.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
