"""Phone cells: tokens, rules by precedence, keys and rendering as native columns; ``parse_field`` for single texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CONTROL_CHARS, jtrim

# What the results show for each rule, in the order of the rules.
NO_DIGITS = "No digits found in token"
MX_TOO_SHORT = "MX (+52) number too short: "
PLUS_TOO_SHORT = "Plus-prefixed number too short: "
WRONG_LENGTH = "Unrecognized digit length: "
ZEROS_CATEGORY = ("INTL_00_PREFIX(", ")")
SHORT_CATEGORY = "SHORT_CODE_LEN"
VERY_SHORT_CATEGORY = "VERY_SHORT_CODE_LEN"

PHONE_FIELDS = ["raw", "cleaned_display", "canonical_key", "key_type", "country", "category", "confidence", "warning"]

# The no-break space and the dashes that cleaning folds, and what they become.
FOLD_FROM = "\u00a0\u2010\u2011\u2012\u2013\u2014"
FOLD_TO = " -----"


def phone_tokens(cell: Column) -> Column:
    """Tokens of a phone cell, split at three colons; null and blank cells give an empty array."""
    parts = F.split(jtrim(F.coalesce(cell, F.lit(""))), r"\s*:::\s*")
    return F.filter(F.transform(parts, jtrim), lambda t: t != "")


def _rule(t: Column) -> Column:
    """Which rule a token falls under; ``intl`` holds the digits that the international rules read."""
    d, n, intl, m = t["digits"], F.length(t["digits"]), t["intl"], F.length(t["intl"])
    mexican = intl.startswith("52")
    national = F.when((m == 13) & (F.substring(intl, 3, 1) == "1"), m - 3).otherwise(m - 2)
    international = (
        F.when(mexican & (national >= 10), F.lit("E164_MX"))
        .when(mexican, F.lit("MX_SHORT"))
        .when(intl.startswith("1") & (m == 11), F.lit("E164_US"))
        .when(m >= 8, F.lit("E164_OTHER_COUNTRY"))
        .otherwise(F.lit("PLUS_SHORT"))
    )
    return (
        F.when(n == 0, F.lit("EMPTY"))
        .when(intl.isNotNull(), international)
        .when(d.startswith("01") & (n >= 12), F.lit("MX_TOLLFREE_01"))
        .when(n == 10, F.lit("BARE_10"))
        .when((n == 11) & d.startswith("1"), F.lit("BARE_11_LEADING1"))
        .when((n == 12) & d.startswith("52"), F.lit("BARE_12_COUNTRY52"))
        .when((n == 13) & d.startswith("521"), F.lit("BARE_13_COUNTRY521"))
        .when(n.between(5, 9), F.lit("SHORT"))
        .when(n < 5, F.lit("VERY_SHORT"))
        .otherwise(F.lit("LENGTH"))
    )


def _record(t: Column) -> Column:
    """The phone struct of a token with its rule."""
    rule, d, intl, shown = t["rule"], t["digits"], t["intl"], t["cleaned"]
    n = F.length(d).cast("string")
    wrong = rule.isin("EMPTY", "MX_SHORT", "PLUS_SHORT", "LENGTH")
    short = rule.isin("SHORT", "VERY_SHORT")
    other = rule == "E164_OTHER_COUNTRY"
    key = (
        F.when(wrong, F.lit(None).cast("string"))
        .when(short, shown)
        .when(other, F.concat(F.lit("+"), intl))
        .when(rule.startswith("E164"), F.right(intl, F.lit(10)))
        .otherwise(F.right(d, F.lit(10)))
    )
    kind = (
        F.when(wrong, F.lit(None).cast("string"))
        .when(short, F.lit("RAW_SHORT"))
        .when(other, F.lit("E164_FULL"))
        .otherwise(F.lit("TEN_DIGIT"))
    )
    country = (
        F.when(wrong, F.lit(None).cast("string"))
        .when(short | (rule == "BARE_10"), F.lit("UNKNOWN"))
        .when(rule.isin("E164_US", "BARE_11_LEADING1"), F.lit("US"))
        .when(other, F.lit("OTHER"))
        .otherwise(F.lit("MX"))
    )
    plain = (
        F.when(wrong, F.lit("ANOMALY"))
        .when(rule == "SHORT", F.concat(F.lit(SHORT_CATEGORY), n))
        .when(rule == "VERY_SHORT", F.concat(F.lit(VERY_SHORT_CATEGORY), n))
        .otherwise(rule)
    )
    category = F.when(t["zeros"], F.concat(F.lit(ZEROS_CATEGORY[0]), plain, F.lit(ZEROS_CATEGORY[1]))).otherwise(plain)
    confidence = (
        F.when(wrong | short, F.lit("LOW")).when(rule.startswith("E164"), F.lit("HIGH")).otherwise(F.lit("MEDIUM"))
    )
    warning = (
        F.when(rule == "EMPTY", F.lit(NO_DIGITS))
        .when(rule == "MX_SHORT", F.concat(F.lit(MX_TOO_SHORT), intl))
        .when(rule == "PLUS_SHORT", F.concat(F.lit(PLUS_TOO_SHORT), intl))
        .when(rule == "LENGTH", F.concat(F.lit(WRONG_LENGTH), n))
    )
    values = [t["raw"], shown, key, kind, country, category, confidence, warning]
    return F.struct(*[v.alias(k) for k, v in zip(PHONE_FIELDS, values)])


def parse_phones(cell: Column) -> Column:
    """``array<struct>`` of the parsed tokens of a cell, anomalies (null ``key_type``) included.

    Each step is a ``transform`` of its own, so digits and rule are worked out once per token.
    Null and blank cells give an empty array.
    """
    cleaned = F.transform(
        phone_tokens(cell), lambda t: F.struct(t.alias("raw"), jtrim(F.translate(t, FOLD_FROM, FOLD_TO)).alias("cleaned"))
    )
    digits = F.transform(
        cleaned,
        lambda t: F.struct(t["raw"].alias("raw"), t["cleaned"].alias("cleaned"), F.regexp_replace(t["cleaned"], "[^0-9]", "").alias("digits")),
    )

    def routed(t: Column) -> Column:
        plus = t["cleaned"].startswith("+")
        zeros = ~plus & t["digits"].startswith("00") & (F.length(t["digits"]) >= 10)
        intl = F.when(plus, t["digits"]).when(zeros, F.substr(t["digits"], F.lit(3)))
        return F.struct(t["raw"].alias("raw"), t["cleaned"].alias("cleaned"), t["digits"].alias("digits"), zeros.alias("zeros"), intl.alias("intl"))

    ruled = F.transform(
        F.transform(digits, routed),
        lambda t: F.struct(*[t[k].alias(k) for k in ("raw", "cleaned", "digits", "zeros", "intl")], _rule(t).alias("rule")),
    )
    return F.transform(ruled, _record)


def identity_key(key_type: Column, canonical_key: Column) -> Column:
    """What makes two phones the same person; the country has no say."""
    return F.concat(key_type, F.lit("::"), canonical_key)


def render_phone(key_type: Column, country: Column, key: Column) -> Column:
    """The value written out: the country code before ten-digit numbers of a known country."""
    ten = key_type == "TEN_DIGIT"
    return (
        F.when(ten & (country == "MX"), F.concat(F.lit("+52"), key))
        .when(ten & (country == "US"), F.concat(F.lit("+1"), key))
        .otherwise(key)
    )


@dataclass(frozen=True)
class Phone:
    """A token of a phone cell; ``key_type`` and ``canonical_key`` are None where no number can be made of it."""

    raw: str
    cleaned_display: str
    canonical_key: str | None
    key_type: str | None
    country: str | None
    category: str
    confidence: str
    warning: str | None


_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


def _national(d: str) -> dict:
    """Key, country, category and confidence of digits without a country prefix."""
    n = len(d)
    if n >= 12 and d.startswith("01"):
        kind = ("MX", "MX_TOLLFREE_01")
    elif n == 10:
        kind = ("UNKNOWN", "BARE_10")
    else:
        kind = {(11, "1"): ("US", "BARE_11_LEADING1"), (12, "52"): ("MX", "BARE_12_COUNTRY52"), (13, "521"): ("MX", "BARE_13_COUNTRY521")}.get((n, d[: max(n - 10, 0)]))
    if kind:
        return {"canonical_key": d[-10:], "key_type": "TEN_DIGIT", "country": kind[0], "category": kind[1], "confidence": "MEDIUM"}
    if n <= 9:
        return {"key_type": "RAW_SHORT", "country": "UNKNOWN", "category": f"{SHORT_CATEGORY if n > 4 else VERY_SHORT_CATEGORY}{n}", "confidence": "LOW"}
    return {"warning": f"{WRONG_LENGTH}{n}"}


def _international(d: str) -> dict:
    """The same for digits after a plus sign or two zeros."""
    if d.startswith("52"):
        rest = d[3:] if len(d) == 13 and d[2] == "1" else d[2:]
        found = {"canonical_key": d[-10:], "key_type": "TEN_DIGIT", "country": "MX", "category": "E164_MX", "confidence": "HIGH"}
        return found if len(rest) >= 10 else {"warning": MX_TOO_SHORT + d}
    if len(d) == 11 and d[0] == "1":
        return {"canonical_key": d[1:], "key_type": "TEN_DIGIT", "country": "US", "category": "E164_US", "confidence": "HIGH"}
    if len(d) >= 8:
        return {"canonical_key": "+" + d, "key_type": "E164_FULL", "country": "OTHER", "category": "E164_OTHER_COUNTRY", "confidence": "HIGH"}
    return {"warning": PLUS_TOO_SHORT + d}


def parse_field(cell: str | None) -> tuple[list[Phone], list[Phone]]:
    """(usable phones, rejected tokens) of one cell, each in order; the same rules as ``parse_phones``.

    For single texts outside a table. None and blank cells give two empty lists.
    """
    usable: list[Phone] = []
    rejected: list[Phone] = []
    for raw in filter(None, (t.strip(CONTROL_CHARS) for t in (cell or "").split(":::"))):
        shown = raw.translate(_FOLD).strip(CONTROL_CHARS)
        d = "".join(ch for ch in shown if ch in "0123456789")
        zeros = False
        if not d:
            found = {"warning": NO_DIGITS}
        elif shown.startswith("+"):
            found = _international(d)
        elif zeros := d.startswith("00") and len(d) >= 10:
            found = _international(d[2:])
        else:
            found = _national(d)
        full = {"canonical_key": shown if found.get("key_type") == "RAW_SHORT" else None, "key_type": None, "country": None, "category": "ANOMALY", "confidence": "LOW", "warning": None} | found
        if zeros:
            full["category"] = full["category"].join(ZEROS_CATEGORY)
        phone = Phone(raw, shown, **full)
        (rejected if phone.key_type is None else usable).append(phone)
    return usable, rejected
