"""Null-safe column builders for rules that are stated over values which may be missing, empty or sentinels."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType

NONE = "None"


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def falsy_or(first: Column, second: Column) -> Column:
    """first unless it is null or empty, else second."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def amount(c: Column, unknown: float = -1.0) -> Column:
    """A number, with null, zero and NaN as the sentinel for unknown."""
    return F.coalesce(F.nullif(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(unknown))


def flag(c: Column) -> Column:
    """A boolean that is false when missing."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """Whether any term is a literal part of the lower-cased text; null has none."""
    low = F.lower(text(c))
    return any_of([low.contains(F.lit(t)) for t in terms])


def list_contains_any(c: Column, terms: Sequence[str]) -> Column:
    """Whether any term is a literal part of any lower-cased element; null lists and elements have none."""
    return F.coalesce(F.exists(c, lambda x: contains_any(x, terms)), F.lit(False))


def terms_of(listed: str | Sequence[str]) -> list[str]:
    """Lower-cased, stripped, non-empty terms of a comma list or sequence."""
    parts = listed.split(",") if isinstance(listed, str) else listed
    return [t.strip().lower() for t in parts if t.strip()]


def is_filled(c: Column) -> Column:
    """Whether a text has any character that is not Unicode white space."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def py_str(c: Column, kind: DataType) -> Column:
    """The value as Python's str() writes it: True, None, 1.0, ['a', None]."""
    if isinstance(kind, BooleanType):
        shown = F.when(c, "True").otherwise("False")
    elif isinstance(kind, DoubleType | FloatType):
        d = c.cast("double")
        whole = (F.abs(d) < 1e16) & (d == F.floor(d))
        shown = F.when(F.isnan(d), "nan").when(whole, F.concat(d.cast("decimal(17,0)").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))
    elif isinstance(kind, ArrayType):
        one = lambda x: F.when(x.isNull(), NONE).otherwise(F.concat(F.lit("'"), x.cast("string"), F.lit("'")) if kind.elementType.typeName() == "string" else py_str(x, kind.elementType))
        shown = F.concat(F.lit("["), F.array_join(F.transform(c, one), ", "), F.lit("]"))
    else:
        shown = c.cast("string")
    return F.when(c.isNull(), NONE).otherwise(shown)


def dedup_key(name: Column) -> Column:
    """A name as key: lower case, with null as the word none."""
    return F.lower(F.coalesce(name, F.lit(NONE)))


def haystack(title: Column, alts: Column, skills: Column, sub_function: Column, case_fold: bool = False) -> Column:
    """Title, alternative titles, skills and sub-function in one text; only the first and last are lower-cased unless all shall be."""
    out = F.concat_ws(" ", F.lower(text(title)), alts, skills, F.lower(text(sub_function)))
    return F.lower(out) if case_fold else out


def hits(hay: Column, seeds: Sequence[str]) -> Column:
    """Sorted distinct seeds that the text contains."""
    found = F.filter(F.array(*[F.lit(s) for s in sorted(set(seeds))]), lambda s: hay.contains(s)) if seeds else F.array().cast("array<string>")
    return F.array_sort(found)


def label(company: Column, title: Column) -> Column:
    return F.concat(F.coalesce(company, F.lit(NONE)), F.lit(": "), F.coalesce(title, F.lit(NONE)))


def salary(low: Column, high: Column) -> Column:
    """$min-maxk, a question mark for an unknown maximum, empty for an unknown minimum."""
    whole = lambda c: c.cast("long").cast("string")
    shown = F.concat(F.lit("$"), whole(low), F.lit("-"), F.when(high > 0, whole(high)).otherwise("?"), F.lit("k"))
    return F.when(low > 0, shown).otherwise("")


def fixed(c: Column, width: int) -> Column:
    """Text cut or padded to a width."""
    return F.rpad(F.substring(text(c), 1, width), width, " ")


def compared(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("["), n.cast("string"), F.lit("cmp]"))).otherwise("[imputed]")


def one_decimal(v: Column) -> Column:
    """A number with one digit behind the point as C prints it: from its exact binary value, ties to even."""
    a = F.abs(v)
    part = a % 1.0
    digit = F.floor(part * 10)
    # part * 10 may be rounded; five times part less the tie above the digit, in two differences that are exact near it, is not
    over = (part * 4 - (digit * 2 + 1) / 4.0) + part
    tenths = digit + F.when((over > 0) | ((over == 0) & (digit % 2 == 1)), 1).otherwise(0)
    long = 2.0**63
    whole = F.floor(a / long).cast("decimal(19,0)") * F.lit(Decimal(2**63)) + F.floor(a % long).cast("decimal(19,0)") + F.floor(tenths / 10)
    sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
    finite = F.when(a < long * long / 2, F.concat(whole.cast("string"), F.lit("."), (tenths % 10).cast("string"))).otherwise(F.format_string("%.1f", a))
    return F.concat(sign, F.when(F.isnan(a), "nan").when(a == float("inf"), "inf").when(a.isNotNull(), finite))


def human_size(n: Column, units: Sequence[str] = ("B", "KB", "MB", "GB", "TB")) -> Column:
    """Bytes with one decimal, by 1024, in the first unit of which there are fewer than 1024, or the last; of no number, the last unit alone."""
    n = n.cast("double")
    scale, unit = F.lit(1024.0 ** (len(units) - 1)), F.lit(units[-1])
    for power in range(len(units) - 2, -1, -1):
        small = n < 1024.0 ** (power + 1)
        scale, unit = F.when(small, 1024.0**power).otherwise(scale), F.when(small, units[power]).otherwise(unit)
    return F.concat(F.coalesce(one_decimal(n / scale), F.lit("")), unit)


def verdict(score: Column) -> Column:
    """The band of a fit score."""
    return F.when(score >= 90, "strong").when(score >= 70, "solid").when(score >= 50, "stretch").otherwise("weak")


def unordered(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """A pair in one orientation: least, greatest, and whether it was turned."""
    return F.least(a, b), F.greatest(a, b), a > b
