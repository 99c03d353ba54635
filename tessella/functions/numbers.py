"""Numbers, quarters and money as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_ordinal(at: Column) -> Column:
    return F.year(at) * 4 + F.quarter(at)


def quarter_of(text: Column) -> Column:
    """The ordinal (year * 4 + quarter) of a token such as 2025Q4 or 2025-q4; null for others."""
    year, q = (F.regexp_extract(F.trim(text), r"^(\d{4})-?[Qq]([1-4])$", k) for k in (1, 2))
    return F.when(year != "", year.try_cast("int") * 4 + q.try_cast("int"))


def quarter_name(ordinal: Column) -> Column:
    """The token of an ordinal: 8003 is 2000Q3, 8004 is 2000Q4."""
    return F.concat(F.floor((ordinal - 1) / 4).cast("string"), F.lit("Q"), ((ordinal - 1) % 4 + 1).cast("string"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where either is null or b is 0."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def cagr(end: Column, start: Column, years: int) -> Column:
    """Yearly growth; null unless both values are above 0."""
    return F.when((start > 0) & (end > 0), F.pow(end.cast("double") / start.cast("double"), F.lit(1.0 / years)) - 1)


def trend(now: Column, prev: Column, flat: float = 0.03) -> Column:
    """up, down or flat: within 3 % of what was before."""
    band = F.abs(prev) * flat
    return F.when(now.isNull() | prev.isNull(), None).when(now - prev > band, "up").when(prev - now > band, "down").otherwise("flat")


def compact(n: Column) -> Column:
    """K, M or B with one place."""
    a = F.abs(n)
    scaled = lambda d, unit: F.concat(F.format_string("%.1f", F.round(n.cast("double") / d, 1)), F.lit(unit))
    return F.when(a >= 1e9, scaled(1e9, "B")).when(a >= 1e6, scaled(1e6, "M")).when(a >= 1e3, scaled(1e3, "K")).otherwise(n.cast("long").cast("string"))


def yi(n: Column) -> Column:
    """In units of 10**8: none, one or two places for values of 1000, 10 or less at least."""
    v = n.cast("double") / 1e8
    text = F.when(F.abs(v) >= 1000, F.format_string("%.0f", F.round(v, 0))).when(F.abs(v) >= 10, F.format_string("%.1f", F.round(v, 1))).otherwise(F.format_string("%.2f", F.round(v, 2)))
    return F.concat(text, F.lit("亿"))


def signed_pct(n: Column) -> Column:
    v = F.format_string("%.2f", F.round(n, 2))
    return F.concat(F.when(n > 0, F.concat(F.lit("+"), v)).otherwise(v), F.lit("%"))


def price(value: Column, shares: Column) -> Column:
    """value / shares in two places, half up; null without shares."""
    return F.when(shares > 0, F.floor(value * 100 / shares + 0.5) / 100)


def assets_in_yi(text: Column) -> Column:
    """Amounts such as $294B or 12.5M in units of 10**8; null for others."""
    number = F.regexp_extract(text, r"^\$?([0-9.]+)\s*([TBM])", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^\$?([0-9.]+)\s*([TBM])", 2)
    return number * F.when(unit == "T", 10000.0).when(unit == "B", 10.0).when(unit == "M", 0.01)


def inline_number(text: Column, sign: Column, scale: Column) -> Column:
    """A number as documents write it: tags, spaces and separators go, parentheses or the sign make it negative, the
    scale is a power of ten; a dash or no number is null."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), "&nbsp;|&#160;| ", " "))
    negative = plain.rlike(r"^\(.*\)$") | F.coalesce(sign == "-", F.lit(False))
    digits = F.regexp_replace(plain, r"[(),$\s]", "")
    value = F.when(digits.rlike(r"^\d+(\.\d+)?$"), digits.try_cast("double"))
    return F.when(negative, -value).otherwise(value) * F.pow(F.lit(10.0), F.coalesce(scale.cast("int"), F.lit(0)))
