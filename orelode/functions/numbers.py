"""Numbers and intervals in free text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[+-]?\d+(?:[ \u00a0\u202f]\d{3})*(?:[.,]\d+)?"


def to_double(text: Column) -> Column:
    """Decimal comma or point, blanks between thousands; NULL if it is no number."""
    return F.replace(F.regexp_replace(text, r"[ \u00a0\u202f]", ""), F.lit(","), F.lit(".")).try_cast("double")


def interval(text: Column) -> Column:
    """STRUCT<lo, hi, tail>: a number, a range ``a-b``, or ``a±b``, after words without digits; tail is what follows."""
    pattern = rf"^\D*?({NUMBER})(?:\s*(±|\+/-|…|\.\.\.?|[–—-])\s*({NUMBER}))?(?U:\s*)(.*)$"
    a = to_double(F.regexp_extract(text, pattern, 1))
    sign = F.regexp_extract(text, pattern, 2)
    b = to_double(F.regexp_extract(text, pattern, 3))
    plus_minus = sign.isin("±", "+/-")
    lo = F.when(sign == "", a).when(plus_minus, a - b).otherwise(F.least(a, b))
    hi = F.when(sign == "", a).when(plus_minus, a + b).otherwise(F.greatest(a, b))
    return F.struct(lo.alias("lo"), hi.alias("hi"), F.regexp_extract(text, pattern, 1).alias("first"), F.regexp_extract(text, pattern, 4).alias("tail"))


def decimals(text: Column) -> Column:
    """ARRAY of every signed decimal of the text, as the fact search reads ranges; NULL for NULL.

    Decimal comma becomes a point, dashes become ``-``, ``~`` a blank, and a dash between digits separates.
    """
    t = F.translate(text, ",–—−~∼", ".---  ")
    t = F.regexp_replace(t, r"(?<=\d)\s*-\s*(?=\d)", " ")
    return F.transform(F.regexp_extract_all(t, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))


def bounds(found: Column) -> Column:
    """STRUCT<lo, hi> of the decimals found in a text, NULL without any."""
    return F.when(F.size(found) > 0, F.struct(F.array_min(found).alias("lo"), F.array_max(found).alias("hi")))


def number_range(text: Column) -> Column:
    """STRUCT<lo, hi> over every decimal of the text; ``1 000`` is (0, 1) and ``10^-3`` is (-3, 10). NULL without a number."""
    return bounds(decimals(text))
