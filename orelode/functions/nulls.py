"""NULL-like text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value, in lower case.
NULL_TEXTS = ("", "null", "none", "нет", "не указано", "н/д")
EDGE = r"(?U)^\s+|\s+$"


def is_null_like(text: Column) -> Column:
    """True for NULL and for texts that stand for it, in any case and with any blanks around."""
    return text.isNull() | F.lower(F.regexp_replace(text, EDGE, "")).isin(*NULL_TEXTS)


def null_folded(text: Column) -> Column:
    return F.when(~is_null_like(text), text)
