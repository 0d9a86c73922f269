"""One-step repair of UTF-8 that was read as Windows-1251, for what leaves the engine."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Pairs that Cyrillic letters and common signs become when their UTF-8 is read as Windows-1251.
MARKS = "[РС][\u0402-\u040f\u0451-\u045f\u0490\u0491\u00a0-\u00bf\u2013-\u203a\u20ac\u2116\u2122]|вЂ|Ð|Ñ"
_FOUND = re.compile(MARKS)


def score(text: str) -> int:
    return len(_FOUND.findall(text))


def reread(text: str) -> str | None:
    """What the bytes of a text are as UTF-8, None where they are none."""
    try:
        return text.encode("cp1251").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def repair_text(text: str | None) -> str | None:
    """text read again as it was meant, if that leaves fewer marks of wrong reading; else as it is."""
    fixed = reread(text) if text and score(text) else None
    return fixed if fixed is not None and score(fixed) < score(text) else text


@F.pandas_udf(T.StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repair_text, na_action="ignore").astype(object).where(texts.notna(), None)


def repaired(text: Column | str) -> Column:
    """repair_text of a column; only texts with a mark leave the JVM."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_repaired(F.when(c.rlike(MARKS), c)), c)
