"""String functions of the fact engine as column expressions.

Patterns avoid lookaround where SQL engines with linear-time patterns are to give the same results. WS is every Unicode
white space, as the default class of Java leaves some of it out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from orelode.functions.nulls import NULL_TEXTS

WS = r"[\s\x0B\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LETTERS = "A-Za-zА-Яа-яЁё"
ODD_SPACE = r"[\x09-\x0D\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|  "

# Endings that the light stemmer takes off, the longest first; the first that fits counts.
STEM_ENDINGS = (
    "иями", "ями", "ами", "ией", "иям", "ием", "иях", "ого", "его", "ому", "ему", "ыми", "ими",
    "ая", "яя", "ое", "ее", "ие", "ые", "ой", "ий", "ый", "ов", "ев", "ам", "ям", "ах", "ях", "ия", "ии", "ию",
)
# Markers of domestic and of foreign places and authors, the defaults of the place lexicon.
DOMESTIC = (
    "россия", "рф", "россий", "кольская", "кгмк", "норильск", "норникель", "гипроникель", "мончегорск", "мурманск", "печенг", "красноярск", "забайкаль", "магнитогорск",
)
FOREIGN = (
    "австрали", "англи", "африк", "германи", "грузи", "канада", "квебек", "китай", "нидерланд", "норвеги", "серби", "сша", "финлянди", "чили", "юар", "япони",
    "anglo", "beatrix", "garson", "glencore", "lonmin", "mitsubishi", "nikkelverk", "niihama", "outotec", "paques", "raglan", "rtb bor", "totten", "waterval",
)


def collapse_spaces(text: Column) -> Column:
    """White space of any kind to one blank, none at the ends; NULL stays NULL.

    Most texts hold single blanks only; the replacement runs where there is something else.
    """
    return F.trim(F.when(text.rlike(ODD_SPACE), F.regexp_replace(text, WS + "+", " ")).otherwise(text))


def clean_value(text: Column) -> Column:
    """Collapsed text; NULL for texts that stand for a missing value."""
    t = collapse_spaces(text)
    return F.when(~F.lower(t).isin(*NULL_TEXTS), t)


def doc_clean(text: Column) -> Column:
    """NUL dropped, blanks and tabs collapsed, three or more line ends to two, trimmed."""
    t = F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("")), r"[ \t\xA0]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), rf"^{WS}+|{WS}+$", "")


def paragraphs(text: Column) -> Column:
    """ARRAY of the trimmed parts between blank lines, without empty ones."""
    parts = F.transform(F.split(text, rf"\n{WS}*\n"), lambda p: F.regexp_replace(p, rf"^{WS}+|{WS}+$", ""))
    return F.filter(parts, lambda p: p != "")


def split_words(text: Column) -> Column:
    """ARRAY of the lower-case words of at least two characters; ``_+-`` inside a word count, at its ends they don't."""
    found = F.regexp_extract_all(text, F.lit(f"([{LETTERS}0-9_+-]+)"), 1)
    return F.filter(F.transform(found, lambda w: F.regexp_replace(F.lower(w), r"^[_+-]+|[_+-]+$", "")), lambda w: F.length(w) >= 2)


def stem(word: Column) -> Column:
    """word without the first fitting ending of STEM_ENDINGS, if four letters are left; else word."""
    cases = [F.when(word.endswith(e), F.when(F.length(word) - len(e) >= 4, F.left(word, F.length(word) - len(e))).otherwise(word)) for e in STEM_ENDINGS]
    return F.coalesce(*cases, word)


def stem_literal(word: str) -> str:
    """The same for a word of a query, on the driver."""
    ending = next((e for e in STEM_ENDINGS if word.endswith(e)), "")
    return word[: -len(ending)] if ending and len(word) - len(ending) >= 4 else word


def safe_name(name: Column, limit: int = 120) -> Column:
    """name with everything but letters and digits as ``_``, at most limit characters; NULL if nothing is left."""
    return F.nullif(F.left(F.regexp_replace(name, r"[^\p{L}\p{N}]", "_"), F.lit(limit)), F.lit(""))


def strip_fences(text: Column) -> Column:
    """What stands in the first fenced block, without the word json at its start; the trimmed text without fences."""
    parts = F.split(text, "```")
    inner = F.when(F.size(parts) >= 3, F.regexp_replace(F.get(parts, F.lit(1)), r"^json", "")).otherwise(text)
    return F.regexp_replace(inner, rf"^{WS}+|{WS}+$", "")


def category(source_file: Column) -> Column:
    """What stands before the first ``__`` of a file name, NULL without one."""
    return F.when(source_file.contains("__"), F.substring_index(source_file, "__", 1))


def year(text: Column) -> Column:
    """The first year of 1800 to 2099 in text as INT; digits right beside don't make it another number."""
    return F.regexp_extract(text, r"(?:^|[^0-9A-Za-zА-Яа-яЁё_])((?:18|19|20)[0-9]{2})(?:[^0-9A-Za-zА-Яа-яЁё_]|$)", 1).try_cast("int")


def year_text(text: Column) -> Column:
    """The first year of text, or text as it is where it holds none."""
    return F.coalesce(year(text).cast("string"), text)


def document_context(text: Column, limit: int = 500) -> Column:
    """The beginning of a cleaned text, which goes with each of its chunks to the extraction."""
    return F.left(doc_clean(text), F.lit(limit))


def base_variant(name: Column) -> tuple[Column, Column]:
    """(last word, the words before it, NULL if there are none) of a name without its bracketed parts."""
    plain = collapse_spaces(F.regexp_replace(name, r"\([^()]*\)", " "))
    words = F.split(plain, " ")
    n = F.size(words)
    return F.element_at(words, -1), F.nullif(F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), " "), F.lit(""))


def paren_alias(name: Column) -> tuple[Column, Column]:
    """(base, alias) of ``base (alias)``; (name, NULL) if the base is a single letter or a short Latin token, or there is none."""
    pattern = r"^(.*[^ (]) *\(([^()]+)\)$"
    base, alias = F.regexp_extract(name, pattern, 1), F.trim(F.regexp_extract(name, pattern, 2))
    short = (F.length(base) < 4) & base.rlike("^[A-Za-z0-9+-]*[A-Za-z][A-Za-z0-9+-]*$")
    use = (F.length(base) >= 2) & ~short & (alias != "")
    return F.when(use, base).otherwise(name), F.when(use, alias)


def geo_scope(place: Column, author: Column, domestic: tuple[str, ...] = DOMESTIC, foreign: tuple[str, ...] = FOREIGN) -> Column:
    """domestic, foreign, mixed or unknown, by the markers that place and author hold."""
    t = F.lower(F.concat_ws(" ", place, author))
    has = lambda markers: t.rlike("|".join(map(re.escape, markers)))
    home, away = has(domestic), has(foreign)
    return F.when(home & away, "mixed").when(home, "domestic").when(away, "foreign").otherwise("unknown")


def split_experts(text: Column) -> Column:
    """ARRAY of the names between ``;`` and ``,`` and the word и (not in «и др»), without missing and repeated ones.

    The first spelling of names that are equal but for case is kept; a comma divides before initials too.
    """
    t = F.replace(text, F.lit(" и др"), F.lit("\u0001др"))
    t = F.replace(F.replace(t, F.lit(" и "), F.lit(";")), F.lit("\u0001др"), F.lit(" и др"))
    names = F.filter(F.transform(F.split(t, "[;,]"), clean_value), lambda x: x.isNotNull() & (F.length(x) >= 2))
    first = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x))
    return F.aggregate(names, F.array().cast("array<string>"), first)


def format_number(value: Column) -> Column:
    """Three significant digits without zeros at the end; whole numbers from 100 on."""
    text = F.format_string("%.3g", value)
    trimmed = F.regexp_replace(text, r"\.?0+$", "")
    return F.when(F.abs(value) >= 100, F.format_string("%.0f", value)).otherwise(F.when(text.contains(".") & ~text.contains("e"), trimmed).otherwise(text))


def result_text(value: Column, unit: Column) -> Column:
    """value with its unit, unless the unit stands in it already; NULL without a value."""
    has = unit.isNull() | F.lower(value).contains(F.lower(unit))
    return F.when(value.isNotNull(), F.when(has, value).otherwise(F.concat_ws(" ", value, unit)))


def condition_text(conditions: Column, limit: int = 4) -> Column:
    """The first conditions that have a parameter or a value, as ``parameter: value unit`` joined by ``; ``."""
    texts = F.transform(
        conditions,
        lambda c: F.concat_ws(": ", clean_value(c["parameter"]), result_text(clean_value(c["value"]), clean_value(c["unit"]))),
    )
    return F.array_join(F.slice(F.filter(texts, lambda x: x != ""), 1, limit), "; ")


def compact_text(text: Column, limit: int, missing: str = "—") -> Column:
    """text of at most limit characters, longer ones with ``...`` at the end; ``missing`` for NULL and empty ones."""
    t = collapse_spaces(text)
    short = F.when(F.length(t) > limit, F.concat(F.rtrim(F.left(t, F.lit(limit - 1))), F.lit("..."))).otherwise(t)
    return F.when(t.isNull() | (t == ""), F.lit(missing)).otherwise(short)


def try_number(text: Column) -> Column:
    """DOUBLE of a text with a decimal comma or point; NULL for blanks and for what is no number."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def word_set(name: Column) -> Column:
    """The distinct words of a name without its bracketed parts, sorted and joined: equal for any order of the words."""
    plain = F.lower(collapse_spaces(F.regexp_replace(name, r"\([^()]*\)", " ")))
    return F.array_join(F.array_sort(F.array_distinct(F.split(plain, " "))), " ")


def url_encoded(text: Column) -> Column:
    """Percent-encoding of all but letters, digits and ``-._~``."""
    t = F.url_encode(text)
    return F.replace(F.replace(F.replace(t, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
