"""Unit registry and linear conversion as column expressions.

Every canonical unit belongs to one dimension and converts to its common unit by value * factor + offset.
``%`` and mass percent are different dimensions and never convert into each other.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical unit -> (dimension, factor, offset) to the common unit of the dimension.
UNITS: dict[str, tuple[str, float, float]] = {
    "mg/l": ("concentration", 1.0, 0.0),
    "g/l": ("concentration", 1000.0, 0.0),
    "kg/m3": ("concentration", 1000.0, 0.0),
    "mg/m3": ("concentration", 0.001, 0.0),
    "ug/l": ("concentration", 0.001, 0.0),
    "ppm": ("mass_fraction", 1.0, 0.0),
    "g/t": ("mass_fraction", 1.0, 0.0),
    "mg/kg": ("mass_fraction", 1.0, 0.0),
    "%_mass": ("mass_fraction", 10000.0, 0.0),
    "%": ("percent", 1.0, 0.0),
    "c": ("temperature", 1.0, 0.0),
    "k": ("temperature", 1.0, -273.15),
    "f": ("temperature", 5.0 / 9.0, -160.0 / 9.0),
    "m3/h": ("flow", 1.0, 0.0),
    "m3/min": ("flow", 60.0, 0.0),
    "m3/s": ("flow", 3600.0, 0.0),
    "l/h": ("flow", 0.001, 0.0),
    "l/min": ("flow", 0.06, 0.0),
    "l/s": ("flow", 3.6, 0.0),
    "mpa": ("pressure", 1.0, 0.0),
    "kpa": ("pressure", 0.001, 0.0),
    "pa": ("pressure", 1e-6, 0.0),
    "bar": ("pressure", 0.1, 0.0),
    "atm": ("pressure", 0.101325, 0.0),
    "h": ("time", 1.0, 0.0),
    "min": ("time", 1.0 / 60.0, 0.0),
    "s": ("time", 1.0 / 3600.0, 0.0),
    "day": ("time", 24.0, 0.0),
    "mm": ("length", 1.0, 0.0),
    "cm": ("length", 10.0, 0.0),
    "m": ("length", 1000.0, 0.0),
    "um": ("length", 0.001, 0.0),
}

# Spelling (lower case) -> canonical unit.
SPELLINGS: dict[str, str] = {
    "mg/l": "mg/l", "мг/л": "mg/l", "mg/dm3": "mg/l", "мг/дм3": "mg/l",
    "g/l": "g/l", "г/л": "g/l", "g/dm3": "g/l", "г/дм3": "g/l",
    "kg/m3": "kg/m3", "кг/м3": "kg/m3",
    "mg/m3": "mg/m3", "мг/м3": "mg/m3",
    "ug/l": "ug/l", "µg/l": "ug/l", "μg/l": "ug/l", "мкг/л": "ug/l",
    "ppm": "ppm", "г/т": "g/t", "g/t": "g/t", "mg/kg": "mg/kg", "мг/кг": "mg/kg",
    "% масс": "%_mass", "% мас": "%_mass", "мас.%": "%_mass", "мас. %": "%_mass", "масс.%": "%_mass", "wt%": "%_mass", "wt.%": "%_mass",
    "%": "%", "проц": "%", "percent": "%",
    "c": "c", "°c": "c", "° c": "c", "град c": "c", "град. c": "c", "град с": "c", "градус c": "c", "celsius": "c", "цельсий": "c",
    "k": "k", "°k": "k", "кельвин": "k",
    "f": "f", "°f": "f", "° f": "f", "фаренгейт": "f",
    "m3/h": "m3/h", "м3/ч": "m3/h",
    "m3/min": "m3/min", "м3/мин": "m3/min",
    "m3/s": "m3/s", "м3/с": "m3/s",
    "l/h": "l/h", "л/ч": "l/h",
    "l/min": "l/min", "л/мин": "l/min",
    "l/s": "l/s", "л/с": "l/s",
    "mpa": "mpa", "мпа": "mpa",
    "kpa": "kpa", "кпа": "kpa",
    "pa": "pa", "па": "pa",
    "bar": "bar", "бар": "bar",
    "atm": "atm", "атм": "atm",
    "h": "h", "ч": "h", "час": "h", "часов": "h", "часа": "h", "hour": "h",
    "min": "min", "мин": "min",
    "s": "s", "с": "s", "сек": "s", "sec": "s",
    "day": "day", "сут": "day", "сутки": "day",
    "mm": "mm", "мм": "mm",
    "cm": "cm", "см": "cm",
    "m": "m", "м": "m",
    "um": "um", "µm": "um", "μm": "um", "мкм": "um",
}

# The common unit of each dimension.
COMMON: dict[str, str] = {
    "concentration": "mg/l", "mass_fraction": "ppm", "percent": "%", "temperature": "c",
    "flow": "m3/h", "pressure": "mpa", "time": "h", "length": "mm",
}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def clean_unit(unit: Column) -> Column:
    """Lower case, superscripts and degree signs folded, one blank between words, no outer blanks."""
    folded = F.translate(F.lower(unit), "³²\u00a0˚", "32 °")
    folded = F.replace(F.replace(folded, F.lit("℃"), F.lit("°c")), F.lit("°с"), F.lit("°c"))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def canonical_unit(unit: Column) -> Column:
    """Canonical unit of a spelling, NULL if unknown; full stops at the end are dropped on a second try."""
    cleaned = clean_unit(unit)
    known = _map(SPELLINGS)
    return F.coalesce(F.try_element_at(known, cleaned), F.try_element_at(known, F.rtrim(cleaned, F.lit("."))))


def dimension(canonical: Column) -> Column:
    return F.try_element_at(_map({k: v[0] for k, v in UNITS.items()}), canonical)


def factor(canonical: Column) -> Column:
    return F.try_element_at(_map({k: v[1] for k, v in UNITS.items()}), canonical)


def offset(canonical: Column) -> Column:
    return F.try_element_at(_map({k: v[2] for k, v in UNITS.items()}), canonical)


def common_unit(canonical: Column) -> Column:
    return F.try_element_at(_map({k: COMMON[v[0]] for k, v in UNITS.items()}), canonical)


def convert(value: Column, source: Column, target: Column) -> Column:
    """value in canonical unit source as target; NULL if either is unknown or the dimensions differ."""
    base = value * factor(source) + offset(source)
    return F.when(dimension(source) == dimension(target), (base - offset(target)) / factor(target))


def canonical_literal(unit: str | None) -> str | None:
    """canonical_unit of a literal of a query, on the driver."""
    t = " ".join((unit or "").lower().translate(str.maketrans("³²\u00a0˚", "32 °")).replace("℃", "°c").replace("°с", "°c").split())
    return SPELLINGS.get(t) or SPELLINGS.get(t.rstrip("."))


def known_unit(cleaned: Column) -> Column:
    """STRUCT<dimension, factor, offset> of a unit that clean_unit has cleaned, in one lookup; NULL if it is unknown."""
    entry = lambda u: F.struct(F.lit(UNITS[u][0]).alias("dimension"), F.lit(UNITS[u][1]).alias("factor"), F.lit(UNITS[u][2]).alias("offset"))
    known = F.create_map(*[x for spelling, u in SPELLINGS.items() for x in (F.lit(spelling), entry(u))])
    return F.coalesce(F.try_element_at(known, cleaned), F.try_element_at(known, F.rtrim(cleaned, F.lit("."))))


def convert_literal(value: float, source: str, target: str) -> float | None:
    """The same for a literal of a query, on the driver."""
    a, b = canonical_literal(source), canonical_literal(target)
    if a is None or b is None or UNITS[a][0] != UNITS[b][0]:
        return None
    return (value * UNITS[a][1] + UNITS[a][2] - UNITS[b][2]) / UNITS[b][1]
