"""Text and range predicates of the fact search. Words, stems and units of a query are worked out once, by the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.numbers import bounds, decimals, number_range
from orelode.functions.text import LETTERS, stem_literal
from orelode.functions.units import UNITS, canonical_literal, clean_unit, known_unit

FREE_TYPES = ("Material", "Process", "Property", "Equipment", "Expert")


def query_words(text: str) -> list[str]:
    found = (w.lower().strip("_+-") for w in re.findall(f"[{LETTERS}0-9_+-]+", text))
    return [w for w in found if len(w) >= 2]


def query_variants(text: str, synonyms: dict[str, str] | None = None) -> list[str]:
    """text and its canonical synonym in lower case; none, so that nothing matches, if text has no word."""
    plain = " ".join(text.lower().split())
    if not query_words(plain):
        return []
    canonical = (synonyms or {}).get(plain)
    return [plain, canonical] if canonical and canonical != plain else [plain]


def word_forms(word: str) -> list[str]:
    return list(dict.fromkeys([word, stem_literal(word)]))


def text_match(texts: list[Column], query: str, synonyms: dict[str, str] | None = None, least: int | None = None) -> Column:
    """Whether one of texts contains a variant of query, or all of its words in some form (``least`` of them, if given)."""
    any_of = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))
    found = []
    for text in texts:
        low = F.lower(text)
        for variant in query_variants(query, synonyms):
            found.append(F.coalesce(low.contains(variant), F.lit(False)))
            words = query_words(variant)
            hits = [F.coalesce(any_of([low.contains(f) for f in word_forms(w)]), F.lit(False)).cast("int") for w in words]
            found.append(reduce(lambda a, b: a + b, hits) >= (len(words) if least is None else min(least, len(words))))
    return any_of(found)


def ranges_intersect(value: Column, low: float | None, high: float | None) -> Column:
    """Whether the closed interval value, a STRUCT<lo, hi>, meets [low, high]; open ends are None. NULL doesn't."""
    above = value["hi"] >= low if low is not None else F.lit(True)
    below = value["lo"] <= high if high is not None else F.lit(True)
    return F.coalesce(value.isNotNull() & above & below, F.lit(False))


def _unit_contains(cleaned: Column, wanted: str) -> Column:
    """Whether one of two units, both cleaned, contains the other."""
    return F.coalesce(cleaned.contains(wanted) | F.lit(wanted).contains(cleaned), F.lit(False))


def _cleaned_literal(unit: str) -> str:
    return " ".join(unit.lower().split())


def _as_wanted(r: Column, unit: Column, wanted: str) -> Column:
    """The interval r in canonical unit ``wanted``, from the known unit of the same dimension; NULL for another one."""
    dim, scale, shift = UNITS[wanted]
    a, b = ((r[c] * unit["factor"] + unit["offset"] - shift) / scale for c in ("lo", "hi"))
    return F.when(unit["dimension"] == dim, F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))


def conditions_match(conditions: Column, parameter: str | None, low: float | None, high: float | None, unit: str | None) -> Column:
    """Whether a condition has the parameter, and a value in the bounds, converted where both units are known.

    Two known units of different dimensions never match; where one is unknown, one must contain the other. Each condition
    is taken apart once: its name, unit and numbers, then the looked up unit and the interval.
    """
    bounded = low is not None or high is not None
    parts = lambda c: F.struct(F.lower(c["parameter"]).alias("p"), clean_unit(c["unit"]).alias("u"), (decimals(c["value"]) if bounded else F.lit(None).cast("array<double>")).alias("n"))
    named = F.transform(conditions, parts)
    if parameter:
        named = F.filter(named, lambda c: F.coalesce(c["p"].contains(parameter.lower()), F.lit(False)))
    known = F.transform(named, lambda c: F.struct(c["u"].alias("u"), bounds(c["n"]).alias("r"), (known_unit(c["u"]) if unit else F.lit(None)).alias("k")))
    wanted = canonical_literal(unit)

    def test(c: Column) -> Column:
        plain = ranges_intersect(c["r"], low, high) if bounded else F.lit(True)
        if not unit:
            return plain
        loose = _unit_contains(c["u"], _cleaned_literal(unit)) & plain
        if wanted is None:
            return loose
        same = ranges_intersect(_as_wanted(c["r"], c["k"], wanted), low, high) if bounded else c["k"]["dimension"] == UNITS[wanted][0]
        return F.when(c["k"].isNotNull(), same).otherwise(loose)

    return F.coalesce(F.exists(known, test), F.lit(False))


@dataclass(frozen=True)
class FactFilter:
    """The filters of the fact search, ANDed; None is no filter. Text filters match variants, words and stems."""

    material: str | None = None
    process: str | None = None
    property_query: str | None = None
    parameter: str | None = None
    value_min: float | None = None
    value_max: float | None = None
    unit: str | None = None
    result_unit: str | None = None
    confidence: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    geo: str | None = None
    geo_scope: str | None = None
    expert: str | None = None
    result_value_min: float | None = None
    result_value_max: float | None = None

    @classmethod
    def of(cls, values: dict) -> FactFilter:
        """From what a caller sends: unknown names, None and empty texts are dropped, and what can't be a number too."""
        kept = {}
        for f in fields(cls):
            v = values.get(f.name)
            if v is None or v == "":
                continue
            if f.name.startswith(("value_", "result_value_", "year_")):
                try:
                    v = float(str(v).replace(",", "."))
                except ValueError:
                    continue
                v = int(v) if f.name.startswith("year_") else v
            kept[f.name] = v
        return cls(**kept)


def spellings(normal: DataFrame) -> DataFrame:
    """(node_type, name, spelling): every distinct spelling of the materials, processes and properties of the facts."""
    kinds = (("Material", "material", "material_raw"), ("Process", "process", "process_raw"), ("Property", "property", "property_raw"))
    pairs = F.array(*[F.struct(F.lit(k).alias("node_type"), F.col(n).alias("name"), F.col(r).alias("spelling")) for k, n, r in kinds])
    return normal.select(F.explode(pairs).alias("s")).select("s.*").where("name is not null").distinct()


def named_like(names: DataFrame, kind: str, query: str, synonyms: dict[str, str] | None = None) -> DataFrame:
    """(name): the entities of one kind whose name or one of whose spellings matches query, each text on its own."""
    matched = names.where((F.col("node_type") == kind) & text_match([F.col("name"), F.col("spelling")], query, synonyms))
    return matched.select("name").distinct()


def find_facts(rows: DataFrame, f: FactFilter, synonyms: dict[str, str] | None = None, names: DataFrame | None = None) -> DataFrame:
    """The fact rows that pass every filter of f.

    names are the ``spellings`` of the facts: with them, material, process and property are found by any spelling that was
    typed, by a semi join on the entities that match; without, by the entity name alone.
    """
    tests: list[Column] = []
    for query, column, kind in ((f.material, "material", "Material"), (f.process, "process", "Process"), (f.property_query, "property", "Property")):
        if query is None:
            continue
        if names is None:
            tests.append(F.col(column).isNotNull() & text_match([F.col(column)], query, synonyms))
        else:
            rows = rows.join(named_like(names, kind, query, synonyms).withColumnRenamed("name", column), column, "left_semi")
    for query, column in ((f.geo, "location_geo"), (f.expert, "lab_or_author")):
        if query is not None:
            tests.append(F.col(column).isNotNull() & text_match([F.col(column)], query, synonyms))
    for wanted, column in ((f.confidence, "confidence"), (f.geo_scope, "geo_scope")):
        if wanted is not None:
            tests.append(F.lower(F.trim(column)) == wanted.strip().lower())
    if f.year_min is not None or f.year_max is not None:
        tests.append(ranges_intersect(number_range(F.col("year")), f.year_min, f.year_max))
    if f.parameter or f.value_min is not None or f.value_max is not None or f.unit:
        tests.append(conditions_match(F.col("conditions"), f.parameter, f.value_min, f.value_max, f.unit))
    bounded = f.result_value_min is not None or f.result_value_max is not None
    if f.result_unit or bounded:
        r, cleaned = number_range(F.col("result_value")), clean_unit(F.col("result_unit"))
        wanted, known = canonical_literal(f.result_unit), known_unit(cleaned)
        if f.result_unit:
            loose = _unit_contains(cleaned, _cleaned_literal(f.result_unit))
            tests.append(loose if wanted is None else F.when(known.isNotNull(), known["dimension"] == UNITS[wanted][0]).otherwise(loose))
        if bounded:
            r = r if wanted is None else F.coalesce(_as_wanted(r, known, wanted), r)
            tests.append(ranges_intersect(r, f.result_value_min, f.result_value_max))
    return reduce(lambda df, t: df.where(t), tests, rows)


def matching_nodes(nodes: DataFrame, query: str, synonyms: dict[str, str] | None = None, least: int | None = None, include_base: bool = False) -> DataFrame:
    """The nodes of the searchable types whose name, display name or one alias matches query, each text on its own.

    include_base: the base of the name is searched too.
    """
    named = nodes.where(F.col("node_type").isin(*FREE_TYPES))
    texts = F.concat(F.array("name", "display_name", *(["base"] if include_base else [])), F.coalesce("aliases", F.array().cast("array<string>")))
    return named.where(F.exists(texts, lambda t: text_match([t], query, synonyms, least)))


def free_search(rows: DataFrame, nodes: DataFrame, edges: DataFrame, query: str, synonyms: dict[str, str] | None = None) -> DataFrame:
    """Fact rows with a matched entity, by the priority material, process, property, equipment of the process, author.

    One of two or fewer words must all match, of more at least two. Each row of fact_id and studied_id stands once, with
    matched_entity and matched_entity_type; of several pieces of equipment the first by name counts.
    """
    words = query_words(query)
    m = matching_nodes(nodes, query, synonyms, None if len(words) <= 2 else 2).select("node_id", "node_type", "name")
    of = lambda kind, key: m.where(F.col("node_type") == kind).select(F.col("name").alias(key), F.lit(True).alias(f"is_{key}"))
    used = edges.where("edge_type = 'uses_equipment'").join(m.where("node_type = 'Equipment'"), F.col("dst") == F.col("node_id"))
    used = used.groupBy(F.expr("substring(src, 9)").alias("process")).agg(F.min("name").alias("equipment_match"))
    out = rows.join(of("Material", "material"), "material", "left").join(of("Process", "process"), "process", "left").join(of("Property", "property"), "property", "left").join(used, "process", "left")
    expert = text_match([F.col("lab_or_author")], query, synonyms, None if len(words) <= 2 else 2)
    kind = (
        F.when(F.col("is_material"), "Material").when(F.col("is_process"), "Process").when(F.col("is_property"), "Property").when(F.col("equipment_match").isNotNull(), "Equipment").when(expert, "Expert")
    )
    entity = F.when(kind == "Material", F.col("material")).when(kind == "Process", F.col("process")).when(kind == "Property", F.col("property")).when(kind == "Equipment", F.col("equipment_match")).otherwise(F.col("lab_or_author"))
    out = out.withColumn("matched_entity_type", kind).where("matched_entity_type is not null").withColumn("matched_entity", entity)
    return out.drop("is_material", "is_process", "is_property", "equipment_match").dropDuplicates(["fact_id", "studied_id"])
