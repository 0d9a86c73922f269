"""What the queries share: the relations of a dataset folder, and the same relations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orelode.functions.nulls import NULL_TEXTS
from orelode.functions.text import DOMESTIC, FOREIGN, WS
from orelode.functions.units import SPELLINGS, UNITS
from orelode.operators.facts import clean_facts, fact_rows, normal_facts
from orelode.session import stored
from orelode.sources.tables import table


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return clean_facts(table(spark, folder, "facts"))


def normal(spark: SparkSession, folder: str) -> DataFrame:
    return normal_facts(table(spark, folder, "facts"), table(spark, folder, "synonyms"))


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """The normalised facts written once, for plans that read them several times."""
    return stored(normal(spark, folder), "normal")


def rows(spark: SparkSession, folder: str) -> DataFrame:
    return fact_rows(kept(spark, folder))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def clean_sql(x: str) -> str:
    t = collapse_sql(x)
    return f"CASE WHEN lower({t}) NOT IN ({', '.join(map(quoted, NULL_TEXTS))}) THEN {t} END"


def geo_sql(place: str, author: str) -> str:
    t = f"lower(concat_ws(' ', {place}, {author}))"
    has = lambda markers: "(" + " OR ".join(f"contains({t}, {quoted(m)})" for m in markers) + ")"
    return f"CASE WHEN {has(DOMESTIC)} AND {has(FOREIGN)} THEN 'mixed' WHEN {has(DOMESTIC)} THEN 'domestic' WHEN {has(FOREIGN)} THEN 'foreign' ELSE 'unknown' END"


PAREN = r"^(.*[^ (]) *\(([^()]+)\)$"


def paren_use_sql(x: str) -> str:
    base, alias = f"regexp_extract({x}, '{PAREN}', 1)", f"trim(regexp_extract({x}, '{PAREN}', 2))"
    return f"(length({base}) >= 2 AND NOT (length({base}) < 4 AND regexp_matches({base}, '^[A-Za-z0-9+-]*[A-Za-z][A-Za-z0-9+-]*$')) AND {alias} <> '')"


def paren_base_sql(x: str) -> str:
    return f"CASE WHEN {paren_use_sql(x)} THEN regexp_extract({x}, '{PAREN}', 1) ELSE {x} END"


def unit_clean_sql(x: str) -> str:
    t = f"replace(replace(translate(lower({x}), '³² ˚', '32 °'), '℃', '°c'), '°с', '°c')"
    return collapse_sql(t)


def unit_sql(x: str) -> str:
    t = unit_clean_sql(x)
    spell = lambda v: f"CASE {v} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(u)}" for k, u in SPELLINGS.items()) + " END"
    return f"coalesce({spell(t)}, {spell(f'rtrim({t}, {quoted(chr(46))})')})"


def unit_part_sql(canonical: str, part: int) -> str:
    show = quoted if part == 0 else repr
    kind = "VARCHAR" if part == 0 else "DOUBLE"
    return f"CAST(CASE {canonical} " + " ".join(f"WHEN {quoted(k)} THEN {show(v[part])}" for k, v in UNITS.items()) + f" END AS {kind})"


SQL_UNITS = "units AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(UNITS[u][0])}, {UNITS[u][1]!r}::DOUBLE, {UNITS[u][2]!r}::DOUBLE)" for k, u in SPELLINGS.items()) + ") t(spelling, dim, scale, shift))"


def range_sql(x: str) -> str:
    """LIST of the signed decimals of a text, as number_range reads them."""
    t = f"translate({x}, ',–—−~∼', '.---  ')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '(\d)\s*-\s*(\d)', '\1 \2', 'g')"
    return rf"list_transform(regexp_extract_all({t}, '-?[0-9]+(?:\.[0-9]+)?'), lambda v: CAST(v AS DOUBLE))"


SQL_CLEAN = f"""cf AS (SELECT fact_id, {clean_sql('material')} AS material, {clean_sql('process')} AS process, {clean_sql('result_property')} AS result_property,
  {clean_sql('result_value')} AS result_value, {clean_sql('result_unit')} AS result_unit, {clean_sql('direction')} AS direction, coalesce(conditions, []) AS conditions,
  {clean_sql('source_file')} AS source_file, {clean_sql('source_quote')} AS source_quote, chunk_id, {clean_sql('confidence')} AS confidence, {clean_sql('year')} AS year,
  {clean_sql('location_geo')} AS location_geo, {clean_sql('lab_or_author')} AS lab_or_author, {clean_sql('equipment')} AS equipment, verification_status, updated_at FROM facts)"""

SQL_SYNONYMS = f"""syn AS (SELECT lower({collapse_sql('a')}) AS alias, min(canonical) AS canonical FROM
  (SELECT unnest(list_append(coalesce(aliases, []), canonical)) AS a, lower({collapse_sql('canonical')}) AS canonical FROM synonyms) GROUP BY 1)"""

SQL_NORMAL = f"""{SQL_CLEAN}, {SQL_SYNONYMS},
nf AS (SELECT fact_id, {paren_base_sql('coalesce(sm.canonical, lower(material))')} AS material, {paren_base_sql('coalesce(sp.canonical, lower(process))')} AS process,
  lower(result_property) AS property, lower(equipment) AS equipment, material AS material_raw, process AS process_raw, result_property AS property_raw, equipment AS equipment_raw,
  result_value, result_unit, direction, conditions, coalesce(source_file, 'unknown_source_' || CAST(fact_id AS VARCHAR)) AS source_file, source_quote, chunk_id,
  lower(confidence) AS confidence, year, location_geo, lab_or_author, {geo_sql('location_geo', 'lab_or_author')} AS geo_scope
  FROM cf LEFT JOIN syn sm ON lower(cf.material) = sm.alias LEFT JOIN syn sp ON lower(cf.process) = sp.alias)"""

SQL_ROWS = f"""{SQL_NORMAL},
fr AS (SELECT y.* EXCLUDE (material, material_raw), s.fact_id AS studied_id, s.material AS material
  FROM (SELECT * FROM nf WHERE process IS NOT NULL AND property IS NOT NULL) y
  LEFT JOIN (SELECT * FROM nf WHERE material IS NOT NULL AND process IS NOT NULL) s
  ON y.process = s.process AND y.source_file IS NOT DISTINCT FROM s.source_file AND y.chunk_id IS NOT DISTINCT FROM s.chunk_id AND y.source_quote IS NOT DISTINCT FROM s.source_quote)"""
