"""The relations of the fact engine: cleaned facts, normalised entities, and the fact rows of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import base_variant, clean_value, collapse_spaces, geo_scope, paren_alias

TEXT_COLUMNS = (
    "material", "process", "result_property", "result_value", "result_unit", "direction", "source_file", "source_quote", "confidence", "year", "location_geo", "lab_or_author", "equipment",
)
FACT_KEY = ("process", "source_file", "chunk_id", "source_quote")


def clean_facts(facts: DataFrame) -> DataFrame:
    """facts with collapsed texts, NULL for texts that stand for missing values, and conditions never NULL."""
    kept = [c for c in facts.columns if c not in TEXT_COLUMNS and c != "conditions"]
    return facts.select(*kept, *[clean_value(F.col(c)).alias(c) for c in TEXT_COLUMNS], F.coalesce("conditions", F.array()).alias("conditions"))


def synonym_table(synonyms: DataFrame) -> DataFrame:
    """(alias, canonical) in lower case, each canonical name among its aliases; the least canonical name of an alias counts."""
    names = F.array_append(F.coalesce(F.col("aliases"), F.array().cast("array<string>")), F.col("canonical"))
    rows = synonyms.select(F.explode(names).alias("a"), F.lower(collapse_spaces(F.col("canonical"))).alias("canonical"))
    return rows.groupBy(F.lower(collapse_spaces(F.col("a"))).alias("alias")).agg(F.min("canonical").alias("canonical"))


def with_canonical(df: DataFrame, column: str, table: DataFrame, into: str) -> DataFrame:
    """df with the entity name of a cleaned column: lower case, the canonical synonym if there is one, no alias in brackets."""
    key = f"_{into}"
    joined = df.withColumn(key, F.lower(column)).join(table.select(F.col("alias").alias(f"{key}_alias"), F.col("canonical").alias(f"{key}_name")), F.col(key) == F.col(f"{key}_alias"), "left")
    base, _ = paren_alias(F.coalesce(f"{key}_name", key))
    return joined.withColumn(into, base).drop(key, f"{key}_alias", f"{key}_name")


def normal_facts(facts: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Cleaned facts with entity names: material and process canonical, property and equipment in lower case.

    The spellings stay as material_raw, process_raw, property_raw and equipment_raw; facts without a file get one of their
    own, ``unknown_source_`` and the id; geo_scope is derived from place and author.
    """
    f = clean_facts(facts)
    table = synonym_table(synonyms)
    f = f.withColumnsRenamed({"material": "material_raw", "process": "process_raw", "result_property": "property_raw", "equipment": "equipment_raw"})
    f = with_canonical(with_canonical(f, "material_raw", table, "material"), "process_raw", table, "process")
    return f.select(
        "fact_id", "material", "process", F.lower("property_raw").alias("property"), F.lower("equipment_raw").alias("equipment"), "material_raw", "process_raw", "property_raw", "equipment_raw",
        "result_value", "result_unit", "direction", "conditions", F.coalesce("source_file", F.concat(F.lit("unknown_source_"), F.col("fact_id").cast("string"))).alias("source_file"),
        "source_quote", "chunk_id", F.lower("confidence").alias("confidence"), "year", "location_geo", "lab_or_author", geo_scope(F.col("location_geo"), F.col("lab_or_author")).alias("geo_scope"),
    )


def fact_rows(normal: DataFrame) -> DataFrame:
    """yields left-outer-joined with studied_in on the null-safe key of process, file, chunk and quote.

    Every fact with a process and a property meets every fact with a material of the same key: facts quoted from one
    sentence multiply, and none is dropped. The material comes from the studied fact, whose id is studied_id.
    """
    y = normal.where("process is not null and property is not null").drop("material", "material_raw")
    s = normal.where("material is not null and process is not null").select(F.col("fact_id").alias("studied_id"), "material", *[F.col(c).alias(f"_{c}") for c in FACT_KEY])
    on = [y[c] == s[f"_{c}"] if c == "process" else y[c].eqNullSafe(s[f"_{c}"]) for c in FACT_KEY]
    return y.join(s, on, "left").drop(*[f"_{c}" for c in FACT_KEY])


def base_of(name: Column) -> Column:
    return base_variant(name)[0]
