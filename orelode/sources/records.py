"""JSON lines of fact records, read without failing on broken lines, and flattened into the facts relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.functions.text import clean_value

RECORD = (
    "record_type string, source_file string, chunk_id int, material struct<name:string,type:string,composition_note:string>, process struct<name:string,label:string,description:string>, "
    "conditions array<struct<parameter:string,value:string,unit:string>>, result struct<property:string,value:string,unit:string,direction:string>, "
    "context struct<equipment:string,location_geo:string,year:string,lab_or_author:string>, confidence string, source_quote string, text string"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a line that isn't blank: ord (the place in the input), kind (record, value or broken) and the record.

    Numbers where texts are expected become texts; a field of a wrong kind is NULL. Only objects are records.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("line")).where("line <> ''")
    valid = F.try_parse_json("line").isNotNull()
    kind = F.when(valid & F.col("line").startswith("{"), "record").when(valid, "value").otherwise("broken")
    parsed = F.when(kind == "record", F.from_json("line", RECORD, {"mode": "PERMISSIVE"}))
    return lines.select("ord", kind.alias("kind"), parsed.alias("record"))


def record_stats(records: DataFrame) -> DataFrame:
    """(kind, n): facts, conclusions, records of other types, values that are no objects, and broken lines."""
    kind = F.when(F.col("kind") == "record", F.coalesce("record.record_type", F.lit("unknown"))).otherwise(F.col("kind"))
    return records.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def facts_of(records: DataFrame) -> DataFrame:
    """The flat facts relation, with ord as fact_id."""
    r = records.where("kind = 'record' and record.record_type = 'fact'").select("ord", "record.*")
    return r.select(
        F.col("ord").alias("fact_id"), F.col("material.name").alias("material"), F.coalesce("process.name", "process.label").alias("process"), F.col("result.property").alias("result_property"),
        F.col("result.value").alias("result_value"), F.col("result.unit").alias("result_unit"), F.col("result.direction").alias("direction"), "conditions", "source_file", "source_quote", "chunk_id",
        "confidence", "context.year", "context.location_geo", "context.lab_or_author", "context.equipment",
    )


def conclusions_of(records: DataFrame) -> DataFrame:
    """(conclusion_id, source_file, chunk_id, text, confidence) of the conclusions that have a text."""
    r = records.where("kind = 'record' and record.record_type = 'conclusion'").select("ord", "record.*").where(clean_value(F.col("text")).isNotNull())
    return r.select(F.concat_ws(":", F.lit("Conclusion"), "source_file", "chunk_id", "ord").alias("conclusion_id"), "source_file", "chunk_id", clean_value(F.col("text")).alias("text"), "confidence")


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(canonical_id, canonical, aliases) from a JSON object of canonical names with lists of aliases."""
    text = spark.read.text(path, wholetext=True)
    entry = text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,array<string>>"))).alias("i", "e"))
    return entry.select((F.col("i") + 1).alias("canonical_id"), F.col("e.key").alias("canonical"), F.col("e.value").alias("aliases"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a JSON array of quality audits; a byte order mark is no matter."""
    return spark.read.option("multiLine", True).json(path)
