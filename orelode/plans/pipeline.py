"""Queries that SQL can't express, and the whole way from files to the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.operators.chunking import chunked
from orelode.operators.facts import normal_facts
from orelode.operators.graph import edges, nodes
from orelode.operators.mojibake import repaired
from orelode.plans.scalars import _TRIM, DOC_CLEAN_SQL, PARAGRAPHS_SQL
from orelode.sources.documents import scan_documents
from orelode.sources.extraction import extract, rule_extractor
from orelode.sources.records import facts_of, read_records
from orelode.sources.tables import table


def chunk_greedy(spark: SparkSession, folder: str) -> DataFrame:
    c = chunked(table(spark, folder, "extracted"), "text_id", "text")
    return c.select(F.col("id").alias("text_id"), "chunk_id", F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("digest"))


def mojibake_repair(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "facts").select("fact_id", repaired("source_quote").alias("quote"))


def extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Records that the rule extractor finds in the chunks of the texts."""
    c = chunked(table(spark, folder, "extracted"), "text_id", "text")
    named = c.join(table(spark, folder, "extracted").select(F.col("text_id").alias("id"), "source_file"), "id")
    return extract(named, rule_extractor).groupBy("record_type").agg(F.count("*").alias("n"))


def build(spark: SparkSession, root: str, work: str, synonyms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from the files under root: texts, chunks, records and facts are written under work in turn."""
    texts = scan_documents(spark, root)
    texts.write.mode("overwrite").parquet(f"{work}/texts")
    ok = spark.read.parquet(f"{work}/texts").where("status = 'ok'").select(F.xxhash64("source_file").alias("text_id"), "source_file", "text")
    chunks = chunked(ok, "text_id", "text").join(ok.select(F.col("text_id").alias("id"), "source_file"), "id")
    extract(chunks).where("record is not null").select("record").write.mode("overwrite").text(f"{work}/records")
    facts = facts_of(read_records(spark, f"{work}/records")).withColumn("verification_status", F.lit("auto_extracted"))
    normal = normal_facts(facts, synonyms)
    return nodes(normal), edges(normal)


QUERIES = {"chunk_greedy": chunk_greedy, "mojibake_repair": mojibake_repair, "extraction": extraction}
_WINDOWS = f"list_filter(list_transform(range(0, CAST(ceil((length(p) - 3000) / 2700.0) AS BIGINT) + 1), lambda k: {_TRIM('substring(p, k * 2700 + 1, 3000)')}), lambda x: x <> '')"
_TAIL = _TRIM("right(open, 300)")
SQL = {
    # one step takes one paragraph: what it closes, and what stays open
    "chunk_greedy": f"""WITH RECURSIVE t AS (SELECT text_id, {PARAGRAPHS_SQL(DOC_CLEAN_SQL('text'))} AS l FROM extracted WHERE text IS NOT NULL),
      r AS (SELECT text_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS closed, '' AS open FROM t
        UNION ALL SELECT text_id, i + 1,
          CASE WHEN length(p) > 3000 THEN list_concat(CASE WHEN open = '' THEN [] ELSE [open] END, {_WINDOWS}) WHEN open = '' OR length(open) + 2 + length(p) <= 3000 THEN [] ELSE [open] END,
          CASE WHEN length(p) > 3000 THEN '' WHEN open = '' THEN p WHEN length(open) + 2 + length(p) <= 3000 THEN open || chr(10) || chr(10) || p
            WHEN {_TAIL} = '' THEN p ELSE {_TAIL} || chr(10) || chr(10) || p END
        FROM (SELECT r.*, list_extract(l, i + 1) AS p FROM r JOIN t USING (text_id) WHERE i < len(l))),
      c AS (SELECT text_id, i, unnest(closed) AS chunk, unnest(range(1, len(closed) + 1)) AS k FROM r UNION ALL SELECT text_id, i + 1, open, 1 FROM r JOIN t USING (text_id) WHERE i = len(l) AND open <> '')
      SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY i, k) AS chunk_id, length(chunk) AS n_chars, md5(chunk) AS digest FROM c""",
}
