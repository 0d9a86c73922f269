"""Writers: JSON lines, the graph as tables or one node-link document, JSON-LD, Markdown answers and the report."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from orelode.functions.text import base_variant, url_encoded
from orelode.operators.graph import edges as graph_edges
from orelode.operators.graph import nodes as graph_nodes


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet, edges by type, so that a join of two types reads these two only."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")


def read_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def read_node_link(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a node-link JSON document."""
    graph = spark.read.option("multiLine", True).json(path)
    return graph.select(F.explode("nodes").alias("n")).select("n.*"), graph.select(F.explode("links").alias("l")).select("l.*")


def node_link(nodes: DataFrame, edges: DataFrame, updated_at: str) -> str:
    """The node-link JSON of a graph that the caller knows to fit the driver."""
    rows = lambda df: [json.loads(x) for x in df.toJSON().toLocalIterator()]
    return json.dumps({"directed": True, "multigraph": True, "graph": {"updated_at": updated_at}, "nodes": rows(nodes), "links": rows(edges)}, ensure_ascii=False)


def jsonld_facts(rows: DataFrame, base: str = "urn:ore:", links: bool = True) -> DataFrame:
    """(fact_id, studied_id, iri, item): JSON-LD of each fact row, without fields that are missing.

    iri is a hash of what makes the row: its entities, value, file, chunk and quote. links: entities as references, as in the
    export of the graph; else as plain names, as in the export of an answer.
    """
    kinds = {"material": "Material:", "process": "Process:", "property": "Property:"}
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    parts = [text(F.concat(F.lit(k), F.col(c))) for c, k in kinds.items()] + [text(F.col(c)) for c in ("result_value", "source_file", "chunk_id", "source_quote")]
    iri = F.concat(F.lit(base + "fact:"), F.left(F.sha1(F.concat_ws("|", *parts)), F.lit(16)))
    entity = lambda c, k: F.concat(F.lit(base), url_encoded(F.concat(F.lit(k), F.col(c)))) if links else F.col(c)
    plain = {
        "value": "result_value", "unit": "result_unit", "direction": "direction", "confidence": "confidence", "verificationStatus": "verification_status", "sourceFile": "source_file", "sourceQuote": "source_quote", "year": "year",
        "locationGeo": "location_geo", "geoScope": "geo_scope", "expert": "lab_or_author", "equipment": "equipment", "updatedAt": "updated_at",
    }
    condition = lambda c: F.struct(F.lit("ProcessCondition").alias("@type"), c["parameter"].alias("parameter"), c["value"].alias("value"), c["unit"].alias("unit"))
    item = F.struct(
        iri.alias("@id"), F.lit("ResearchFact").alias("@type"), F.coalesce("property", F.lit("result")).alias("name"), *[entity(c, k).alias(c) for c, k in kinds.items()],
        *([entity("source_file", "Document:").alias("derivedFrom")] if links else []), *[F.col(c).alias(k) for k, c in plain.items() if c in rows.columns],
        F.when(F.size("conditions") > 0, F.transform("conditions", condition)).alias("conditions"),
    )
    return rows.select("fact_id", "studied_id", iri.alias("iri"), F.to_json(item).alias("item"))


def report_rows(normal: DataFrame) -> DataFrame:
    """(section, name, n): the normalisation report as rows: mentions, spellings and names before and after, groups of processes by their last word, nodes and edges by type."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("name"), F.col(f"{c}_raw").alias("raw")) for c in ("material", "process")])
    e = normal.select(F.explode(pairs).alias("e")).select("e.*").where("name is not null")
    counts = e.groupBy("kind").agg(F.count("*").alias("mentions"), F.countDistinct("raw").alias("raw"), F.countDistinct("name").alias("canonical"))
    none = F.lit(None).cast("string")
    parts = [counts.select(F.concat("kind", F.lit(f" {c}")).alias("section"), none.alias("name"), F.col(c).alias("n")) for c in ("mentions", "raw", "canonical")]
    base, variant = base_variant(F.col("name"))
    parts.append(e.where("kind = 'process'").groupBy(F.lit("base group").alias("section"), F.concat_ws(": ", base, variant).alias("name")).agg(F.count("*").alias("n")))
    parts.append(graph_nodes(normal).groupBy(F.lit("nodes").alias("section"), F.col("node_type").alias("name")).agg(F.count("*").alias("n")))
    parts.append(graph_edges(normal).groupBy(F.lit("edges").alias("section"), F.col("edge_type").alias("name")).agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def write_report(normal: DataFrame, path: str) -> None:
    """The normalisation report as one text of a line for each of its rows, and as many as there are names of processes."""
    lines = report_rows(normal).select(F.concat_ws("\t", "section", F.coalesce("name", F.lit("")), F.col("n").cast("string")).alias("line"))
    lines.sort("line").coalesce(1).write.mode("overwrite").text(path)


def jsonld_document(items: Iterable[str], context: dict | None = None) -> str:
    return json.dumps({"@context": context or {"@vocab": "urn:ore:vocabulary:"}, "@graph": [json.loads(x) for x in items]}, ensure_ascii=False, indent=2)


def labelled(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """The columns of df that labels names, in its order and under its names; columns that df lacks are left out."""
    return df.select(*[F.col(c).alias(label) for c, label in labels.items() if c in df.columns])


def _cell(value: object) -> str:
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(rows: list[Row], columns: dict[str, str]) -> str:
    """A Markdown table of a few rows; columns gives the heading of each field."""
    if not rows:
        return "—"
    lines = ["| " + " | ".join(columns.values()) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(_cell(r[c]) for c in columns) + " |" for r in rows]
    return "\n".join(lines)


def markdown_answer(title: str, parts: dict[str, DataFrame], limit: int = 50) -> str:
    """An answer as Markdown: one table a part, each limited to what a reader takes in."""
    text = [f"# {title}"]
    for name, df in parts.items():
        text.append(f"## {name}\n\n" + markdown_table(df.limit(limit).collect(), {c: c.replace("_", " ") for c in df.columns}))
    return "\n\n".join(text) + "\n"
