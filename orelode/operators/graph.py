"""The fact graph as two relations, nodes and edges, and the operators on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import base_variant, category, split_experts

EQUIPMENT_LEAST = 2


def node_id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(kind + ":"), name)


def mentions(normal: DataFrame) -> DataFrame:
    """(node_type, name, spelling, ord): every mention of an entity in the facts."""
    kinds = (("Material", "material", "material_raw"), ("Process", "process", "process_raw"), ("Property", "property", "property_raw"), ("Equipment", "equipment", "equipment_raw"))
    parts = [normal.where(F.col(n).isNotNull()).select(F.lit(k).alias("node_type"), F.col(n).alias("name"), F.col(r).alias("spelling"), F.col("fact_id").alias("ord")) for k, n, r in kinds]
    experts = normal.select(F.explode(split_experts(F.col("lab_or_author"))).alias("name"), "fact_id")
    parts.append(experts.select(F.lit("Expert").alias("node_type"), "name", F.col("name").alias("spelling"), F.col("fact_id").alias("ord")))
    parts.append(normal.select(F.lit("Document").alias("node_type"), F.col("source_file").alias("name"), F.col("source_file").alias("spelling"), F.col("fact_id").alias("ord")))
    return reduce(DataFrame.unionByName, parts)


def used_equipment(normal: DataFrame) -> DataFrame:
    """(equipment): the equipment that EQUIPMENT_LEAST facts or more mention."""
    return normal.where("equipment is not null").groupBy("equipment").agg(F.count("*").alias("n")).where(F.col("n") >= EQUIPMENT_LEAST).select("equipment")


def nodes(normal: DataFrame) -> DataFrame:
    """One node an entity: the first spelling as display name, all spellings in the order they appear, and the mentions.

    Columns: node_id, node_type, name, display_name, aliases, mention_count, base, variant, category. Equipment counts only
    where often enough and with a process in one of its facts. Repeated facts count as mentions of their own.
    """
    m = mentions(normal)
    allowed = normal.where("process is not null").select("equipment").join(used_equipment(normal), "equipment", "left_semi").distinct()
    rare = m.where("node_type = 'Equipment'").join(allowed, m["name"] == allowed["equipment"], "left_semi")
    m = m.where("node_type <> 'Equipment'").unionByName(rare)
    per = m.groupBy("node_type", "name", "spelling").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    folded = per.groupBy("node_type", "name").agg(F.array_sort(F.collect_list(F.struct("first", "spelling"))).alias("s"), F.sum("n").alias("mention_count"))
    base, variant = base_variant(F.col("name"))
    entity = F.col("node_type").isin("Material", "Process")
    return folded.select(
        F.concat_ws(":", "node_type", "name").alias("node_id"), "node_type", "name", F.get("s", F.lit(0))["spelling"].alias("display_name"), F.transform("s", lambda x: x["spelling"]).alias("aliases"),
        "mention_count", F.when(entity, base).alias("base"), F.when(entity, variant).alias("variant"), F.when(F.col("node_type") == "Document", category(F.col("name"))).alias("category"),
    )


def edges(normal: DataFrame) -> DataFrame:
    """All edges, parallel ones kept: edge_type, src, dst, and the attributes of their fact."""
    attributes = ["fact_id", "confidence", "geo_scope", "source_file", "chunk_id", "source_quote", "year", "location_geo"]
    f = normal.join(used_equipment(normal).withColumn("often", F.lit(True)), "equipment", "left")
    f = f.withColumn("expert", F.explode_outer(split_experts(F.col("lab_or_author"))))
    ids = {k: node_id(k, F.col(c)) for k, c in (("Material", "material"), ("Process", "process"), ("Property", "property"), ("Equipment", "equipment"), ("Expert", "expert"), ("Document", "source_file"))}

    def edge(kind: str, a: str, b: str, once: bool, more: Column | None = None) -> Column:
        both = ids[a].isNotNull() & ids[b].isNotNull() & (F.lit(True) if more is None else more)
        if once:
            both = both & F.col("_first")
        return F.when(both, F.struct(F.lit(kind).alias("edge_type"), ids[a].alias("src"), ids[b].alias("dst")))

    # edges that don't touch an expert stand once a fact, with the first of its experts
    f = f.withColumn("_first", F.col("expert").isNull() | F.col("expert").eqNullSafe(F.get(split_experts(F.col("lab_or_author")), F.lit(0))))
    found = F.array_compact(F.array(
        edge("from_document", "Material", "Document", True), edge("from_document", "Process", "Document", True), edge("studied_in", "Material", "Process", True),
        edge("yields", "Process", "Property", True), edge("uses_equipment", "Process", "Equipment", True, F.coalesce("often", F.lit(False))),
        edge("from_document", "Expert", "Document", False), edge("expert_in", "Expert", "Process", False), edge("worked_on", "Expert", "Material", False),
    ))
    return f.select(*attributes, F.explode(found).alias("e")).select("e.*", *attributes)


def degree(edges_: DataFrame) -> DataFrame:
    """(node_id, degree): edges that begin or end at a node; a loop counts twice."""
    ends = edges_.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def neighbours(edges_: DataFrame, matched: DataFrame) -> DataFrame:
    """Edges out of and into the matched nodes (node_id), with their direction; a loop appears in both."""
    out = edges_.join(matched, edges_["src"] == matched["node_id"], "left_semi").select(F.lit("out").alias("direction"), F.col("src").alias("node"), F.col("dst").alias("neighbour"), "edge_type", "fact_id")
    into = edges_.join(matched, edges_["dst"] == matched["node_id"], "left_semi").select(F.lit("in").alias("direction"), F.col("dst").alias("node"), F.col("src").alias("neighbour"), "edge_type", "fact_id")
    return out.unionByName(into)


def subgraph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a few fact rows: five kinds of nodes and four kinds of edges, each once; no edge without its nodes."""
    kinds = {"material": "material", "process": "process", "property": "property", "document": "source_file", "expert": "lab_or_author"}
    id_ = {k: F.when(F.col(c).isNotNull(), F.concat(F.lit(k + ":"), F.col(c))) for k, c in kinds.items()}
    node = F.array_compact(F.array(*[F.when(id_[k].isNotNull(), F.struct(id_[k].alias("id"), F.lit(k).alias("kind"), F.col(c).alias("label"))) for k, c in kinds.items()]))
    links = (("material", "process", "studied_in"), ("process", "property", "yields"), ("process", "document", "from_document"), ("expert", "process", "expert_in"))
    link = F.array_compact(F.array(*[F.when(id_[a].isNotNull() & id_[b].isNotNull(), F.struct(id_[a].alias("src"), id_[b].alias("dst"), F.lit(t).alias("edge_type"))) for a, b, t in links]))
    return rows.select(F.explode(node).alias("n")).select("n.*").distinct(), rows.select(F.explode(link).alias("e")).select("e.*").distinct()
