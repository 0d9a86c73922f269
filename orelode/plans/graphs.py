"""Queries of the graph and of the fact search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.functions.text import split_experts
from orelode.operators import graph as G
from orelode.operators import search as S
from orelode.operators.facts import fact_rows as joined_rows
from orelode.operators.facts import synonym_table
from orelode.plans.base import SQL_CLEAN, SQL_NORMAL, SQL_ROWS, SQL_UNITS, clean_sql, cleaned, kept, normal, quoted, range_sql, rows, unit_clean_sql
from orelode.plans.scalars import _BASE, _VARIANT
from orelode.session import stored
from orelode.sources.tables import table

TEXT_QUERY = "извлечение меди"
FIND = dict(process="осаждение", parameter="высота слоя", value_min=1, value_max=500, unit="см", year_min=1990)
SYNONYMS = {"ээ": "электроэкстракция"}
SPELLING, PLACE, EXPERT = "lead sinter", "Чили", "лаборатория"


def synonyms_of(spark: SparkSession, folder: str) -> dict[str, str]:
    """The reference list as the query side reads it."""
    return {r["alias"]: r["canonical"] for r in synonym_table(table(spark, folder, "synonyms")).collect()}


def fact_join_fanout(spark: SparkSession, folder: str) -> DataFrame:
    return rows(spark, folder).select("fact_id", "studied_id")


def fact_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Fact rows with the display names of their nodes."""
    n = kept(spark, folder)
    f, names = joined_rows(n), G.nodes(n).select("node_type", "name", "display_name")
    for kind, column in (("Material", "material"), ("Process", "process"), ("Property", "property")):
        part = names.where(F.col("node_type") == kind).select(F.col("name").alias(column), F.coalesce(F.nullif("display_name", F.lit("")), "name").alias(f"{column}_name"))
        f = f.join(part, column, "left")
    return f.select("fact_id", "studied_id", "material_name", "process_name", "property_name", "result_value")


def text_match_nodes(spark: SparkSession, folder: str) -> DataFrame:
    n = G.nodes(kept(spark, folder))
    return S.matching_nodes(n, "ЭЭ", synonyms_of(spark, folder)).select("node_id", "node_type")


def text_match_words(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes that hold all words of a query in one of their texts, base included; words of different aliases don't add up."""
    return S.matching_nodes(G.nodes(kept(spark, folder)), "агломерат сурьмянистый", include_base=True).select("node_id", "node_type")


def semi_join_matched(spark: SparkSession, folder: str) -> DataFrame:
    """Facts whose material, process or property is a matched node, with the first of them by priority."""
    n = kept(spark, folder)
    m = S.matching_nodes(G.nodes(n), TEXT_QUERY).select("node_type", "name")
    f = joined_rows(n).select("fact_id", "material", "process", "property").distinct()
    for kind, column in (("Material", "material"), ("Process", "process"), ("Property", "property")):
        f = f.join(m.where(F.col("node_type") == kind).select(F.col("name").alias(column), F.lit(kind).alias(f"k_{column}")), column, "left")
    return f.select("fact_id", F.coalesce("k_material", "k_process", "k_property").alias("matched")).where("matched is not null").distinct()


def equipment_two_hop(spark: SparkSession, folder: str) -> DataFrame:
    """Processes that use a matched piece of equipment, with the first of them by name."""
    n = kept(spark, folder)
    e = G.edges(n).where("edge_type = 'uses_equipment'")
    m = S.matching_nodes(G.nodes(n), "чан с мешалкой").where("node_type = 'Equipment'").select("node_id", "name")
    return e.join(m, e["dst"] == m["node_id"]).groupBy("src").agg(F.min("name").alias("equipment"))


def expert_text_join(spark: SparkSession, folder: str) -> DataFrame:
    """Facts whose author text names a matched expert, with the first expert by name."""
    n = kept(spark, folder)
    m = S.matching_nodes(G.nodes(n), "лаборатория обогащения").where("node_type = 'Expert'").select("name")
    f = n.select("fact_id", F.explode(split_experts(F.col("lab_or_author"))).alias("name"))
    return f.join(m, "name").groupBy("fact_id").agg(F.min("name").alias("expert"))


def neighbors(spark: SparkSession, folder: str) -> DataFrame:
    n = kept(spark, folder)
    m = S.matching_nodes(G.nodes(n), "ЭЭ", synonyms_of(spark, folder)).select("node_id")
    return G.neighbours(G.edges(n), m)


def frequent_semi(spark: SparkSession, folder: str) -> DataFrame:
    n = kept(spark, folder)
    return n.join(G.used_equipment(n), "equipment", "left_semi").where("process is not null").select("fact_id", "equipment")


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    n = G.nodes(kept(spark, folder))
    return n.select("node_id", "node_type", "display_name", F.array_join("aliases", " | ").alias("aliases"), "mention_count", "base", "variant", "category")


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.edges(kept(spark, folder)).select("edge_type", "src", "dst", "fact_id", "confidence", "geo_scope")


def entity_fold(spark: SparkSession, folder: str) -> DataFrame:
    return G.nodes(kept(spark, folder)).where("node_type = 'Material'").select("name", "display_name", F.array_join("aliases", " | ").alias("aliases"), "mention_count")


def degree(spark: SparkSession, folder: str) -> DataFrame:
    return G.degree(G.edges(kept(spark, folder)))


def count_by_type(spark: SparkSession, folder: str) -> DataFrame:
    n = kept(spark, folder)
    a = G.nodes(n).groupBy(F.concat(F.lit("node "), "node_type").alias("kind")).agg(F.count("*").alias("n"))
    return a.unionByName(G.edges(n).groupBy(F.concat(F.lit("edge "), "edge_type").alias("kind")).agg(F.count("*").alias("n")))


def graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of the yields edges, and their confidence."""
    y = normal(spark, folder).where("process is not null and property is not null")
    return y.agg(
        F.count("*").alias("yields"), F.countDistinct("source_file").alias("documents"), F.count_if(F.size("conditions") > 0).alias("with_conditions"), F.count_if(F.col("year").isNotNull()).alias("with_year"),
        F.count_if(F.col("location_geo").isNotNull()).alias("with_geo"), F.count_if(F.col("lab_or_author").isNotNull()).alias("with_author"), F.count_if(F.col("confidence") == "high").alias("high"),
    )


def dashboard(spark: SparkSession, folder: str) -> DataFrame:
    """(section, name, n): nodes and edges by type, confidence of the yields edges, and the entities with most mentions."""
    n = kept(spark, folder)
    nodes = stored(G.nodes(n), "nodes")
    edges = stored(G.edges(n).select("edge_type", "confidence"), "edges")
    part = lambda section, df, name: df.groupBy(F.lit(section).alias("section"), name.alias("name")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("node_type").orderBy(F.desc("mention_count"), "name"))
    top = nodes.where("node_type in ('Material', 'Process', 'Property', 'Equipment', 'Expert')").withColumn("no", rank).where("no <= 7")
    return (
        part("nodes", nodes, F.col("node_type")).unionByName(part("edges", edges, F.col("edge_type")))
        .unionByName(part("confidence", edges.where("edge_type = 'yields'"), F.coalesce("confidence", F.lit("unknown"))))
        .unionByName(top.select(F.concat(F.lit("top "), "node_type").alias("section"), "name", F.col("mention_count").alias("n")))
    )


def subgraph(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and edges around the first sixteen facts of one process."""
    few = rows(spark, folder).where("process = 'электроэкстракция'").orderBy("fact_id", "studied_id").limit(16)
    n, e = G.subgraph(few)
    return n.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("kind").alias("c")).unionByName(e.select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("edge_type").alias("c")))


def _found(spark: SparkSession, folder: str, f: S.FactFilter) -> DataFrame:
    n = kept(spark, folder)
    return S.find_facts(joined_rows(n), f, names=S.spellings(n))


def exists(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder, S.FactFilter(material="сурьмянистый")).select("fact_id", "studied_id")


def filter_text_match(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder, S.FactFilter(property_query=TEXT_QUERY)).select("fact_id", "studied_id")


def filter_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of the materials that were typed as the query somewhere, though their entity has another name."""
    return _found(spark, folder, S.FactFilter(material=SPELLING)).select("fact_id", "studied_id", "material")


def filter_place(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder, S.FactFilter(geo=PLACE)).select("fact_id", "studied_id", "location_geo")


def filter_scope(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder, S.FactFilter(geo_scope=" Foreign ")).select("fact_id", "studied_id", "geo_scope")


def filter_expert(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder, S.FactFilter(expert=EXPERT)).select("fact_id", "studied_id", "lab_or_author")


def min_should_match(spark: SparkSession, folder: str) -> DataFrame:
    f = cleaned(spark, folder)
    return f.where(S.text_match([F.col("source_quote")], "содержание меди после обжига", None, 2)).select("fact_id")


def range_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return S.find_facts(normal(spark, folder), S.FactFilter(year_min=1995, year_max=2005)).select("fact_id", "year")


def find_facts(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder, S.FactFilter(**FIND)).select("fact_id", "studied_id", "material", "process", "property", "result_value", "source_file")


def condition_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with a temperature between 40 and 60 °C, whatever unit it is written in."""
    f = S.find_facts(normal(spark, folder), S.FactFilter(parameter="температура", value_min=40, value_max=60, unit="°C"))
    return f.select("fact_id")


def condition_unit(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with any condition in a unit that the registry doesn't know: the texts of the units are compared."""
    f = S.find_facts(normal(spark, folder), S.FactFilter(value_min=0, unit="об/мин"))
    return f.select("fact_id")


def find_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results in bounds and units, with confidence, place and author filters."""
    f = S.find_facts(rows(spark, folder), S.FactFilter.of({"result_unit": "г/л", "result_value_min": "0,01", "result_value_max": 2, "confidence": "HIGH", "geo_scope": "", "extra": 1}))
    return f.select("fact_id", "studied_id", "result_value", "result_unit")


def free_search(spark: SparkSession, folder: str) -> DataFrame:
    n = kept(spark, folder)
    f = S.free_search(joined_rows(n), G.nodes(n), G.edges(n), "ЭЭ", synonyms_of(spark, folder))
    return f.select("fact_id", "studied_id", "matched_entity", "matched_entity_type")


SQL_MENTIONS = f"""ex AS (SELECT fact_id, arg_min(expert, i) AS expert, min(i) AS i FROM (SELECT fact_id, {clean_sql('x')} AS expert, i FROM
    (SELECT fact_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM (SELECT fact_id,
      string_split_regex(replace(replace(replace(lab_or_author, ' и др', chr(1) || 'др'), ' и ', ';'), chr(1) || 'др', ' и др'), '[;,]') AS l FROM nf WHERE lab_or_author IS NOT NULL)))
  WHERE expert IS NOT NULL AND length(expert) >= 2 GROUP BY fact_id, lower(expert)),
ue AS (SELECT equipment FROM nf WHERE equipment IS NOT NULL GROUP BY 1 HAVING count(*) >= {G.EQUIPMENT_LEAST}),
mentions AS (SELECT 'Material' AS node_type, material AS name, material_raw AS spelling, fact_id AS ord FROM nf WHERE material IS NOT NULL
  UNION ALL SELECT 'Process', process, process_raw, fact_id FROM nf WHERE process IS NOT NULL
  UNION ALL SELECT 'Property', property, property_raw, fact_id FROM nf WHERE property IS NOT NULL
  UNION ALL SELECT 'Equipment', equipment, equipment_raw, fact_id FROM nf WHERE equipment IN (SELECT equipment FROM nf JOIN ue USING (equipment) WHERE process IS NOT NULL)
  UNION ALL SELECT 'Expert', expert, expert, fact_id FROM ex
  UNION ALL SELECT 'Document', source_file, source_file, fact_id FROM nf),
nodes AS (SELECT node_type || ':' || name AS node_id, node_type, name, arg_min(spelling, (first, spelling)) AS display_name, list(spelling ORDER BY first, spelling) AS aliases, CAST(sum(n) AS BIGINT) AS mention_count,
    CASE WHEN node_type IN ('Material', 'Process') THEN {_BASE('name')} END AS base, CASE WHEN node_type IN ('Material', 'Process') THEN {_VARIANT('name')} END AS variant,
    CASE WHEN node_type = 'Document' AND contains(name, '__') THEN list_extract(string_split(name, '__'), 1) END AS category
  FROM (SELECT node_type, name, spelling, min(ord) AS first, count(*) AS n FROM mentions GROUP BY ALL) GROUP BY node_type, name)"""
SQL_EDGES = f"""{SQL_MENTIONS},
edges AS (SELECT 'from_document' AS edge_type, 'Material:' || material AS src, 'Document:' || source_file AS dst, fact_id, confidence, geo_scope FROM nf WHERE material IS NOT NULL
  UNION ALL SELECT 'from_document', 'Process:' || process, 'Document:' || source_file, fact_id, confidence, geo_scope FROM nf WHERE process IS NOT NULL
  UNION ALL SELECT 'studied_in', 'Material:' || material, 'Process:' || process, fact_id, confidence, geo_scope FROM nf WHERE material IS NOT NULL AND process IS NOT NULL
  UNION ALL SELECT 'yields', 'Process:' || process, 'Property:' || property, fact_id, confidence, geo_scope FROM nf WHERE process IS NOT NULL AND property IS NOT NULL
  UNION ALL SELECT 'uses_equipment', 'Process:' || process, 'Equipment:' || equipment, fact_id, confidence, geo_scope FROM nf JOIN ue USING (equipment) WHERE process IS NOT NULL
  UNION ALL SELECT 'from_document', 'Expert:' || expert, 'Document:' || source_file, fact_id, confidence, geo_scope FROM nf JOIN ex USING (fact_id)
  UNION ALL SELECT 'expert_in', 'Expert:' || expert, 'Process:' || process, fact_id, confidence, geo_scope FROM nf JOIN ex USING (fact_id) WHERE process IS NOT NULL
  UNION ALL SELECT 'worked_on', 'Expert:' || expert, 'Material:' || material, fact_id, confidence, geo_scope FROM nf JOIN ex USING (fact_id) WHERE material IS NOT NULL)"""


def match_sql(texts: list[str], query: str, synonyms: dict[str, str] | None = None, least: int | None = None) -> str:
    """text_match as SQL."""
    found = []
    for text in texts:
        for variant in S.query_variants(query, synonyms):
            found.append(f"coalesce(contains(lower({text}), {quoted(variant)}), false)")
            words = S.query_words(variant)
            hits = " + ".join("CAST(coalesce(" + " OR ".join(f"contains(lower({text}), {quoted(f)})" for f in S.word_forms(w)) + ", false) AS INTEGER)" for w in words)
            found.append(f"({hits}) >= {len(words) if least is None else min(least, len(words))}")
    return "(" + " OR ".join(found or ["false"]) + ")"


def _nodes_match(query: str, synonyms: dict[str, str] | None = None, base: bool = False) -> str:
    texts = f"list_concat([name, display_name{', base' if base else ''}], aliases)"
    return f"node_type IN ({', '.join(map(quoted, S.FREE_TYPES))}) AND len(list_filter({texts}, lambda t: {match_sql(['t'], query, synonyms)})) > 0"


def named_sql(column: str, query: str) -> str:
    """Whether an entity of a fact row is one of those that were typed, or are named, as query says."""
    return f"{column} IN (SELECT {column} FROM nf WHERE {match_sql([column], query)} OR {match_sql([f'{column}_raw'], query)})"


def conditions_sql(parameter: str | None, low: float | None, high: float | None, unit: str) -> str:
    """CTEs units and hit (fact_id): the facts with a condition that passes. Units are looked up by a join."""
    inside = lambda lo, hi: " AND ".join([f"{hi} >= {low}"] * (low is not None) + [f"{lo} <= {high}"] * (high is not None))
    conv = lambda v: f"({v} * coalesce(k.scale, d.scale) + coalesce(k.shift, d.shift) - w.shift) / w.scale"
    a, b = conv("list_min(l)"), conv("list_max(l)")
    dim, u = "coalesce(k.dim, d.dim)", quoted(" ".join(unit.lower().split()))
    named = f"contains(lower(c.parameter), {quoted(parameter)})" if parameter else "true"
    return f"""{SQL_UNITS}, cond AS (SELECT fact_id, {unit_clean_sql('c.unit')} AS u, {range_sql('c.value')} AS l FROM (SELECT fact_id, unnest(conditions) AS c FROM nf) WHERE {named}),
      hit AS (SELECT DISTINCT fact_id FROM cond LEFT JOIN units k ON k.spelling = cond.u LEFT JOIN units d ON d.spelling = rtrim(cond.u, '.') LEFT JOIN units w ON w.spelling = {u}
        WHERE CASE WHEN {dim} IS NOT NULL AND w.dim IS NOT NULL THEN {dim} = w.dim AND {inside(f'least({a}, {b})', f'greatest({a}, {b})')}
          ELSE (contains(u, {u}) OR contains({u}, u)) AND {inside('list_min(l)', 'list_max(l)')} END)"""


QUERIES = {
    "fact_join_fanout": fact_join_fanout, "fact_rows": fact_rows, "text_match_nodes": text_match_nodes, "semi_join_matched": semi_join_matched, "equipment_two_hop": equipment_two_hop,
    "expert_text_join": expert_text_join, "neighbors": neighbors, "frequent_semi": frequent_semi, "graph_nodes": graph_nodes, "graph_edges": graph_edges, "entity_fold": entity_fold, "degree": degree,
    "count_by_type": count_by_type, "graph_stats": graph_stats, "subgraph": subgraph, "exists": exists, "filter_text_match": filter_text_match, "min_should_match": min_should_match,
    "range_overlap": range_overlap, "find_facts": find_facts, "find_results": find_results, "free_search": free_search, "text_match_words": text_match_words, "filter_spelling": filter_spelling,
    "filter_place": filter_place, "filter_scope": filter_scope, "filter_expert": filter_expert, "condition_filter": condition_filter, "condition_unit": condition_unit, "dashboard": dashboard,
}

_YEAR_IN = f"coalesce(list_max({range_sql('year')}) >= 1995 AND list_min({range_sql('year')}) <= 2005, false)"
_TO = lambda v: f"({v} * coalesce(k.scale, d.scale) + coalesce(k.shift, d.shift) - w.shift) / w.scale"
_SUB = """few AS (SELECT * FROM fr WHERE process = 'электроэкстракция' ORDER BY fact_id, studied_id NULLS FIRST LIMIT 16)"""

SQL = {
    "fact_join_fanout": f"WITH {SQL_ROWS} SELECT fact_id, studied_id FROM fr",
    "fact_rows": f"""WITH {SQL_ROWS}, {SQL_MENTIONS} SELECT fact_id, studied_id, coalesce(nullif(m.display_name, ''), m.name) AS material_name, coalesce(nullif(p.display_name, ''), p.name) AS process_name,
      coalesce(nullif(q.display_name, ''), q.name) AS property_name, result_value FROM fr LEFT JOIN nodes m ON m.node_type = 'Material' AND m.name = fr.material LEFT JOIN nodes p ON p.node_type = 'Process' AND p.name = fr.process
      LEFT JOIN nodes q ON q.node_type = 'Property' AND q.name = fr.property""",
    "text_match_nodes": f"WITH {SQL_NORMAL}, {SQL_MENTIONS} SELECT node_id, node_type FROM nodes WHERE {_nodes_match('ЭЭ', SYNONYMS)}",
    "semi_join_matched": f"""WITH {SQL_ROWS}, {SQL_MENTIONS}, m AS (SELECT node_type, name FROM nodes WHERE {_nodes_match(TEXT_QUERY)})
      SELECT DISTINCT fact_id, CASE WHEN material IN (SELECT name FROM m WHERE node_type = 'Material') THEN 'Material' WHEN process IN (SELECT name FROM m WHERE node_type = 'Process') THEN 'Process' ELSE 'Property' END AS matched FROM fr
      WHERE material IN (SELECT name FROM m WHERE node_type = 'Material') OR process IN (SELECT name FROM m WHERE node_type = 'Process') OR property IN (SELECT name FROM m WHERE node_type = 'Property')""",
    "equipment_two_hop": f"WITH {SQL_NORMAL}, {SQL_EDGES} SELECT src, min(name) AS equipment FROM edges JOIN nodes ON dst = node_id WHERE edge_type = 'uses_equipment' AND node_type = 'Equipment' AND {_nodes_match('чан с мешалкой')} GROUP BY 1",
    "expert_text_join": f"WITH {SQL_NORMAL}, {SQL_MENTIONS} SELECT fact_id, min(expert) AS expert FROM ex JOIN nodes ON node_type = 'Expert' AND name = expert WHERE {_nodes_match('лаборатория обогащения')} GROUP BY 1",
    "neighbors": f"""WITH {SQL_NORMAL}, {SQL_EDGES}, m AS (SELECT node_id FROM nodes WHERE {_nodes_match('ЭЭ', SYNONYMS)})
      SELECT 'out' AS direction, src AS node, dst AS neighbour, edge_type, fact_id FROM edges WHERE src IN (SELECT node_id FROM m) UNION ALL SELECT 'in', dst, src, edge_type, fact_id FROM edges WHERE dst IN (SELECT node_id FROM m)""",
    "frequent_semi": f"WITH {SQL_NORMAL}, {SQL_MENTIONS} SELECT fact_id, equipment FROM nf WHERE process IS NOT NULL AND equipment IN (SELECT equipment FROM ue)",
    "graph_nodes": f"WITH {SQL_NORMAL}, {SQL_MENTIONS} SELECT node_id, node_type, display_name, array_to_string(aliases, ' | ') AS aliases, mention_count, base, variant, category FROM nodes",
    "graph_edges": f"WITH {SQL_NORMAL}, {SQL_EDGES} SELECT * FROM edges",
    "entity_fold": f"WITH {SQL_NORMAL}, {SQL_MENTIONS} SELECT name, display_name, array_to_string(aliases, ' | ') AS aliases, mention_count FROM nodes WHERE node_type = 'Material'",
    "degree": f"WITH {SQL_NORMAL}, {SQL_EDGES} SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1",
    "count_by_type": f"WITH {SQL_NORMAL}, {SQL_EDGES} SELECT 'node ' || node_type AS kind, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'edge ' || edge_type, count(*) FROM edges GROUP BY 1",
    "graph_stats": f"""WITH {SQL_NORMAL} SELECT count(*) AS yields, count(DISTINCT source_file) AS documents, count(*) FILTER (len(conditions) > 0) AS with_conditions, count(year) AS with_year, count(location_geo) AS with_geo,
      count(lab_or_author) AS with_author, count(*) FILTER (confidence = 'high') AS high FROM nf WHERE process IS NOT NULL AND property IS NOT NULL""",
    "subgraph": f"""WITH {SQL_ROWS}, {_SUB}
      SELECT DISTINCT 'node' AS part, c || ':' || b AS a, b, c FROM (SELECT material AS b, 'material' AS c FROM few UNION ALL SELECT process, 'process' FROM few UNION ALL SELECT property, 'property' FROM few
        UNION ALL SELECT source_file, 'document' FROM few UNION ALL SELECT lab_or_author, 'expert' FROM few) WHERE b IS NOT NULL
      UNION ALL SELECT DISTINCT 'edge', a, b, c FROM (SELECT 'material:' || material AS a, 'process:' || process AS b, 'studied_in' AS c FROM few UNION ALL SELECT 'process:' || process, 'property:' || property, 'yields' FROM few
        UNION ALL SELECT 'process:' || process, 'document:' || source_file, 'from_document' FROM few UNION ALL SELECT 'expert:' || lab_or_author, 'process:' || process, 'expert_in' FROM few) WHERE a IS NOT NULL AND b IS NOT NULL""",
    "exists": f"WITH {SQL_ROWS} SELECT fact_id, studied_id FROM fr WHERE {named_sql('material', 'сурьмянистый')}",
    "filter_text_match": f"WITH {SQL_ROWS} SELECT fact_id, studied_id FROM fr WHERE {named_sql('property', TEXT_QUERY)}",
    "filter_spelling": f"WITH {SQL_ROWS} SELECT fact_id, studied_id, material FROM fr WHERE {named_sql('material', SPELLING)}",
    "filter_place": f"WITH {SQL_ROWS} SELECT fact_id, studied_id, location_geo FROM fr WHERE {match_sql(['location_geo'], PLACE)}",
    "filter_scope": f"WITH {SQL_ROWS} SELECT fact_id, studied_id, geo_scope FROM fr WHERE geo_scope = 'foreign'",
    "filter_expert": f"WITH {SQL_ROWS} SELECT fact_id, studied_id, lab_or_author FROM fr WHERE {match_sql(['lab_or_author'], EXPERT)}",
    "text_match_words": f"WITH {SQL_NORMAL}, {SQL_MENTIONS} SELECT node_id, node_type FROM nodes WHERE {_nodes_match('агломерат сурьмянистый', base=True)}",
    "dashboard": f"""WITH {SQL_NORMAL}, {SQL_EDGES} SELECT 'nodes' AS section, node_type AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edges', edge_type, count(*) FROM edges GROUP BY 2
      UNION ALL SELECT 'confidence', coalesce(confidence, 'unknown'), count(*) FROM edges WHERE edge_type = 'yields' GROUP BY 2
      UNION ALL SELECT 'top ' || node_type, name, mention_count FROM (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY mention_count DESC, name) AS no FROM nodes WHERE node_type <> 'Document') WHERE no <= 7""",
    "min_should_match": f"WITH {SQL_CLEAN} SELECT fact_id FROM cf WHERE {match_sql(['source_quote'], 'содержание меди после обжига', None, 2)}",
    "range_overlap": f"WITH {SQL_CLEAN} SELECT fact_id, year FROM cf WHERE {_YEAR_IN}",
    "find_facts": f"""WITH {SQL_ROWS}, {conditions_sql(FIND['parameter'], FIND['value_min'], FIND['value_max'], FIND['unit'])}
      SELECT fact_id, studied_id, material, process, property, result_value, source_file FROM fr WHERE {named_sql('process', FIND['process'])}
      AND coalesce(list_max({range_sql('year')}) >= {FIND['year_min']}, false) AND fact_id IN (SELECT fact_id FROM hit)""",
    "condition_filter": f"WITH {SQL_NORMAL}, {conditions_sql('температура', 40, 60, '°c')} SELECT fact_id FROM nf WHERE fact_id IN (SELECT fact_id FROM hit)",
    "condition_unit": f"WITH {SQL_NORMAL}, {conditions_sql(None, 0, None, 'об/мин')} SELECT fact_id FROM nf WHERE fact_id IN (SELECT fact_id FROM hit)",
    "find_results": f"""WITH {SQL_ROWS}, {SQL_UNITS}, r AS (SELECT fact_id, studied_id, result_value, result_unit, confidence, {range_sql('result_value')} AS l, {unit_clean_sql('result_unit')} AS u FROM fr)
      SELECT fact_id, studied_id, result_value, result_unit FROM r LEFT JOIN units k ON k.spelling = u LEFT JOIN units d ON d.spelling = rtrim(u, '.') JOIN units w ON w.spelling = 'г/л'
      WHERE trim(confidence) = 'high' AND coalesce(k.dim, d.dim) = w.dim AND greatest({_TO('list_min(l)')}, {_TO('list_max(l)')}) >= 0.01 AND least({_TO('list_min(l)')}, {_TO('list_max(l)')}) <= 2""",
    "free_search": f"""WITH {SQL_ROWS}, {SQL_EDGES}, m AS (SELECT node_id, node_type, name FROM nodes WHERE {_nodes_match('ЭЭ', SYNONYMS)}),
      ue2 AS (SELECT substring(src, 9) AS process, min(name) AS e FROM edges JOIN m ON dst = node_id WHERE edge_type = 'uses_equipment' AND node_type = 'Equipment' GROUP BY 1),
      j AS (SELECT fr.*, CASE WHEN material IN (SELECT name FROM m WHERE node_type = 'Material') THEN 'Material' WHEN fr.process IN (SELECT name FROM m WHERE node_type = 'Process') THEN 'Process'
        WHEN property IN (SELECT name FROM m WHERE node_type = 'Property') THEN 'Property' WHEN e IS NOT NULL THEN 'Equipment' WHEN {match_sql(['lab_or_author'], 'ЭЭ', SYNONYMS)} THEN 'Expert' END AS k, e FROM fr LEFT JOIN ue2 ON fr.process = ue2.process)
      SELECT DISTINCT fact_id, studied_id, CASE k WHEN 'Material' THEN material WHEN 'Process' THEN process WHEN 'Property' THEN property WHEN 'Equipment' THEN e ELSE lab_or_author END AS matched_entity, k AS matched_entity_type FROM j WHERE k IS NOT NULL""",
}
