"""Queries of the coverage matrix, the answers and the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.functions.text import base_variant, condition_text, result_text, url_encoded, word_set
from orelode.operators import answers as A
from orelode.operators import graph as G
from orelode.operators import matrix as M
from orelode.operators import search as S
from orelode.operators.facts import fact_rows as joined_rows
from orelode.plans.base import SQL_NORMAL, SQL_ROWS, kept, normal, quoted, range_sql, rows
from orelode.plans.graphs import SQL as GRAPH_SQL
from orelode.plans.graphs import SQL_EDGES, SQL_MENTIONS, match_sql, named_sql
from orelode.plans.graphs import find_facts as found_facts
from orelode.plans.scalars import _BASE, _PLAIN, _RESULT, _VARIANT, CONDITION_TEXTS
from orelode.session import stored
from orelode.sources import sinks
from orelode.sources.tables import table

AXIS = {"кек": "кеки", "шлак": "шлаки", "руда": "руды"}
BRANCHES = (dict(material="криолит"), dict(process="амальгамация"), dict(property_query="потери меди"), dict(result_unit="К", confidence="low"))
IRI = "urn:ore:"
NO_PROCESS = "process not given"
CELL = ("сурьмянистый агломерат", "коллективное осаждение")


def _matrix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return M.matrix(rows(spark, folder))


def top_labels(spark: SparkSession, folder: str) -> DataFrame:
    return M.top_labels(rows(spark, folder), "material", 15)


def gap_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return M.cells(_matrix(spark, folder)[0])


def matrix_cell_state(spark: SparkSession, folder: str) -> DataFrame:
    c = M.all_cells(_matrix(spark, folder)[0])
    return c.select("material", "process", "n", M.cell_state(F.col("n")).alias("state"))


def matrix_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return M.gaps(_matrix(spark, folder)[0])


def matrix_margins(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of rows, columns and the whole in one pass."""
    c = M.cells(_matrix(spark, folder)[0])
    t = c.groupingSets([["material"], ["process"], []], "material", "process").agg(F.sum("n").alias("n"))
    return t.select("material", "process", "n")


def cell_examples(spark: SparkSession, folder: str) -> DataFrame:
    return M.examples(_matrix(spark, folder)[0])


def matrix_pivot(spark: SparkSession, folder: str) -> DataFrame:
    scopes = ["domestic", "foreign", "mixed", "unknown"]
    r = stored(rows(spark, folder).where("material is not null").select(*M.KEY, "geo_scope"), "records")
    r = r.join(M.top_labels(r, "material", 15).select("material"), "material", "left_semi")
    return r.groupBy("material").pivot("geo_scope", scopes).count().na.fill(0)


def condition_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The matrix of materials and the buckets of one condition."""
    return M.condition_matrix(rows(spark, folder), "температура").select("material", "bucket", "low", "high", "n")


def matrix_cell_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The facts behind one cell: the labels of both axes as filters of the fact search."""
    n = kept(spark, folder)
    filters = M.axis_filter("Materials", CELL[0]) | M.axis_filter("process", CELL[1])
    return S.find_facts(joined_rows(n), S.FactFilter(**filters), names=S.spellings(n)).select("fact_id", "studied_id", "material", "process")


def condition_cell_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The facts behind one cell of a condition matrix, by the exact bounds of the bucket."""
    n = kept(spark, folder)
    f = S.FactFilter(material=CELL[0], parameter="температура", value_min=10, value_max=80.5)
    return S.find_facts(joined_rows(n), f, names=S.spellings(n)).select("fact_id", "studied_id")


def experiment_groups(spark: SparkSession, folder: str) -> DataFrame:
    """(material, property, facts, result_values): the results of each material and property side by side, at most twenty distinct ones."""
    n = normal(spark, folder).where("material is not null and property is not null").select("material", "property", "result_value", "result_unit")
    counted = n.groupBy("material", "property").agg(F.count("*").alias("facts"))
    shown = n.select("material", "property", result_text(F.col("result_value"), F.col("result_unit")).alias("r"))
    values = A.first_values(shown, ["material", "property"], "r", 20)
    return counted.join(values, ["material", "property"], "left").select("material", "property", "facts", F.array_join("values", "; ").alias("result_values"))


def axis_rollup(spark: SparkSession, folder: str) -> DataFrame:
    base = base_variant(F.col("material"))[0]
    label = F.coalesce(*[F.when(base == k, v) for k, v in AXIS.items()], base)
    return rows(spark, folder).where("material is not null").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def histogram_bucket(spark: SparkSession, folder: str) -> DataFrame:
    b = M.buckets(M.condition_points(normal(spark, folder), "давление"))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.min("point").alias("least"), F.max("point").alias("most"))


def mode_unit(spark: SparkSession, folder: str) -> DataFrame:
    """The commonest unit of each parameter, the first seen on a tie."""
    c = normal(spark, folder).select("fact_id", F.posexplode("conditions").alias("i", "c")).where("c.unit is not null and c.parameter is not null")
    n = c.groupBy(F.col("c.parameter").alias("parameter"), F.col("c.unit").alias("unit")).agg(F.count("*").alias("n"), F.min(F.struct("fact_id", "i")).alias("first"))
    return n.groupBy("parameter").agg(F.min_by("unit", F.struct(-F.col("n"), F.col("first"))).alias("unit"), F.max("n").alias("n"))


def gap_related(spark: SparkSession, folder: str) -> DataFrame:
    r = rows(spark, folder)
    a, b = r.where("material = 'криолит'"), r.where("process = 'электроэкстракция'")
    u = a.withColumn("branch", F.lit(0)).unionByName(b.withColumn("branch", F.lit(1)))
    return A.keep_first(u, order=("branch", "fact_id", "studied_id")).select("branch", "fact_id", "studied_id")


def quality_score(spark: SparkSession, folder: str) -> DataFrame:
    return normal(spark, folder).select("fact_id", A.quality_score().alias("score"))


def confidence_index(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("confidence")
    points = F.sum(F.when(c == "high", 100).when(c == "medium", 65).when(c == "low", 35).otherwise(0))
    return normal(spark, folder).where("process is not null").groupBy("process").agg(F.floor(points / F.count("*") + 0.5).alias("index"))


def coverage_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with each attribute, and all four scopes, those without rows as 0."""
    y = normal(spark, folder).where("process is not null and property is not null")
    names = {"conditions": F.size("conditions") > 0, "numeric": F.coalesce(F.col("result_value").rlike("[0-9]"), F.lit(False)), "geo": F.col("location_geo").isNotNull(), "author": F.col("lab_or_author").isNotNull()}
    names |= {f"scope {s}": F.col("geo_scope") == s for s in ("domestic", "foreign", "mixed", "unknown")}
    one = y.agg(*[F.count_if(test).alias(n) for n, test in names.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("n")) for n in names])).alias("r")).select("r.*")


def normalize_before_after(spark: SparkSession, folder: str) -> DataFrame:
    n = kept(spark, folder)
    parts = [n.where(F.col(c).isNotNull()).agg(F.lit(c).alias("kind"), F.count("*").alias("mentions"), F.countDistinct(f"{c}_raw").alias("raw"), F.countDistinct(c).alias("canonical")) for c in ("material", "process")]
    return parts[0].unionByName(parts[1])


def merge_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Names that several spellings were merged into, with the thirty that are mentioned most."""
    n = G.nodes(kept(spark, folder)).where("node_type in ('Material', 'Process') and (size(aliases) > 1 or aliases[0] <> name)")
    return n.orderBy(F.desc("mention_count"), "node_type", "name").limit(30).select("node_type", "name", "mention_count", F.size("aliases").cast("bigint").alias("spellings"))


def base_groups(spark: SparkSession, folder: str) -> DataFrame:
    base, variant = base_variant(F.col("process"))
    return normal(spark, folder).where("process is not null").groupBy(base.alias("base"), variant.alias("variant")).agg(F.count("*").alias("n"))


def answer_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return A.metrics(rows(spark, folder))


def methods_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Processes with most facts; facts without one are a group of their own."""
    return A.summary(rows(spark, folder), "process", 8, missing=NO_PROCESS)


def experts_summary(spark: SparkSession, folder: str) -> DataFrame:
    return A.summary(rows(spark, folder), "lab_or_author", 10, tops=(("source_file", 2),))


def geo_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    r = rows(spark, folder).where("location_geo is not null").select("location_geo", "year", "source_file")
    return A.places(stored(r, "places"), 10)


def conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return A.conflicts(rows(spark, folder))


def answer_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Summary and limitations of an answer as rows of text."""
    r = stored(rows(spark, folder).where("process = 'электроэкстракция'"), "answer")
    s = A.summary_text(r, "электроэкстракция").select(F.lit(0).alias("no"), F.col("summary").alias("text"))
    return s.unionByName(A.limitations(r).withColumnRenamed("limitation", "text"))


def gap_rules(spark: SparkSession, folder: str) -> DataFrame:
    return A.gap_rules(rows(spark, folder).where("process = 'электроэкстракция'"))


def confidence_distribution(spark: SparkSession, folder: str) -> DataFrame:
    keys = spark.createDataFrame([("high",), ("medium",), ("low",)], "confidence string")
    n = normal(spark, folder).groupBy("confidence").agg(F.count("*").alias("n"))
    return keys.join(n, "confidence", "left").select("confidence", F.coalesce("n", F.lit(0)).alias("n"))


def top_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Seven entities of each type by mentions, by degree where mentions are missing."""
    n = kept(spark, folder)
    d = G.nodes(n).where("node_type <> 'Document'").join(G.degree(G.edges(n)), "node_id", "left")
    d = d.withColumn("weight", F.coalesce("mention_count", "degree", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("node_type").orderBy(F.desc("weight"), "name"))
    return d.withColumn("no", rank).where("no <= 7").select("node_type", "no", "name", "weight", "degree")


def top_sources(spark: SparkSession, folder: str) -> DataFrame:
    n = normal(spark, folder).groupBy("source_file").agg(F.count("*").alias("n"), F.min("fact_id").alias("first"))
    return n.orderBy(F.desc("n"), "first").limit(10).select("source_file", "n")


def dedup_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    return A.keep_first(rows(spark, folder)).select("fact_id", "studied_id")


def rank_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Every fact row with its rank by quality."""
    return A.ranked(rows(spark, folder)).select("rank", "fact_id", "studied_id", "score")


def topk_per_group(spark: SparkSession, folder: str) -> DataFrame:
    return A.top_values(rows(spark, folder).where("process is not null"), "process", "material", 3)


def evidence_diversified(spark: SparkSession, folder: str) -> DataFrame:
    return A.evidence(rows(spark, folder)).select("pass", "fact_id", "studied_id", "score")


def duplicate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Materials whose names have the same words in another order: likely duplicates, the commoner first."""
    n = G.nodes(kept(spark, folder)).where("node_type = 'Material'").select("name", "mention_count", word_set(F.col("name")).alias("words"))
    a, b = n.select("words", F.col("name").alias("a"), F.col("mention_count").alias("na")), n.select("words", F.col("name").alias("b"), F.col("mention_count").alias("nb"))
    return a.join(b, "words").where("na > nb or na = nb and a < b").select("words", "a", "b", "na", "nb")


def union_dedup(spark: SparkSession, folder: str) -> DataFrame:
    r = rows(spark, folder)
    u = r.where("confidence = 'high'").unionByName(r.where("geo_scope = 'domestic'"))
    return A.keep_first(u, ("material", "process", "property", "result_value", "result_unit", "source_file", "source_quote")).select("fact_id", "studied_id")


def multi_branch_search(spark: SparkSession, folder: str) -> DataFrame:
    """Text branches and filters, ORed: the facts of any branch, each once, from the first branch that has it."""
    n = kept(spark, folder)
    found = A.preset_rows(joined_rows(n), BRANCHES, S.spellings(n))
    return A.keep_first(found, order=("branch", "fact_id", "studied_id")).select("branch", "fact_id", "studied_id")


def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Files that facts name but that no text was taken from."""
    return table(spark, folder, "facts").select("source_file").where("source_file is not null").subtract(table(spark, folder, "extracted").select("source_file"))


def sort_multi_key(spark: SparkSession, folder: str) -> DataFrame:
    best = normal(spark, folder).orderBy(F.desc("confidence"), F.asc_nulls_first("process"), F.asc_nulls_first("material"), "fact_id")
    return best.select("fact_id", "confidence", "process", "material")


def topk_limit(spark: SparkSession, folder: str) -> DataFrame:
    return found_facts(spark, folder).orderBy("fact_id", F.asc_nulls_first("studied_id")).limit(80).select("fact_id", "studied_id")


def latest_status(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "expert_submissions").where("submission_id is not null")
    at = F.struct("submitted_at", "row_id")
    return s.groupBy("submission_id").agg(F.max_by("status", at).alias("status"), F.max_by("row_id", at).alias("row_id"), F.countDistinct("row_id").alias("n"))


def jsonld_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Entity items of the JSON-LD export, without fields that are missing."""
    n = G.nodes(kept(spark, folder)).where("node_type in ('Material', 'Process')")
    item = F.struct(F.concat(F.lit(IRI), url_encoded(F.col("node_id"))).alias("@id"), F.col("node_type").alias("@type"), F.col("display_name").alias("name"), F.array_sort(F.array_distinct("aliases")).alias("alternateName"), F.col("mention_count").alias("mentions"), F.col("variant").alias("variant"))
    return n.select("node_id", F.to_json(item).alias("item"))


def jsonld_fact_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Fact items of the JSON-LD export: the hashed name of each row, and the keys that its item has, in their order."""
    items = sinks.jsonld_facts(rows(spark, folder), IRI)
    return items.select("fact_id", "studied_id", "iri", F.array_join(F.array_sort(F.json_object_keys("item")), ",").alias("keys"))


def fact_preview(spark: SparkSession, folder: str) -> DataFrame:
    """Facts under the headings of a preview, with result and conditions as one text each."""
    n = normal(spark, folder).select("fact_id", "material", "process", result_text(F.col("result_value"), F.col("result_unit")).alias("result"), condition_text(F.col("conditions")).alias("conditions"))
    return sinks.labelled(n, {"fact_id": "no", "material": "Material", "process": "Process", "result": "Result", "conditions": "Conditions", "absent": "Absent"})


def normalisation_report(spark: SparkSession, folder: str) -> DataFrame:
    """(section, name, n): the parts of the normalisation report."""
    return sinks.report_rows(kept(spark, folder)).select("section", "name", "n")


QUERIES = {
    f.__name__: f
    for f in (
        top_labels, gap_matrix, matrix_cell_state, matrix_gaps, matrix_margins, cell_examples, matrix_pivot, axis_rollup, histogram_bucket, mode_unit, gap_related, quality_score, confidence_index, coverage_counts,
        normalize_before_after, merge_groups, base_groups, answer_metrics, methods_summary, experts_summary, geo_breakdown, conflicts, gap_rules, confidence_distribution, top_entities, top_sources, dedup_keep_first,
        rank_facts, topk_per_group, evidence_diversified, duplicate_pairs, union_dedup, multi_branch_search, set_difference, sort_multi_key, topk_limit, latest_status, jsonld_rows,
        condition_matrix, matrix_cell_facts, condition_cell_facts, experiment_groups, answer_summary, jsonld_fact_rows, normalisation_report, fact_preview,
    )
}

_K = "(material, process, property, result_value, result_unit, source_file, chunk_id, source_quote)"
_KEYS = _K.strip("()")
SQL_MATRIX = f"""{SQL_ROWS},
rec AS (SELECT * FROM fr WHERE material IS NOT NULL AND process IS NOT NULL),
rl AS (SELECT material, count(DISTINCT {_K}) AS n FROM rec GROUP BY 1 HAVING count(DISTINCT {_K}) >= 2 ORDER BY n DESC, material LIMIT 15),
rec2 AS (SELECT * FROM rec WHERE material IN (SELECT material FROM rl)),
cl AS (SELECT process, count(DISTINCT {_K}) AS n FROM rec2 GROUP BY 1 HAVING count(DISTINCT {_K}) >= 2 ORDER BY n DESC, process LIMIT 10),
rec3 AS (SELECT * FROM rec2 WHERE process IN (SELECT process FROM cl)),
cells AS (SELECT material, process, count(*) AS n FROM rec3 GROUP BY 1, 2)"""
_SCORE = """(CASE confidence WHEN 'high' THEN 300 WHEN 'medium' THEN 200 WHEN 'low' THEN 100 ELSE 0 END + CASE WHEN source_quote IS NOT NULL THEN 35 ELSE 0 END + CASE WHEN year IS NOT NULL THEN 10 ELSE 0 END
  + CASE WHEN location_geo IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN lab_or_author IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN regexp_matches(result_value, '[0-9]') THEN 8 ELSE 0 END + CASE WHEN len(conditions) > 0 THEN 6 ELSE 0 END)"""
_RANK = "score DESC, source_file NULLS FIRST, material NULLS FIRST, process NULLS FIRST, property NULLS FIRST, fact_id NULLS FIRST, studied_id NULLS FIRST"
_SCORED = f"sc AS (SELECT *, {_SCORE} AS score FROM fr)"


def _tops_sql(source: str, group: str, column: str, limit: int) -> str:
    return f"""SELECT {group}, string_agg({column}, ', ' ORDER BY no) AS top_{column} FROM (SELECT {group}, {column}, row_number() OVER (PARTITION BY {group} ORDER BY count(*) DESC, {column}) AS no
      FROM {source} WHERE {column} IS NOT NULL GROUP BY {group}, {column}) WHERE no <= {limit} GROUP BY {group}"""


def _summary_sql(group: str, limit: int, tops: tuple[tuple[str, int], ...], missing: str | None = None) -> str:
    source = f"(SELECT * REPLACE (coalesce({group}, {quoted(missing)}) AS {group}) FROM sc)" if missing else "sc"
    parts = "".join(f", t_{c} AS ({_tops_sql('g', group, c, n)})" for c, n in tops)
    joins = " ".join(f"LEFT JOIN t_{c} USING ({group})" for c, _ in tops)
    return f"""WITH {SQL_ROWS}, {_SCORED}, g AS (SELECT * FROM {source} WHERE {group} IS NOT NULL),
      t AS (SELECT {group}, count(*) AS facts, count(DISTINCT source_file) AS documents, max(score) AS best_score FROM g GROUP BY 1),
      b AS (SELECT * FROM t ORDER BY facts DESC, best_score DESC, {group} LIMIT {limit}),
      f AS (SELECT {group}, source_file AS best_source, source_quote AS best_quote FROM g QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY {_RANK}) = 1){parts}
      SELECT b.{group}, facts, documents, best_score, best_source, best_quote{''.join(f', top_{c}' for c, _ in tops)} FROM b LEFT JOIN f USING ({group}) {joins}"""


def _keep_sql(source: str, keys: str, order: str, out: str) -> str:
    return f"SELECT {out} FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


_BRANCH_SQL = (
    named_sql("material", "криолит"), named_sql("process", "амальгамация"), named_sql("property", "потери меди"),
    "trim(confidence) = 'low' AND coalesce(contains(lower(trim(result_unit)), 'к') OR contains('к', lower(trim(result_unit))), false)",
)
_TEMPERATURE = f"""cp AS (SELECT r.*, (list_min(l) + list_max(l)) / 2 AS point FROM (SELECT * EXCLUDE (c), {range_sql('c.value')} AS l FROM (SELECT *, unnest(conditions) AS c FROM fr WHERE material IS NOT NULL) WHERE contains(lower(c.parameter), 'температура')) r WHERE len(l) > 0)"""

SQL = {
    "top_labels": f"WITH {SQL_ROWS} SELECT material, count(DISTINCT {_K}) AS n FROM fr WHERE material IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_K}) >= 2 ORDER BY n DESC, material LIMIT 15",
    "gap_matrix": f"WITH {SQL_MATRIX} SELECT * FROM cells",
    "matrix_cell_state": f"""WITH {SQL_MATRIX} SELECT r.material, c.process, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n <= 2 THEN 'single' WHEN n <= 5 THEN 'partial' ELSE 'covered' END AS state
      FROM (SELECT DISTINCT material FROM cells) r CROSS JOIN (SELECT DISTINCT process FROM cells) c LEFT JOIN cells USING (material, process)""",
    "matrix_gaps": f"""WITH {SQL_MATRIX}, r AS (SELECT material, CAST(sum(n) AS BIGINT) AS row_total FROM cells GROUP BY 1), c AS (SELECT process, CAST(sum(n) AS BIGINT) AS column_total FROM cells GROUP BY 1)
      SELECT material, process, row_total, column_total, row_total * column_total AS interest FROM r CROSS JOIN c ANTI JOIN cells USING (material, process)""",
    "matrix_margins": f"WITH {SQL_MATRIX} SELECT material, process, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY GROUPING SETS ((material), (process), ())",
    "cell_examples": f"""WITH {SQL_MATRIX}, e AS (SELECT material, process, concat_ws(': ', source_file, source_quote) AS example, min(fact_id) AS first FROM rec3 GROUP BY 1, 2, 3)
      SELECT material, process, example, CAST(no AS INTEGER) AS no FROM (SELECT *, row_number() OVER (PARTITION BY material, process ORDER BY first, example) AS no FROM e) WHERE no <= 3""",
    "matrix_pivot": f"""WITH {SQL_ROWS}, l AS (SELECT material, count(DISTINCT {_K}) AS n FROM fr WHERE material IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_K}) >= 2 ORDER BY n DESC, material LIMIT 15)
      SELECT material, {', '.join(f"count(*) FILTER (geo_scope = '{s}') AS {s}" for s in ('domestic', 'foreign', 'mixed', 'unknown'))} FROM fr WHERE material IN (SELECT material FROM l) GROUP BY 1""",
    "axis_rollup": f"""WITH {SQL_ROWS}, b AS (SELECT {_BASE('material')} AS base FROM fr WHERE material IS NOT NULL)
      SELECT CASE base {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in AXIS.items())} ELSE base END AS label, count(*) AS n FROM b GROUP BY 1""",
    "histogram_bucket": f"""WITH {SQL_NORMAL}, c AS (SELECT unnest(conditions) AS c FROM nf), r AS (SELECT {range_sql('c.value')} AS l FROM c WHERE contains(lower(c.parameter), 'давление')),
      p AS (SELECT (list_min(l) + list_max(l)) / 2 AS point FROM r WHERE len(l) > 0),
      b AS (SELECT min(point) AS low, max(point) AS high, CASE WHEN count(*) <= 1 THEN 1 ELSE greatest(5, least(8, CAST(round_even(sqrt(count(*)), 0) AS INTEGER))) END AS k FROM p),
      i AS (SELECT point, CAST(CASE WHEN (high - low) / k > 0 THEN least(floor((point - low) / ((high - low) / k)), k - 1) ELSE 0 END AS INTEGER) AS bucket FROM p CROSS JOIN b)
      SELECT bucket, count(*) AS n, min(point) AS least, max(point) AS most FROM i GROUP BY 1""",
    "mode_unit": f"""WITH {SQL_NORMAL}, c AS (SELECT fact_id, unnest(conditions) AS c, unnest(range(1, len(conditions) + 1)) AS i FROM nf),
      n AS (SELECT c.parameter AS parameter, c.unit AS unit, count(*) AS n, min((fact_id, i)) AS first FROM c WHERE c.unit IS NOT NULL AND c.parameter IS NOT NULL GROUP BY 1, 2)
      SELECT parameter, unit, n FROM n QUALIFY row_number() OVER (PARTITION BY parameter ORDER BY n DESC, first) = 1""",
    "gap_related": f"""WITH {SQL_ROWS}, u AS (SELECT *, 0 AS branch FROM fr WHERE material = 'криолит' UNION ALL SELECT *, 1 FROM fr WHERE process = 'электроэкстракция')
      {_keep_sql('u', _KEYS, 'branch, fact_id, studied_id NULLS FIRST', 'branch, fact_id, studied_id')}""",
    "quality_score": f"WITH {SQL_NORMAL} SELECT fact_id, {_SCORE} AS score FROM nf",
    "confidence_index": f"WITH {SQL_NORMAL} SELECT process, CAST(floor(sum(CASE confidence WHEN 'high' THEN 100 WHEN 'medium' THEN 65 WHEN 'low' THEN 35 ELSE 0 END) / count(*) + 0.5) AS BIGINT) AS index FROM nf WHERE process IS NOT NULL GROUP BY 1",
    "coverage_counts": f"""WITH {SQL_NORMAL}, y AS (SELECT * FROM nf WHERE process IS NOT NULL AND property IS NOT NULL)
      SELECT 'conditions' AS metric, count(*) FILTER (len(conditions) > 0) AS n FROM y UNION ALL SELECT 'numeric', count(*) FILTER (regexp_matches(result_value, '[0-9]')) FROM y
      UNION ALL SELECT 'geo', count(location_geo) FROM y UNION ALL SELECT 'author', count(lab_or_author) FROM y
      {' '.join(f"UNION ALL SELECT 'scope {s}', count(*) FILTER (geo_scope = '{s}') FROM y" for s in ('domestic', 'foreign', 'mixed', 'unknown'))}""",
    "normalize_before_after": f"""WITH {SQL_NORMAL} SELECT 'material' AS kind, count(material) AS mentions, count(DISTINCT material_raw) AS raw, count(DISTINCT material) AS canonical FROM nf
      UNION ALL SELECT 'process', count(process), count(DISTINCT process_raw), count(DISTINCT process) FROM nf""",
    "merge_groups": f"""WITH {SQL_NORMAL}, {SQL_MENTIONS} SELECT node_type, name, mention_count, CAST(len(aliases) AS BIGINT) AS spellings FROM nodes WHERE node_type IN ('Material', 'Process') AND (len(aliases) > 1 OR aliases[1] <> name)
      ORDER BY mention_count DESC, node_type, name LIMIT 30""",
    "base_groups": f"WITH {SQL_NORMAL} SELECT {_BASE('process')} AS base, {_VARIANT('process')} AS variant, count(*) AS n FROM nf WHERE process IS NOT NULL GROUP BY 1, 2",
    "answer_metrics": f"""WITH {SQL_ROWS}, y AS (SELECT *, TRY_CAST(regexp_extract(year, '^([0-9]{{4}})$', 1) AS INTEGER) AS y FROM fr)
      SELECT count(*) AS facts, count(DISTINCT source_file) AS documents, count(DISTINCT y) AS years, count(DISTINCT location_geo) AS places, count(DISTINCT lab_or_author) AS authors, min(y) AS first_year, max(y) AS last_year,
      {', '.join(f"count(*) FILTER (confidence = '{c}') AS {c}" for c in ('high', 'medium', 'low'))} FROM y""",
    "methods_summary": _summary_sql("process", 8, (("material", 3), ("property", 3)), NO_PROCESS),
    "experts_summary": _summary_sql("lab_or_author", 10, (("source_file", 2),)),
    "geo_breakdown": f"""WITH {SQL_ROWS} SELECT location_geo, count(*) AS facts, count(DISTINCT source_file) AS documents, min(TRY_CAST(regexp_extract(year, '^([0-9]{{4}})$', 1) AS INTEGER)) AS first_year,
      max(TRY_CAST(regexp_extract(year, '^([0-9]{{4}})$', 1) AS INTEGER)) AS last_year FROM fr WHERE location_geo IS NOT NULL GROUP BY 1 ORDER BY facts DESC, location_geo LIMIT 10""",
    "conflicts": f"""WITH {SQL_ROWS}, {_SCORED}, r AS (SELECT *, (material, process, property) AS grp FROM sc WHERE material IS NOT NULL AND process IS NOT NULL AND property IS NOT NULL),
      g AS (SELECT grp, material, process, property, count(*) AS facts, list_sort(list(DISTINCT result_value) FILTER (result_value IS NOT NULL)) AS v, list_sort(list(DISTINCT direction) FILTER (direction IS NOT NULL)) AS d FROM r GROUP BY 1, 2, 3, 4),
      b AS (SELECT * FROM g WHERE len(v) > 1 OR len(d) > 1 ORDER BY facts DESC, material, process, property LIMIT 12),
      q AS (SELECT grp, source_quote AS best_quote FROM r WHERE grp IN (SELECT grp FROM b) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {_RANK}) = 1),
      s AS ({_tops_sql('r', 'grp', 'source_file', 4)})
      SELECT material, process, property, facts, array_to_string(list_slice(v, 1, 8), '; ') AS result_values, array_to_string(list_slice(d, 1, 6), '; ') AS directions, top_source_file AS sources, best_quote
      FROM b LEFT JOIN q USING (grp) LEFT JOIN s USING (grp)""",
    "condition_matrix": f"""WITH {SQL_ROWS}, {_TEMPERATURE}, l AS (SELECT material FROM cp GROUP BY 1 HAVING count(DISTINCT {_K}) >= 2 ORDER BY count(DISTINCT {_K}) DESC, material LIMIT 15),
      p AS (SELECT material, point FROM cp WHERE material IN (SELECT material FROM l)),
      e AS (SELECT min(point) AS lo, max(point) AS hi, CASE WHEN count(*) <= 1 THEN 1 ELSE greatest(5, least(8, CAST(round_even(sqrt(count(*)), 0) AS INTEGER))) END AS k FROM p),
      i AS (SELECT material, lo, hi, k, (hi - lo) / k AS w, CAST(CASE WHEN (hi - lo) / k > 0 THEN least(floor((point - lo) / ((hi - lo) / k)), k - 1) ELSE 0 END AS INTEGER) AS bucket FROM p CROSS JOIN e)
      SELECT material, bucket, lo + bucket * w AS low, CASE WHEN bucket = k - 1 THEN hi ELSE lo + (bucket + 1) * w END AS high, count(*) AS n FROM i GROUP BY ALL""",
    "matrix_cell_facts": f"WITH {SQL_ROWS} SELECT fact_id, studied_id, material, process FROM fr WHERE {named_sql('material', CELL[0])} AND {named_sql('process', CELL[1])}",
    "condition_cell_facts": f"""WITH {SQL_ROWS} SELECT fact_id, studied_id FROM fr WHERE {named_sql('material', CELL[0])}
      AND len(list_filter(conditions, lambda c: contains(lower(c.parameter), 'температура') AND list_max({range_sql('c.value')}) >= 10 AND list_min({range_sql('c.value')}) <= 80.5)) > 0""",
    "experiment_groups": f"""WITH {SQL_NORMAL}, e AS (SELECT material, property, {_RESULT('result_value', 'result_unit')} AS r FROM nf WHERE material IS NOT NULL AND property IS NOT NULL)
      SELECT material, property, count(*) AS facts, array_to_string(list_slice(list_sort(list(DISTINCT r) FILTER (r IS NOT NULL)), 1, 20), '; ') AS result_values FROM e GROUP BY 1, 2""",
    "answer_summary": f"""WITH {SQL_ROWS}, a AS (SELECT *, TRY_CAST(regexp_extract(year, '^([0-9]{{4}})$', 1) AS INTEGER) AS y FROM fr WHERE process = 'электроэкстракция'),
      m AS (SELECT count(*) AS n, count(DISTINCT source_file) AS d, min(y) AS y1, max(y) AS y2, count(DISTINCT location_geo) AS g FROM a)
      SELECT 0 AS no, CASE WHEN n = 0 THEN 'no facts found: widen the corpus or loosen the filters' ELSE n || ' facts from ' || d || ' documents' || CASE WHEN y1 IS NULL THEN '' ELSE ', years ' || y1 || '-' || y2 END
        || CASE WHEN g > 0 THEN ', places: ' || g ELSE '' END || '; processes: электроэкстракция' END AS text FROM m
      UNION ALL SELECT i, l FROM (VALUES {', '.join(f'({i}, {quoted(x)})' for i, x in enumerate(A.LIMITATIONS, 1))}) v(i, l) UNION ALL SELECT 4, {quoted(A.NO_FACTS)} FROM m WHERE n = 0""",
    "jsonld_fact_rows": f"""WITH {SQL_ROWS} SELECT fact_id, studied_id, '{IRI}fact:' || left(sha1(concat_ws('|', coalesce('Material:' || material, 'None'), 'Process:' || process, 'Property:' || property, coalesce(result_value, 'None'), source_file,
        coalesce(CAST(chunk_id AS VARCHAR), 'None'), coalesce(source_quote, 'None'))), 16) AS iri,
      array_to_string(list_sort(list_filter(['@id', '@type', 'name', CASE WHEN material IS NOT NULL THEN 'material' END, 'process', 'property', 'derivedFrom', CASE WHEN result_value IS NOT NULL THEN 'value' END, CASE WHEN result_unit IS NOT NULL THEN 'unit' END,
        CASE WHEN direction IS NOT NULL THEN 'direction' END, CASE WHEN confidence IS NOT NULL THEN 'confidence' END, 'sourceFile', CASE WHEN source_quote IS NOT NULL THEN 'sourceQuote' END, CASE WHEN year IS NOT NULL THEN 'year' END,
        CASE WHEN location_geo IS NOT NULL THEN 'locationGeo' END, 'geoScope', CASE WHEN lab_or_author IS NOT NULL THEN 'expert' END, CASE WHEN equipment IS NOT NULL THEN 'equipment' END, CASE WHEN len(conditions) > 0 THEN 'conditions' END], lambda x: x IS NOT NULL)), ',') AS keys FROM fr""",
    "fact_preview": f"""WITH {SQL_NORMAL}, p AS ({CONDITION_TEXTS}) SELECT nf.fact_id AS no, material AS Material, process AS Process, {_RESULT('result_value', 'result_unit')} AS Result, p.conditions AS Conditions FROM nf JOIN p USING (fact_id)""",
    "normalisation_report": f"""WITH {SQL_NORMAL}, {SQL_EDGES}, e AS (SELECT 'material' AS kind, material AS name, material_raw AS raw FROM nf WHERE material IS NOT NULL UNION ALL SELECT 'process', process, process_raw FROM nf WHERE process IS NOT NULL)
      SELECT kind || ' mentions' AS section, NULL AS name, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT kind || ' raw', NULL, count(DISTINCT raw) FROM e GROUP BY 1 UNION ALL SELECT kind || ' canonical', NULL, count(DISTINCT name) FROM e GROUP BY 1
      UNION ALL SELECT 'base group', {_BASE('name')} || CASE WHEN {_VARIANT('name')} IS NOT NULL THEN ': ' || {_VARIANT('name')} ELSE '' END, count(*) FROM e WHERE kind = 'process' GROUP BY 2
      UNION ALL SELECT 'nodes', node_type, count(*) FROM nodes GROUP BY 2 UNION ALL SELECT 'edges', edge_type, count(*) FROM edges GROUP BY 2""",
    "gap_rules": f"""WITH {SQL_ROWS}, s AS (SELECT count(*) AS n, count(DISTINCT source_file) AS docs, count(year) AS year, count(location_geo) AS geo, count(lab_or_author) AS author,
        count(*) FILTER (regexp_matches(result_value, '[0-9]')) AS numeric, count(source_quote) AS quotes, greatest(2, count(*) // 5) AS fifth FROM fr WHERE process = 'электроэкстракция'),
      r AS (SELECT 'documents' AS rule, docs AS found, CAST(3 AS BIGINT) AS needed FROM s WHERE docs < 3 UNION ALL SELECT 'year', year, fifth FROM s WHERE year < fifth UNION ALL SELECT 'geo', geo, fifth FROM s WHERE geo < fifth
        UNION ALL SELECT 'author', author, fifth FROM s WHERE author < fifth UNION ALL SELECT 'numeric', numeric, fifth FROM s WHERE numeric < fifth UNION ALL SELECT 'quotes', quotes, n FROM s WHERE quotes < n)
      SELECT * FROM r UNION ALL SELECT CASE WHEN n = 0 THEN 'empty' ELSE 'none' END, n, 0 FROM s WHERE NOT EXISTS (SELECT 1 FROM r)""",
    "confidence_distribution": f"WITH {SQL_NORMAL} SELECT k AS confidence, count(fact_id) AS n FROM (SELECT unnest(['high', 'medium', 'low']) AS k) LEFT JOIN nf ON confidence = k GROUP BY 1",
    "top_entities": f"""WITH {SQL_NORMAL}, {SQL_EDGES}, d AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)
      SELECT node_type, CAST(no AS INTEGER) AS no, name, weight, degree FROM (SELECT *, coalesce(mention_count, degree, 0) AS weight, row_number() OVER (PARTITION BY node_type ORDER BY coalesce(mention_count, degree, 0) DESC, name) AS no
        FROM nodes LEFT JOIN d USING (node_id) WHERE node_type <> 'Document') WHERE no <= 7""",
    "top_sources": f"WITH {SQL_NORMAL} SELECT source_file, count(*) AS n FROM nf GROUP BY 1 ORDER BY n DESC, min(fact_id) LIMIT 10",
    "dedup_keep_first": f"WITH {SQL_ROWS} {_keep_sql('fr', _KEYS, 'fact_id, studied_id NULLS FIRST', 'fact_id, studied_id')}",
    "rank_facts": f"WITH {SQL_ROWS}, {_SCORED} SELECT CAST(row_number() OVER (ORDER BY {_RANK}) AS BIGINT) AS rank, fact_id, studied_id, score FROM sc",
    "topk_per_group": f"""WITH {SQL_ROWS} SELECT process, material, n, CAST(no AS INTEGER) AS no FROM (SELECT process, material, count(*) AS n, row_number() OVER (PARTITION BY process ORDER BY count(*) DESC, material) AS no
      FROM fr WHERE material IS NOT NULL GROUP BY 1, 2) WHERE no <= 3""",
    "evidence_diversified": f"""WITH {SQL_ROWS}, {_SCORED}, r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source_file ORDER BY {_RANK}) = 1 THEN 0 ELSE 1 END AS pass FROM sc)
      SELECT pass, fact_id, studied_id, score FROM r ORDER BY pass, {_RANK} LIMIT 50""",
    "duplicate_pairs": f"""WITH {SQL_NORMAL}, {SQL_MENTIONS}, w AS (SELECT name, mention_count AS n, array_to_string(list_sort(list_distinct(string_split(lower({_PLAIN('name')}), ' '))), ' ') AS words FROM nodes WHERE node_type = 'Material')
      SELECT x.words, x.name AS a, y.name AS b, x.n AS na, y.n AS nb FROM w x JOIN w y ON x.words = y.words WHERE x.n > y.n OR (x.n = y.n AND x.name < y.name)""",
    "union_dedup": f"""WITH {SQL_ROWS}, u AS (SELECT * FROM fr WHERE confidence = 'high' UNION ALL SELECT * FROM fr WHERE geo_scope = 'domestic')
      {_keep_sql('u', 'material, process, property, result_value, result_unit, source_file, source_quote', 'fact_id, studied_id NULLS FIRST', 'fact_id, studied_id')}""",
    "multi_branch_search": f"""WITH {SQL_ROWS}, u AS ({' UNION ALL '.join(f'SELECT *, {i} AS branch FROM fr WHERE {b}' for i, b in enumerate(_BRANCH_SQL))})
      {_keep_sql('u', _KEYS, 'branch, fact_id, studied_id NULLS FIRST', 'branch, fact_id, studied_id')}""",
    "set_difference": "SELECT source_file FROM facts WHERE source_file IS NOT NULL EXCEPT SELECT source_file FROM extracted",
    "sort_multi_key": f"WITH {SQL_NORMAL} SELECT fact_id, confidence, process, material FROM nf ORDER BY confidence DESC NULLS LAST, process NULLS FIRST, material NULLS FIRST, fact_id",
    "latest_status": "SELECT submission_id, status, row_id, n FROM (SELECT submission_id, status, row_id, count(*) OVER (PARTITION BY submission_id) AS n, row_number() OVER (PARTITION BY submission_id ORDER BY submitted_at DESC NULLS LAST, row_id DESC) AS k FROM expert_submissions WHERE submission_id IS NOT NULL) WHERE k = 1",
    "jsonld_rows": f"""WITH {SQL_NORMAL}, {SQL_MENTIONS} SELECT node_id, '{{"@id":' || to_json('{IRI}' || url_encode(node_id)) || ',"@type":' || to_json(node_type) || ',"name":' || to_json(display_name) || ',"alternateName":' || to_json(list_sort(list_distinct(aliases)))
      || ',"mentions":' || mention_count || CASE WHEN variant IS NOT NULL THEN ',"variant":' || to_json(variant) ELSE '' END || '}}' AS item FROM nodes WHERE node_type IN ('Material', 'Process')""",
}
SQL["topk_limit"] = f"SELECT fact_id, studied_id FROM ({GRAPH_SQL['find_facts']}) ORDER BY fact_id, studied_id NULLS FIRST LIMIT 80"
