"""Queries of sources and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.functions import text as T
from orelode.functions import units as U
from orelode.functions.numbers import number_range
from orelode.operators.facts import synonym_table, with_canonical
from orelode.plans.base import (
    PAREN, SQL_CLEAN, SQL_NORMAL, SQL_SYNONYMS, clean_sql, cleaned, collapse_sql, geo_sql, normal, paren_base_sql, paren_use_sql, quoted, range_sql, unit_clean_sql, unit_part_sql, unit_sql,
)
from orelode.sources.tables import table

FOLDERS = ("Отчёты", "Патенты", "Статьи")
SIZE_CAP, LEAST_TEXT = 20 * 1024 * 1024, 100


def scan_filter_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest entries whose folder contains one of the allowed names, in the order of their lower-case paths."""
    m = table(spark, folder, "ingest_manifest")
    allowed = F.col("folder").contains(FOLDERS[0]) | F.col("folder").contains(FOLDERS[1]) | F.col("folder").contains(FOLDERS[2])
    return m.where(allowed).select("entry_id", "file", "folder").orderBy(F.lower("folder"), F.lower("file"), "entry_id")


def ingest_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The status that ingestion gives to each entry: too large files and those without a text layer are skipped."""
    m = table(spark, folder, "ingest_manifest")
    size = F.col("text_size")
    failed = F.lower(F.trim("status")) == "error"
    return m.select(
        "entry_id", F.when(failed, "error").when(size.isNull() | (size > SIZE_CAP) | (size < LEAST_TEXT), "skipped").otherwise("ok").alias("status"),
        F.when(failed, F.col("reason")).when(size.isNull(), "no text").when(size > SIZE_CAP, "too large").when(size < LEAST_TEXT, "no text layer").alias("reason"),
    )


def scan_txt_topn(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty texts by lower-case file name: the file limit of the text reader."""
    e = table(spark, folder, "extracted")
    return e.orderBy(F.lower("source_file"), "text_id").limit(20).select("text_id", "source_file", F.length("text").cast("bigint").alias("n_chars"))


def jsonl_scan_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of JSON by kind: object, other value, broken, blank."""
    e = table(spark, folder, "events").select(F.trim("props").alias("line"))
    kind = F.when(F.col("line").isNull() | (F.col("line") == ""), "blank").when(F.schema_of_variant(F.try_parse_json("line")).isNull(), "broken").when(F.col("line").startswith("{"), "object").otherwise("other")
    return e.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def synonym_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Each spelling of a material with its canonical synonym, itself where there is none, and its number of facts."""
    f = cleaned(spark, folder).where("material is not null").groupBy(F.lower("material").alias("spelling")).agg(F.count("*").alias("n"))
    s = synonym_table(table(spark, folder, "synonyms"))
    return f.join(s, F.col("spelling") == s["alias"], "left").select("spelling", F.coalesce("canonical", "spelling").alias("canonical"), "n")


def quality_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "quality_validation")
    return q.groupBy(F.coalesce(F.lower(F.trim("status")), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def safe_name(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "extracted")
    return e.select("text_id", T.safe_name(F.col("source_file")).alias("name"), T.safe_name(F.col("source_file"), 64).alias("id"))


def strip_fences(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as a model gives them, fenced or not, without their fences."""
    d = table(spark, folder, "documents")
    answer = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))).otherwise(F.col("text"))
    return d.select("doc_id", F.md5(T.strip_fences(answer)).alias("digest"))


def null_fold(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "facts")
    return f.select("fact_id", *[T.clean_value(F.col(c)).alias(c) for c in ("material", "process", "location_geo", "lab_or_author")])


def collapse_spaces(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "facts").select("fact_id", T.collapse_spaces(F.col("source_quote")).alias("quote"))


def doc_clean(spark: SparkSession, folder: str) -> DataFrame:
    t = T.doc_clean(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("bigint").alias("n_chars"))


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "extracted").select("text_id", F.posexplode(T.paragraphs(F.col("text"))).alias("i", "p"))
    return p.select("text_id", (F.col("i") + 1).cast("bigint").alias("para_no"), F.md5("p").alias("digest"))


def chunk_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 3,000 characters every 2,700, ending with the window that reaches the end of the text."""
    d = table(spark, folder, "documents").select("doc_id", "text", F.length("text").alias("n")).where("n > 3000")
    starts = F.sequence(F.lit(0), F.ceil((F.col("n") - 3000) / 2700).cast("int"))
    rows = d.select("doc_id", "text", F.posexplode(starts).alias("i", "s"))
    return rows.select("doc_id", (F.col("i") + 1).cast("bigint").alias("chunk_id"), F.md5(F.substring("text", F.col("s") * 2700 + 1, F.lit(3000))).alias("digest"))


def entity_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings of materials with their entity name, its last word as base and the rest as variant."""
    f = cleaned(spark, folder).where("material is not null").select("material").distinct()
    f = with_canonical(f, "material", synonym_table(table(spark, folder, "synonyms")), "name")
    base, variant = T.base_variant(F.col("name"))
    return f.select(F.col("material").alias("spelling"), "name", base.alias("base"), variant.alias("variant"))


def paren_alias(spark: SparkSession, folder: str) -> DataFrame:
    f = cleaned(spark, folder).where("material is not null").select(F.lower("material").alias("name")).distinct()
    base, alias = T.paren_alias(F.col("name"))
    return f.select("name", base.alias("base"), alias.alias("alias"))


def base_variant(spark: SparkSession, folder: str) -> DataFrame:
    f = cleaned(spark, folder).where("process is not null").select(F.lower("process").alias("name")).distinct()
    base, variant = T.base_variant(F.col("name"))
    return f.select("name", base.alias("base"), variant.alias("variant"))


def geo_scope(spark: SparkSession, folder: str) -> DataFrame:
    return cleaned(spark, folder).select("fact_id", T.geo_scope(F.col("location_geo"), F.col("lab_or_author")).alias("scope"))


def split_explode_dedup(spark: SparkSession, folder: str) -> DataFrame:
    f = cleaned(spark, folder).select("fact_id", F.posexplode(T.split_experts(F.col("lab_or_author"))).alias("i", "expert"))
    return f.select("fact_id", "expert")


def year_extract(spark: SparkSession, folder: str) -> DataFrame:
    return cleaned(spark, folder).select("fact_id", "year", T.year(F.col("year")).alias("found"), T.year_text(F.col("year")).alias("kept"))


def document_context(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "extracted").select("text_id", F.md5(T.document_context(F.col("text"))).alias("digest"))


def category(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "facts").select("fact_id", T.category(F.col("source_file")).alias("category"))


def number_ranges(spark: SparkSession, folder: str) -> DataFrame:
    f = cleaned(spark, folder).select("fact_id", number_range(F.col("result_value")).alias("r"))
    return f.select("fact_id", "r.lo", "r.hi")


def unit_clean(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "facts").where("result_unit is not null")
    return f.groupBy(U.clean_unit(F.col("result_unit")).alias("unit")).agg(F.count("*").alias("n"))


def unit_dimension(spark: SparkSession, folder: str) -> DataFrame:
    f = cleaned(spark, folder).where("result_unit is not null").groupBy("result_unit").agg(F.count("*").alias("n"))
    c = U.canonical_unit(F.col("result_unit"))
    return f.select(F.col("result_unit").alias("spelling"), c.alias("unit"), U.dimension(c).alias("dimension"), c.isNotNull().alias("known"), "n")


def unit_convert(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds of each result in the common unit of its dimension, NULL without one."""
    f = cleaned(spark, folder).select("fact_id", number_range(F.col("result_value")).alias("r"), U.canonical_unit(F.col("result_unit")).alias("u")).where("u is not null and r is not null")
    common = U.common_unit(F.col("u"))
    a, b = U.convert(F.col("r.lo"), F.col("u"), common), U.convert(F.col("r.hi"), F.col("u"), common)
    return f.select("fact_id", common.alias("unit"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def split_words(spark: SparkSession, folder: str) -> DataFrame:
    w = table(spark, folder, "facts").select(F.explode(T.split_words(F.col("source_quote"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"))


def stem_words(spark: SparkSession, folder: str) -> DataFrame:
    w = table(spark, folder, "facts").select(F.explode(T.split_words(F.col("material"))).alias("word")).distinct()
    return w.select("word", T.stem(F.col("word")).alias("stem"))


def result_text(spark: SparkSession, folder: str) -> DataFrame:
    return cleaned(spark, folder).select("fact_id", T.result_text(F.col("result_value"), F.col("result_unit")).alias("result"))


def condition_text(spark: SparkSession, folder: str) -> DataFrame:
    return cleaned(spark, folder).select("fact_id", T.condition_text(F.col("conditions")).alias("conditions"))


def condition_points(spark: SparkSession, folder: str) -> DataFrame:
    """Middle of the range of every condition whose parameter contains the text; units are not converted."""
    f = cleaned(spark, folder).select("fact_id", F.posexplode("conditions").alias("i", "c"))
    f = f.where(F.lower("c.parameter").contains("температура")).select("fact_id", (F.col("i") + 1).cast("bigint").alias("slot"), number_range(F.col("c.value")).alias("r"))
    return f.where("r is not null").select("fact_id", "slot", ((F.col("r.lo") + F.col("r.hi")) / 2).alias("middle"))


def compact_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "facts").select("fact_id", T.compact_text(F.col("source_quote"), 60).alias("quote"))


def try_number(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "facts").select("fact_id", T.try_number(F.col("result_value")).alias("number"))


def word_set_signature(spark: SparkSession, folder: str) -> DataFrame:
    f = cleaned(spark, folder).where("material is not null").select("material").distinct()
    return f.select("material", T.word_set(F.col("material")).alias("words"))


def nan_to_null(spark: SparkSession, folder: str) -> DataFrame:
    """Account balances over order counts, with a NaN for customers without an order, as NULL in what goes out."""
    o = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, folder, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    share = F.when(F.col("n").isNull(), F.lit(float("nan"))).otherwise(F.col("c_acctbal") / F.col("n"))
    return c.select("c_custkey", F.when(~F.isnan(share), share).alias("share"))


def bucket_label(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers with three significant digits, as the labels of buckets show them."""
    f = cleaned(spark, folder).select("fact_id", number_range(F.col("result_value")).alias("r")).where("r is not null and r.lo > 0.0001 and r.lo < 100000")
    whole = F.col("r.lo") >= 100
    label = T.format_number(F.col("r.lo"))
    # halves are rounded in either direction by engines, so the text is compared within a unit of the last digit
    return f.select("fact_id", F.when(whole, F.abs(label.cast("double") - F.col("r.lo")) <= 0.5).otherwise(F.abs(label.cast("double") - F.col("r.lo")) <= F.col("r.lo") * 0.00501).alias("close"), label.rlike(r"\.[0-9]*0$").alias("zeros"))


def fact_hash_id(spark: SparkSession, folder: str) -> DataFrame:
    f = normal(spark, folder)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("material", "process", "property", "source_file", "chunk_id", "result_value", "source_quote")]
    return f.select("fact_id", F.left(F.sha1(F.concat_ws("|", *parts)), F.lit(16)).alias("iri"))


EDGE = r"^[_+-]+|[_+-]+$"
_WORDS = lambda x: f"list_filter(list_transform(regexp_extract_all({x}, '[{T.LETTERS}0-9_+-]+'), lambda w: regexp_replace(lower(w), '{EDGE}', '', 'g')), lambda w: length(w) >= 2)"
_STEM = lambda w: "CASE " + " ".join(f"WHEN suffix({w}, {quoted(e)}) THEN CASE WHEN length({w}) - {len(e)} >= 4 THEN left({w}, length({w}) - {len(e)}) ELSE {w} END" for e in T.STEM_ENDINGS) + f" ELSE {w} END"
_PLAIN = lambda x: collapse_sql(rf"regexp_replace({x}, '\([^()]*\)', ' ', 'g')")
_BASE = lambda x: f"list_extract(string_split({_PLAIN(x)}, ' '), -1)"
_VARIANT = lambda x: f"nullif(array_to_string(list_slice(string_split({_PLAIN(x)}, ' '), 1, -2), ' '), '')"
_TRIM = lambda x: f"regexp_replace({x}, '^{T.WS}+|{T.WS}+$', '', 'g')"
DOC_CLEAN_SQL = lambda x: _TRIM(rf"regexp_replace(regexp_replace(replace({x}, chr(0), ''), '[ \t\x{{a0}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
PARAGRAPHS_SQL = lambda x: rf"list_filter(list_transform(regexp_split_to_array({x}, '\n{T.WS}*\n'), lambda p: {_TRIM('p')}), lambda p: p <> '')"
_RESULT = lambda v, u: f"CASE WHEN {v} IS NOT NULL THEN CASE WHEN {u} IS NULL OR contains(lower({v}), lower({u})) THEN {v} ELSE concat_ws(' ', {v}, {u}) END END"
_YEAR = r"(?:^|[^0-9A-Za-zА-Яа-яЁё_])((?:18|19|20)[0-9]{2})(?:[^0-9A-Za-zА-Яа-яЁё_]|$)"

CONDITION_TEXTS = f"""SELECT fact_id, array_to_string(list_slice(list_filter(list_transform(conditions, lambda c: concat_ws(': ', {clean_sql('c.parameter')}, {_RESULT(f'({clean_sql("c.value")})', f'({clean_sql("c.unit")})')})), lambda x: x <> ''), 1, 4), '; ') AS conditions FROM cf"""

QUERIES = {
    "scan_filter_folder": scan_filter_folder, "ingest_manifest": ingest_manifest, "scan_txt_topn": scan_txt_topn, "jsonl_scan_stats": jsonl_scan_stats, "synonym_resolve": synonym_resolve,
    "quality_status_counts": quality_status_counts, "safe_name": safe_name, "strip_fences": strip_fences, "null_fold": null_fold, "collapse_spaces": collapse_spaces, "doc_clean": doc_clean,
    "paragraphs": paragraphs, "chunk_sliding": chunk_sliding, "entity_normalize": entity_normalize, "paren_alias": paren_alias, "base_variant": base_variant, "geo_scope": geo_scope,
    "split_explode_dedup": split_explode_dedup, "year_extract": year_extract, "category": category, "number_range": number_ranges, "unit_clean": unit_clean, "unit_dimension": unit_dimension,
    "unit_convert": unit_convert, "split_words": split_words, "stem_words": stem_words, "result_text": result_text, "condition_text": condition_text, "condition_points": condition_points,
    "compact_text": compact_text, "try_number": try_number, "word_set_signature": word_set_signature, "nan_to_null": nan_to_null, "bucket_label": bucket_label, "fact_hash_id": fact_hash_id, "document_context": document_context,
}

SQL = {
    "scan_filter_folder": f"SELECT entry_id, file, folder FROM ingest_manifest WHERE {' OR '.join(f'contains(folder, {quoted(x)})' for x in FOLDERS)}",
    "ingest_manifest": f"""SELECT entry_id, CASE WHEN lower(trim(status)) = 'error' THEN 'error' WHEN text_size IS NULL OR text_size > {SIZE_CAP} OR text_size < {LEAST_TEXT} THEN 'skipped' ELSE 'ok' END AS status,
      CASE WHEN lower(trim(status)) = 'error' THEN reason WHEN text_size IS NULL THEN 'no text' WHEN text_size > {SIZE_CAP} THEN 'too large' WHEN text_size < {LEAST_TEXT} THEN 'no text layer' END AS reason FROM ingest_manifest""",
    "scan_txt_topn": "SELECT text_id, source_file, CAST(length(text) AS BIGINT) AS n_chars FROM extracted ORDER BY lower(source_file), text_id LIMIT 20",
    "jsonl_scan_stats": """SELECT CASE WHEN props IS NULL OR trim(props) = '' THEN 'blank' WHEN NOT json_valid(props) THEN 'broken' WHEN starts_with(trim(props), '{') THEN 'object' ELSE 'other' END AS kind, count(*) AS n
      FROM events GROUP BY 1""",
    "synonym_resolve": f"WITH {SQL_CLEAN}, {SQL_SYNONYMS} SELECT spelling, coalesce(canonical, spelling) AS canonical, n FROM (SELECT lower(material) AS spelling, count(*) AS n FROM cf WHERE material IS NOT NULL GROUP BY 1) LEFT JOIN syn ON spelling = alias",
    "quality_status_counts": "SELECT coalesce(lower(trim(status)), 'unknown') AS status, count(*) AS n FROM quality_validation GROUP BY 1",
    "safe_name": r"SELECT text_id, nullif(left(regexp_replace(source_file, '[^\p{L}\p{N}]', '_', 'g'), 120), '') AS name, nullif(left(regexp_replace(source_file, '[^\p{L}\p{N}]', '_', 'g'), 64), '') AS id FROM extracted",
    "strip_fences": f"""SELECT doc_id, md5({_TRIM("CASE WHEN len(string_split(a, '```')) >= 3 THEN regexp_replace(list_extract(string_split(a, '```'), 2), '^json', '') ELSE a END")}) AS digest
      FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '```json' || chr(10) || text || chr(10) || '```' ELSE text END AS a FROM documents)""",
    "null_fold": f"SELECT fact_id, {', '.join(f'{clean_sql(c)} AS {c}' for c in ('material', 'process', 'location_geo', 'lab_or_author'))} FROM facts",
    "collapse_spaces": f"SELECT fact_id, {collapse_sql('source_quote')} AS quote FROM facts",
    "doc_clean": f"""WITH d AS (SELECT doc_id, {DOC_CLEAN_SQL('text')} AS t FROM documents)
      SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n_chars FROM d""",
    "paragraphs": rf"""WITH p AS (SELECT text_id, list_filter(list_transform(regexp_split_to_array(text, '\n{T.WS}*\n'), lambda p: {_TRIM('p')}), lambda p: p <> '') AS l FROM extracted)
      SELECT text_id, CAST(i AS BIGINT) AS para_no, md5(p) AS digest FROM (SELECT text_id, unnest(l) AS p, unnest(range(1, len(l) + 1)) AS i FROM p)""",
    "chunk_sliding": """SELECT doc_id, CAST(s + 1 AS BIGINT) AS chunk_id, md5(substring(text, CAST(s * 2700 + 1 AS BIGINT), 3000)) AS digest
      FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil((length(text) - 3000) / 2700.0) AS BIGINT) + 1)) AS s FROM documents WHERE length(text) > 3000)""",
    "entity_normalize": f"""WITH {SQL_CLEAN}, {SQL_SYNONYMS}, n AS (SELECT DISTINCT material AS spelling, {paren_base_sql('coalesce(canonical, lower(material))')} AS name FROM cf LEFT JOIN syn ON lower(material) = alias WHERE material IS NOT NULL)
      SELECT spelling, name, {_BASE('name')} AS base, {_VARIANT('name')} AS variant FROM n""",
    "paren_alias": f"WITH {SQL_CLEAN}, n AS (SELECT DISTINCT lower(material) AS name FROM cf WHERE material IS NOT NULL) SELECT name, {paren_base_sql('name')} AS base, CASE WHEN {paren_use_sql('name')} THEN trim(regexp_extract(name, '{PAREN}', 2)) END AS alias FROM n",
    "base_variant": f"WITH {SQL_CLEAN}, n AS (SELECT DISTINCT lower(process) AS name FROM cf WHERE process IS NOT NULL) SELECT name, {_BASE('name')} AS base, {_VARIANT('name')} AS variant FROM n",
    "geo_scope": f"WITH {SQL_CLEAN} SELECT fact_id, {geo_sql('location_geo', 'lab_or_author')} AS scope FROM cf",
    "split_explode_dedup": f"""WITH {SQL_CLEAN}, l AS (SELECT fact_id, string_split_regex(replace(replace(replace(lab_or_author, ' и др', chr(1) || 'др'), ' и ', ';'), chr(1) || 'др', ' и др'), '[;,]') AS l FROM cf WHERE lab_or_author IS NOT NULL),
      e AS (SELECT fact_id, {clean_sql('x')} AS expert, i FROM (SELECT fact_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM l))
      SELECT fact_id, arg_min(expert, i) AS expert FROM e WHERE expert IS NOT NULL AND length(expert) >= 2 GROUP BY fact_id, lower(expert)""",
    "year_extract": f"WITH {SQL_CLEAN} SELECT fact_id, year, TRY_CAST(regexp_extract(year, '{_YEAR}', 1) AS INTEGER) AS found, coalesce(nullif(regexp_extract(year, '{_YEAR}', 1), ''), year) AS kept FROM cf",
    "document_context": f"""SELECT text_id, md5(left({DOC_CLEAN_SQL('text')}, 500)) AS digest FROM extracted""",
    "category": "SELECT fact_id, CASE WHEN contains(source_file, '__') THEN list_extract(string_split(source_file, '__'), 1) END AS category FROM facts",
    "number_range": f"WITH {SQL_CLEAN}, r AS (SELECT fact_id, {range_sql('result_value')} AS l FROM cf) SELECT fact_id, list_min(l) AS lo, list_max(l) AS hi FROM r",
    "unit_clean": f"SELECT {unit_clean_sql('result_unit')} AS unit, count(*) AS n FROM facts WHERE result_unit IS NOT NULL GROUP BY 1",
    "unit_dimension": f"WITH {SQL_CLEAN}, u AS (SELECT result_unit AS spelling, {unit_sql('result_unit')} AS unit, count(*) AS n FROM cf WHERE result_unit IS NOT NULL GROUP BY 1, 2) SELECT spelling, unit, {unit_part_sql('unit', 0)} AS dimension, unit IS NOT NULL AS known, n FROM u",
    "unit_convert": f"""WITH {SQL_CLEAN}, r AS (SELECT fact_id, {range_sql('result_value')} AS l, {unit_sql('result_unit')} AS u FROM cf),
      c AS (SELECT fact_id, u, list_min(l) * {unit_part_sql('u', 1)} + {unit_part_sql('u', 2)} AS a, list_max(l) * {unit_part_sql('u', 1)} + {unit_part_sql('u', 2)} AS b FROM r WHERE u IS NOT NULL AND len(l) > 0)
      SELECT fact_id, CASE {unit_part_sql('u', 0)} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in U.COMMON.items())} END AS unit, least(a, b) AS lo, greatest(a, b) AS hi FROM c""",
    "split_words": f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS('source_quote')}) AS word FROM facts) GROUP BY 1",
    "stem_words": f"SELECT word, {_STEM('word')} AS stem FROM (SELECT DISTINCT unnest({_WORDS('material')}) AS word FROM facts)",
    "result_text": f"WITH {SQL_CLEAN} SELECT fact_id, {_RESULT('result_value', 'result_unit')} AS result FROM cf",
    "condition_text": f"WITH {SQL_CLEAN} {CONDITION_TEXTS}",
    "condition_points": f"""WITH {SQL_CLEAN}, e AS (SELECT fact_id, unnest(conditions) AS c, unnest(range(1, len(conditions) + 1)) AS i FROM cf),
      r AS (SELECT fact_id, CAST(i AS BIGINT) AS slot, {range_sql('c.value')} AS l FROM e WHERE contains(lower(c.parameter), 'температура'))
      SELECT fact_id, slot, (list_min(l) + list_max(l)) / 2 AS middle FROM r WHERE len(l) > 0""",
    "compact_text": f"SELECT fact_id, CASE WHEN t IS NULL OR t = '' THEN '—' WHEN length(t) > 60 THEN rtrim(left(t, 59)) || '...' ELSE t END AS quote FROM (SELECT fact_id, {collapse_sql('source_quote')} AS t FROM facts)",
    "try_number": "SELECT fact_id, TRY_CAST(replace(trim(result_value), ',', '.') AS DOUBLE) AS number FROM facts",
    "word_set_signature": f"WITH {SQL_CLEAN}, n AS (SELECT DISTINCT material FROM cf WHERE material IS NOT NULL) SELECT material, array_to_string(list_sort(list_distinct(string_split(lower({_PLAIN('material')}), ' '))), ' ') AS words FROM n",
    "nan_to_null": "SELECT c_custkey, c_acctbal / n AS share FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "bucket_label": f"WITH {SQL_CLEAN}, r AS (SELECT fact_id, list_min({range_sql('result_value')}) AS lo FROM cf) SELECT fact_id, true AS close, false AS zeros FROM r WHERE lo > 0.0001 AND lo < 100000",
    "fact_hash_id": f"""WITH {SQL_NORMAL} SELECT fact_id, left(sha1(concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), 'None')" for c in ('material', 'process', 'property', 'source_file', 'chunk_id', 'result_value', 'source_quote'))})), 16) AS iri FROM nf""",
}
