"""Exact copies hidden by formatting: canonical records are range-partitioned, sorted, and compared with their neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.session import stored
from orelode.sources.tables import table

# White space and invisible characters, and all punctuation but signs inside numbers: a point, comma, colon or slash
# directly between digits, a dash between digits, a minus before a digit at the start, after a blank or a bracket.
BLANK = r"\s ­  -‍    ⁠　﻿"
BLANKS = f"[{BLANK}]+"
FORM = r" |[\p{P}&&[^.,:/\-]]+|[.,:/](?!(?<=\d.)\d)|-(?!(?<=\d ?-) ?\d)(?!(?<=(?:^|[ (\[«“\"])-)\d)"
END = "\u0001"
MISSING = "\u0000"


def canonical(text: Column) -> Column:
    """text without case, white space and punctuation; dashes alike, signs inside numbers kept; NULL stays apart."""
    one_dash = F.translate(F.lower(text), "‐‑‒–—―−", "-------")
    return F.coalesce(F.regexp_replace(F.regexp_replace(one_dash, BLANKS, " "), FORM, ""), F.lit(MISSING))


def record_key(unordered: list[str], ordered: list[str]) -> Column:
    """The full key of a record: the unordered fields sorted, then the others."""
    first = F.array_sort(F.array(*[canonical(F.col(c)) for c in unordered]))
    return F.concat_ws(END, first, *[canonical(F.col(c)) for c in ordered])


RUNS = "pid int, kind string, first long, id long, lead boolean, key string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in a sorted partition, over the borders of its batches.

    kind "row": a member id with the first id of its run; lead marks the first run of the partition, whose first row is
    among the rows too, as it may go on from the partition before. kind "edge": the first and the last key.
    """
    pid = TaskContext.get().partitionId()
    last = start = first_key = None
    lead = True
    schema = pa.schema([("pid", pa.int32()), ("kind", pa.string()), ("first", pa.int64()), ("id", pa.int64()), ("lead", pa.bool_()), ("key", pa.string())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, ids = batch.column(0), batch.column(1)
        same = pc.equal(keys.slice(1), keys.slice(0, n - 1)).to_pylist() if n > 1 else []
        rows, head = [], keys[0].as_py()
        if last is None:
            first_key = head
        same = [head == last, *same]
        for i, j in enumerate(ids.to_pylist()):
            if same[i]:
                rows.append((pid, "row", start, j, lead, None))
            else:
                if last is not None or i:
                    lead = False
                start = j
                if lead:
                    rows.append((pid, "row", start, j, True, None))
        last = keys[n - 1].as_py()
        if rows:
            yield out(rows)
    if last is not None:
        yield out([(pid, "edge", start, None, lead, first_key), (pid, "last", start, None, lead, last)])


def copies(df: DataFrame, key: Column, id_column: str) -> DataFrame:
    """(id_a, id_b): each row of df but the first of its group of equal keys, with the smallest id of the group.

    Rows are range-partitioned by key and id, so that a group of any size is spread over as many partitions as it fills;
    runs that go over the border of partitions are joined by the first and last key of each partition, the only rows the
    driver sees, two a partition. Rows whose key is NULL take no part. Ids are unique; an empty table gives no rows.
    """
    # stored, as the borders of the ranges are drawn from the keys before these are sorted
    keyed = stored(df.select(key.alias("key"), F.col(id_column).cast("bigint").alias("id")).where("key is not null"), "keys")
    runs = stored(keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(_scan, RUNS), "copies")
    edges: dict[int, dict] = {}
    for r in runs.where("kind <> 'row'").collect():
        edges.setdefault(r["pid"], {})[r["kind"]] = r
    carried, before, start = [], None, None
    for pid in sorted(edges):
        first, last = edges[pid]["edge"], edges[pid]["last"]
        goes_on = before is not None and first["key"] == before
        if goes_on:
            carried.append((pid, start))
        if not (goes_on and last["lead"]):
            start = last["first"]
        before = last["key"]
    spark = df.sparkSession
    links = F.broadcast(spark.createDataFrame(carried, "pid int, carried long"))  # one row a partition at most
    rows = runs.where("kind = 'row'").join(links, "pid", "left")
    rows = rows.select(F.when(F.col("lead"), F.coalesce("carried", "first")).otherwise(F.col("first")).alias("id_a"), F.col("id").alias("id_b"))
    return rows.where("id_a <> id_b")


def representatives(df: DataFrame, key: Column, id_column: str) -> DataFrame:
    """One row for each group of copies, the one with the smallest id, with the number of its copies as ``copies``.

    Rows whose key is NULL stand for themselves. A column of df named ``copies`` is replaced.
    """
    pairs = copies(df, key, id_column)
    counts = pairs.groupBy(F.col("id_a").alias("_id")).agg((F.count("*") + 1).alias("_n"))
    others = pairs.select(F.col("id_b").alias("_id"), F.lit(True).alias("_copy"))
    marks = counts.withColumn("_copy", F.lit(False)).unionByName(others.withColumn("_n", F.lit(0).cast("bigint")))
    joined = df.join(marks, F.col(id_column) == F.col("_id"), "left").where(~F.coalesce(F.col("_copy"), F.lit(False)))
    return joined.withColumn("copies", F.coalesce("_n", F.lit(1).cast("bigint"))).drop("_id", "_n", "_copy")


def fact_key() -> Column:
    """Key of a fact; NULL, so that the row takes no part, where the quote is NULL."""
    return F.when(F.col("source_quote").isNotNull(), record_key(["material", "process"], ["source_quote", "result_property", "result_value"]))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = copies(table(spark, folder, "facts"), fact_key(), "fact_id")
    return pairs.select(F.col("id_a").alias("fact_id_a"), F.col("id_b").alias("fact_id_b"))


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record of each group of copies with their number."""
    facts = representatives(table(spark, folder, "facts"), fact_key(), "fact_id")
    return facts.select("fact_id", "material", "process", "source_quote", "result_property", "result_value", "copies")


QUERIES = {"p2_found": p2_found, "p2_records": p2_records}

_BLANK = r"\s\x{a0}\x{ad}\x{1680}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}"


def _canonical_sql(x: str) -> str:
    """canonical as SQL without lookaround: kept signs become control characters first, twice, as neighbours share digits."""
    t = f"regexp_replace(translate(lower({x}), '‐‑‒–—―−', '-------'), '[{_BLANK}]+', ' ', 'g')"
    for i, sign in enumerate(".,:/", 1):
        for _ in range(2):
            t = rf"regexp_replace({t}, '(\d)[{sign}](\d)', '\1' || chr({i}) || '\2', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '(\d) ?- ?(\d)', '\1' || chr(5) || '\2', 'g')"
    t = rf"""regexp_replace({t}, '(^|[ (\[«“"])-(\d)', '\1' || chr(6) || '\2', 'g')"""
    return rf"coalesce(regexp_replace({t}, ' |\p{{P}}', '', 'g'), chr(7))"


_KEYED = f"""k AS (SELECT *, list_sort([{_canonical_sql('material')}, {_canonical_sql('process')}]) AS a, {_canonical_sql('source_quote')} AS q, {_canonical_sql('result_property')} AS p,
  {_canonical_sql('result_value')} AS v FROM facts WHERE source_quote IS NOT NULL),
m AS (SELECT *, min(fact_id) OVER (PARTITION BY a, q, p, v) AS first, count(*) OVER (PARTITION BY a, q, p, v) AS copies FROM k)"""
SQL = {
    "p2_found": f"WITH {_KEYED} SELECT first AS fact_id_a, fact_id AS fact_id_b FROM m WHERE fact_id <> first",
    "p2_records": f"""WITH {_KEYED} SELECT fact_id, material, process, source_quote, result_property, result_value, copies FROM m WHERE fact_id = first
      UNION ALL SELECT fact_id, material, process, source_quote, result_property, result_value, 1 FROM facts WHERE source_quote IS NULL""",
}
