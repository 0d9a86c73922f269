"""Coverage matrix: ranked labels, cells with examples, margins, gaps, and buckets of condition values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.numbers import number_range
from orelode.functions.text import format_number
from orelode.session import stored

KEY = ("material", "process", "property", "result_value", "result_unit", "source_file", "chunk_id", "source_quote")


def fact_key() -> Column:
    """The eight columns by which two rows are the same fact; NULLs are equal."""
    return F.struct(*KEY)


def top_labels(records: DataFrame, label: str, limit: int | None, least: int = 2) -> DataFrame:
    """(label, n): labels with ``least`` distinct facts or more, by their number and name; all if limit is None or 0."""
    ranked = records.where(F.col(label).isNotNull()).select(label, fact_key().alias("k")).distinct().groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return ranked.orderBy(F.desc("n"), label).limit(limit) if limit else ranked


def matrix(rows: DataFrame, row: str = "material", column: str = "process", top_rows: int = 15, top_columns: int = 10, least: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records of the chosen labels, row labels, column labels). Columns are ranked among the records of the chosen rows.

    The records are stored once, for both rankings and what follows; they have the columns of KEY, and fact_id and studied_id
    where rows have them.
    """
    more = [c for c in ("fact_id", "studied_id", row, column) if c in rows.columns and c not in KEY]
    records = stored(rows.where(F.col(row).isNotNull() & F.col(column).isNotNull()).select(*KEY, *more), "records")
    r = stored(top_labels(records, row, top_rows, least), "labels")
    records = records.join(r.select(row), row, "left_semi")
    c = stored(top_labels(records, column, top_columns, least), "labels")
    return records.join(c.select(column), column, "left_semi"), r, c


def cells(records: DataFrame, row: str = "material", column: str = "process") -> DataFrame:
    """(row, column, n) of the cells that hold records; rows of one fact count each, as the fan-out gives them."""
    return records.groupBy(row, column).agg(F.count("*").alias("n"))


def all_cells(records: DataFrame, row: str = "material", column: str = "process") -> DataFrame:
    """Every pair of the labels that hold records, 0 where there are none; both lists are limited by the ranking."""
    found = stored(cells(records, row, column), "cells")  # read three times, as many rows as the labels allow
    grid = found.select(row).distinct().crossJoin(found.select(column).distinct())
    return grid.join(found, [row, column], "left").select(row, column, F.coalesce("n", F.lit(0)).alias("n"))


def cell_state(n: Column) -> Column:
    return F.when(n == 0, "empty").when(n <= 2, "single").when(n <= 5, "partial").otherwise("covered")


def gaps(records: DataFrame, row: str = "material", column: str = "process") -> DataFrame:
    """Empty cells with their interest, the product of the totals of row and column."""
    found = stored(cells(records, row, column), "cells")  # read three times, as many rows as the labels allow
    r, c = found.groupBy(row).agg(F.sum("n").alias("row_total")), found.groupBy(column).agg(F.sum("n").alias("column_total"))
    missing = r.crossJoin(c).join(found, [row, column], "left_anti")
    return missing.withColumn("interest", F.col("row_total") * F.col("column_total"))


def examples(records: DataFrame, row: str = "material", column: str = "process", limit: int = 3) -> DataFrame:
    """The first distinct ``file: quote`` texts of each cell, in the order they appear."""
    text = F.concat_ws(": ", "source_file", "source_quote")
    seen = records.groupBy(row, column, text.alias("example")).agg(F.min("fact_id").alias("first"))
    rank = F.row_number().over(Window.partitionBy(row, column).orderBy("first", "example"))
    return seen.withColumn("no", rank).where(F.col("no") <= limit).drop("first")


def condition_points(rows: DataFrame, parameter: str) -> DataFrame:
    """rows with the middle of every condition whose parameter contains the text and whose value has a number."""
    c = rows.select("*", F.explode("conditions").alias("c")).where(F.lower("c.parameter").contains(parameter.lower()))
    c = c.withColumn("_r", number_range(F.col("c.value"))).where("_r is not null")
    return c.withColumn("point", (F.col("_r.lo") + F.col("_r.hi")) / 2).drop("c", "_r")


def _bounds(points: DataFrame) -> DataFrame:
    n = F.count("*")
    return points.agg(F.min("point").alias("low"), F.max("point").alias("high"), F.when(n <= 1, 1).otherwise(F.greatest(F.lit(5), F.least(F.lit(8), F.bround(F.sqrt(n)).cast("int")))).alias("count"))


def buckets(points: DataFrame) -> DataFrame:
    """points with their bucket: equal widths between the extremes, half open, the last closed; five to eight by the root of the count."""
    width = (F.col("high") - F.col("low")) / F.col("count")
    index = F.when(width > 0, F.least(F.floor((F.col("point") - F.col("low")) / width), F.col("count") - 1)).otherwise(0).cast("int")
    return points.crossJoin(_bounds(points)).withColumn("bucket", index)


def condition_matrix(rows: DataFrame, parameter: str, row: str = "material", top_rows: int = 15, least: int = 2) -> DataFrame:
    """(row, bucket, low, high, label, n): the matrix whose columns are buckets of the values of a condition.

    One record is a fact row and one of its conditions whose parameter contains the text and whose value has a number; units
    are not looked at. Rows are ranked by their distinct facts as in ``matrix``; the bounds of the buckets come from the
    records of the chosen rows. The label shows the bounds; low and high are the exact ones, for the way back to the facts.
    """
    points = stored(condition_points(rows.where(F.col(row).isNotNull()), parameter).select(*KEY, "point"), "points")
    labels = top_labels(points, row, top_rows, least)
    records = stored(points.join(labels.select(row), row, "left_semi").select(row, "point"), "points")
    placed = buckets(records)
    width = (F.col("high") - F.col("low")) / F.col("count")
    low = F.col("low") + F.col("bucket") * width
    high = F.when(F.col("bucket") == F.col("count") - 1, F.col("high")).otherwise(F.col("low") + (F.col("bucket") + 1) * width)
    counted = placed.select(row, "bucket", low.alias("low"), high.alias("high")).groupBy(row, "bucket", "low", "high").agg(F.count("*").alias("n"))
    return counted.withColumn("label", F.concat(format_number(F.col("low")), F.lit("–"), format_number(F.col("high"))))


# The axis that a name of it means.
AXES = {"material": "material", "materials": "material", "process": "process", "processes": "process", "property": "property", "properties": "property", "result": "property", "results": "property", "result_property": "property"}


def axis(name: str | None) -> str | None:
    """The column of an axis by its name in any case, None for an unknown one."""
    return AXES.get((name or "").strip().lower())


def title(row: str, column: str | None, parameter: str | None = None) -> str:
    """What a matrix of these axes is called; the parameter stands for the columns of a condition matrix."""
    return f"{row} × {parameter or column}"


def axis_filter(name: str, label: str) -> dict[str, str]:
    """The filter of the fact search that a label of an axis means; none for an axis that has no filter."""
    return {"material": {"material": label}, "process": {"process": label}, "property": {"property_query": label}}.get(axis(name) or "", {})
