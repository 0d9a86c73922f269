"""Ranked evidence, summaries, conflicts and gaps of a set of fact rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.operators.matrix import KEY
from orelode.operators.search import FactFilter, find_facts
from orelode.session import stored

LIMITATIONS = ("put together from the graph, without a model's wording", "facts are extracted automatically and await review", "conflicts are signals to check, not proven contradictions")
NO_FACTS = "no facts: the answer shows a gap of the corpus only"
ORDER = ("source_file", "material", "process", "property", "fact_id", "studied_id")


def quality_score() -> Column:
    """100 for each step of confidence and points for a quote, year, place, author, digits in the value, and conditions."""
    c = F.col("confidence")
    has = lambda name, points: F.when(F.col(name).isNotNull(), points).otherwise(0)
    confidence = F.when(c == "high", 300).when(c == "medium", 200).when(c == "low", 100).otherwise(0)
    digits = F.when(F.col("result_value").rlike("[0-9]"), 8).otherwise(0)
    return confidence + has("source_quote", 35) + has("year", 10) + has("location_geo", 10) + has("lab_or_author", 10) + digits + F.when(F.size("conditions") > 0, 6).otherwise(0)


def ranked_columns() -> list[Column]:
    return [F.desc("score"), *[F.asc_nulls_first(c) for c in ORDER]]


def rank_key_parts() -> list[Column]:
    return [(-F.col("score")).alias("minus"), *map(F.col, ORDER)]


def rank_key() -> Column:
    """A STRUCT that sorts as the ranking does, the best first."""
    return F.struct(*rank_key_parts())


def keep_first(rows: DataFrame, keys: tuple[str, ...] = KEY, order: tuple[str, ...] = ("fact_id", "studied_id")) -> DataFrame:
    """The first row of each key, NULLs being equal; partial aggregation keeps a hot key from gathering in one task."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return first.select(*keys, "_first.*")


def first_values(df: DataFrame, group: list[str], column: str, limit: int) -> DataFrame:
    """(group, values): the first distinct values of a column in each group by their order, at most limit."""
    distinct = df.where(F.col(column).isNotNull()).select(*group, column).distinct()
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(column))
    few = distinct.withColumn("_no", rank).where(F.col("_no") <= limit)
    return few.groupBy(*group).agg(F.array_sort(F.collect_list(column)).alias("values"))


def top_values(df: DataFrame, group: str, column: str, limit: int) -> DataFrame:
    """(group, no, value, n): the commonest values of a column in each group."""
    counted = df.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), column))
    return counted.withColumn("no", rank).where(F.col("no") <= limit)


def _tops(few: DataFrame, group: list[str], column: str, limit: int) -> DataFrame:
    """(group, column): the commonest values of a column in each group as one text, ties in the order of their texts."""
    counted = few.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), column))
    best = counted.withColumn("no", rank).where(F.col("no") <= limit)
    return best.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", column))), lambda x: x[column]), ", ").alias(f"top_{column}"))


def summary(rows: DataFrame, group: str, limit: int, missing: str | None = None, tops: tuple[tuple[str, int], ...] = (("material", 3), ("property", 3))) -> DataFrame:
    """The groups with most facts: facts, documents, the commonest values of ``tops``, and source and quote of the best fact.

    Rows without a group are left out, or form the group ``missing``, if it is given.
    """
    scored = rows.withColumn("score", quality_score()).withColumn(group, F.coalesce(group, F.lit(missing)) if missing is not None else F.col(group))
    columns = list(dict.fromkeys([group, "score", "source_quote", *ORDER, *(c for c, _ in tops)]))
    scored = stored(scored.where(F.col(group).isNotNull()).select(*columns), "scored")
    first = F.min(F.struct(*rank_key_parts(), "source_quote"))
    totals = scored.groupBy(group).agg(F.count("*").alias("facts"), F.countDistinct("source_file").alias("documents"), F.max("score").alias("best_score"), first["source_file"].alias("best_source"), first["source_quote"].alias("best_quote"))
    best = stored(totals.orderBy(F.desc("facts"), F.desc("best_score"), group).limit(limit), "best")
    few = scored.join(best.select(group), group, "left_semi")
    for column, n in tops:
        best = best.join(_tops(few, [group], column, n), group, "left")
    return best


def places(rows: DataFrame, limit: int) -> DataFrame:
    """The places with most facts, with their documents and years."""
    y = F.regexp_extract("year", r"^([0-9]{4})$", 1).try_cast("int")
    totals = rows.where("location_geo is not null").groupBy("location_geo").agg(F.count("*").alias("facts"), F.countDistinct("source_file").alias("documents"), F.min(y).alias("first_year"), F.max(y).alias("last_year"))
    return totals.orderBy(F.desc("facts"), "location_geo").limit(limit)


def preset_rows(rows: DataFrame, branches: tuple[dict, ...], names: DataFrame) -> DataFrame:
    """The rows of each branch of a preset, a search saved as filters by branch, with the number of the branch."""
    parts = [find_facts(rows, FactFilter.of(b), names=names).withColumn("branch", F.lit(i)) for i, b in enumerate(branches)]
    return reduce(DataFrame.unionByName, parts)


def ranked(rows: DataFrame) -> DataFrame:
    """Every row with its rank by quality, from 1.

    The rows are range-partitioned and sorted; ranks inside a partition are moved on by the sizes of the partitions before,
    so that no task holds them all.
    """
    columns = ["fact_id", "studied_id", "score", *ORDER[:4]]
    order = ranked_columns()
    scored = stored(rows.withColumn("score", quality_score()).select(*columns), "scored")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(scored.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = placed.withColumn("no", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return inside.join(F.broadcast(before), "part").select((F.col("no") + F.col("before")).alias("rank"), *columns)


def evidence(rows: DataFrame, limit: int = 50) -> DataFrame:
    """Rows with their pass and rank: first the best fact of each source, then the rest, at most limit."""
    scored = rows.withColumn("score", quality_score()).select("fact_id", "studied_id", "score", *ORDER[:4])
    best = scored.groupBy("source_file").agg(F.min(rank_key()).alias("k"))
    head = best.select(F.lit(0).alias("pass"), (-F.col("k.minus")).alias("score"), *[F.col(f"k.{c}").alias(c) for c in ORDER])
    taken = best.select(F.col("k.fact_id").alias("_f"), F.col("k.studied_id").alias("_s"))
    rest = scored.join(taken, (F.col("fact_id") == F.col("_f")) & F.col("studied_id").eqNullSafe(F.col("_s")), "left_anti")
    rest = rest.orderBy(*ranked_columns()).limit(limit).select(F.lit(1).alias("pass"), "score", *ORDER)
    return head.unionByName(rest).orderBy("pass", *ranked_columns()).limit(limit)


def conflicts(rows: DataFrame, limit: int = 12) -> DataFrame:
    """Groups of material, process and property with several values or directions; units are not looked at.

    The largest groups, with eight of their values, six directions, the four sources with most facts, and the quote of the
    best ranked fact.
    """
    g = ["material", "process", "property"]
    r = rows.where("material is not null and process is not null and property is not null").withColumn("score", quality_score())
    r = stored(r.select(*g, "result_value", "direction", "score", "source_file", "source_quote", "fact_id", "studied_id"), "records")
    first = F.min(F.struct(*rank_key_parts(), "source_quote"))["source_quote"].alias("best_quote")
    found = r.groupBy(*g).agg(F.count("*").alias("facts"), F.countDistinct("result_value").alias("n_values"), F.countDistinct("direction").alias("n_directions"), first)
    found = stored(found.where("n_values > 1 or n_directions > 1").orderBy(F.desc("facts"), *g).limit(limit), "conflicts")
    few = r.join(found.select(*g), g, "left_semi")
    values = first_values(few, g, "result_value", 8).withColumnRenamed("values", "v")
    directions = first_values(few, g, "direction", 6).withColumnRenamed("values", "d")
    out = found.join(values, g, "left").join(directions, g, "left").join(_tops(few, g, "source_file", 4), g, "left")
    return out.select(*g, "facts", F.array_join("v", "; ").alias("result_values"), F.array_join("d", "; ").alias("directions"), F.col("top_source_file").alias("sources"), "best_quote")


def metrics(rows: DataFrame) -> DataFrame:
    """One row: facts, documents, years, places, authors, first and last year, and the confidence counts."""
    y = F.regexp_extract("year", r"^([0-9]{4})$", 1).try_cast("int")
    return rows.agg(
        F.count("*").alias("facts"), F.countDistinct("source_file").alias("documents"), F.countDistinct(y).alias("years"), F.countDistinct("location_geo").alias("places"), F.countDistinct("lab_or_author").alias("authors"),
        F.min(y).alias("first_year"), F.max(y).alias("last_year"), *[F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")],
    )


def gap_rules(rows: DataFrame) -> DataFrame:
    """(rule, found, needed): what the facts lack; one row ``none`` if they lack nothing, and ``empty`` without any."""
    s = rows.agg(
        F.count("*").alias("n"), F.countDistinct("source_file").alias("docs"), F.count("year").alias("year"), F.count("location_geo").alias("geo"), F.count("lab_or_author").alias("author"),
        F.count_if(F.coalesce(F.col("result_value").rlike("[0-9]"), F.lit(False))).alias("numeric"), F.count("source_quote").alias("quotes"),
    )
    fifth = F.greatest(F.lit(2).cast("bigint"), F.floor(F.col("n") / 5))
    rule = lambda name, found, needed: F.when(F.col(found) < needed, F.struct(F.lit(name).alias("rule"), F.col(found).alias("found"), needed.cast("bigint").alias("needed")))
    rules = F.array_compact(F.array(rule("documents", "docs", F.lit(3)), rule("year", "year", fifth), rule("geo", "geo", fifth), rule("author", "author", fifth), rule("numeric", "numeric", fifth), rule("quotes", "quotes", F.col("n"))))
    one = lambda name: F.array(F.struct(F.lit(name).alias("rule"), F.col("n").alias("found"), F.lit(0).cast("bigint").alias("needed")))
    return s.select(F.explode(F.when(F.col("n") == 0, one("empty")).when(F.size(rules) == 0, one("none")).otherwise(rules)).alias("r")).select("r.*")


def summary_text(rows: DataFrame, title: str, limit: int = 3) -> DataFrame:
    """One row, (title, summary): what was found, in how many documents, over which years and places, by which processes."""
    m, methods = metrics(rows), summary(rows, "process", limit, tops=())
    names = methods.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("facts")).alias("f"), (-F.col("best_score")).alias("s"), "process"))), lambda x: x["process"]), ", ").alias("names"))
    years = F.when(F.col("first_year").isNotNull(), F.concat(F.lit(", years "), F.col("first_year"), F.lit("-"), F.col("last_year"))).otherwise("")
    places = F.when(F.col("places") > 0, F.concat(F.lit(", places: "), F.col("places"))).otherwise("")
    text = F.concat(F.col("facts"), F.lit(" facts from "), F.col("documents"), F.lit(" documents"), years, places, F.lit("; processes: "), F.when(F.col("names") == "", "none").otherwise(F.col("names")))
    none = F.lit("no facts found: widen the corpus or loosen the filters")
    return m.crossJoin(names).select(F.lit(title).alias("title"), F.when(F.col("facts") > 0, text).otherwise(none).alias("summary"))  # one row each


def limitations(rows: DataFrame) -> DataFrame:
    """(no, limitation): what an answer from rows can't claim; one more where there are no facts."""
    base = rows.sparkSession.createDataFrame(list(enumerate(LIMITATIONS, 1)), "no int, limitation string")
    empty = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(len(LIMITATIONS) + 1).alias("no"), F.lit(NO_FACTS).alias("limitation"))
    return base.unionByName(empty)
