"""Properties of the fact engine on a small hand-made table, and on an empty one."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from orelode.operators import answers as A
from orelode.operators import graph as G
from orelode.operators import matrix as M
from orelode.operators import search as S
from orelode.operators.facts import fact_rows, normal_facts

SCHEMA = (
    "fact_id long, material string, process string, result_property string, result_value string, result_unit string, direction string, conditions array<struct<parameter:string,value:string,unit:string>>, "
    "source_file string, source_quote string, chunk_id int, confidence string, year string, location_geo string, lab_or_author string, equipment string"
)
C = lambda p, v, u: {"parameter": p, "value": v, "unit": u}
ROWS = [
    (1, "Кек", "обжиг", "выход", "200", "мг/л", "рост", [C("концентрация", "0,5", "г/л"), C("pH", "7", None)], "Статьи__a", "q", 1, "High", "1998", "Россия", "Иванов; Петров", "печь"),
    (2, "шлак", "Обжиг", "выход", "300", "мг/л", None, None, "Статьи__a", "q", 1, "low", "2003-2005", None, None, "печь"),
    (3, "кек", "обжиг", "Выход", "300", "г/л", "снижение", [], "b", None, None, None, None, "Чили", "иванов", None),
    (4, None, "обжиг", "выход", "н/д", None, None, [C("температура", "500", "°C")], "b", None, None, "medium", "2003", None, "Иванов", "мельница"),
    (5, "кек", None, "выход", "5", "%", None, None, None, None, None, "high", None, None, None, None),
    (6, "кек", "обжиг", None, "7", None, None, None, None, "z", 2, None, None, None, None, None),
    (7, "медный кек", "обжиг", "выход", "1", None, None, None, "c", "w", 1, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def normal(spark):
    synonyms = spark.createDataFrame([(1, "медный кек", ["кек меди"]), (2, "шлак", None)], "canonical_id int, canonical string, aliases array<string>")
    return normal_facts(spark.createDataFrame(ROWS, SCHEMA), synonyms).cache()


def test_fan_out(normal):
    rows = fact_rows(normal)
    found = Counter((r["fact_id"], r["material"]) for r in rows.select("fact_id", "material").collect())
    assert found == Counter({(1, "кек"): 1, (1, "шлак"): 1, (2, "кек"): 1, (2, "шлак"): 1, (3, "кек"): 1, (4, "кек"): 1, (7, "медный кек"): 1})


def test_units_decide_a_condition(normal):
    ids = lambda **f: {r["fact_id"] for r in S.find_facts(normal, S.FactFilter(**f)).collect()}
    assert ids(parameter="концентрация", value_min=400, value_max=600, unit="мг/л") == {1}
    assert ids(value_min=400, value_max=600, unit="мг/л") == {1} and ids(value_min=400, value_max=600, unit="°C") == {4}
    assert ids(year_min=2004, year_max=2010) == {2} and ids(geo_scope="DOMESTIC") == {1} and ids(expert="иванов") == {1, 3, 4}
    assert ids(material="???") == set() and ids() == {1, 2, 3, 4, 5, 6, 7} and ids(result_unit="г/л", result_value_max=1) == {1, 2}


def test_each_spelling_matches_on_its_own(spark, normal):
    nodes = spark.createDataFrame([("Material:x", "Material", "x", "x", ["медный кек", "шлак плавки"], "x"), ("Material:y", "Material", "y", None, None, "медный шлак")], "node_id string, node_type string, name string, display_name string, aliases array<string>, base string")
    assert S.matching_nodes(nodes, "медный шлак").count() == 0 and S.matching_nodes(nodes, "шлак плавки").count() == 1
    assert [r["name"] for r in S.matching_nodes(nodes, "медный шлак", include_base=True).collect()] == ["y"]
    synonyms = spark.createDataFrame([(1, "медный кек", ["кек меди"])], "canonical_id int, canonical string, aliases array<string>")
    typed = normal_facts(spark.createDataFrame([(1, "Кек меди", *ROWS[0][2:]), *ROWS[1:]], SCHEMA), synonyms)
    ids = lambda q: {r["fact_id"] for r in S.find_facts(typed, S.FactFilter(material=q), names=S.spellings(typed)).collect()}
    assert ids("кек меди") == {1, 7} == ids("медный кек") and ids("???") == set()


def test_conditions_take_units_apart_once(spark):
    c = lambda *x: [dict(zip(("parameter", "value", "unit"), v)) for v in x]
    rows = [(1, c(("t", "104 - 140", "°F"))), (2, c(("t", "50", "мг/л"))), (3, c(("t", "45", None), ("t", "x", "°C"))), (4, None), (5, c((None, None, None))), (6, c(("Ток", "5", "кА/м2")))]
    df = spark.createDataFrame(rows, "id long, conditions array<struct<parameter:string,value:string,unit:string>>")
    ids = lambda *a: {r["id"] for r in df.where(S.conditions_match(F.col("conditions"), *a)).collect()}
    assert ids("T", 40, 60, "°C") == {1} and ids(None, None, None, "°C") == {1, 3} and ids("ток", None, None, "кА") == {6} and ids("ток", 6, None, "кА/м2") == set()
    assert ids(None, 45, None, None) == {1, 2, 3} and ids("нет", None, None, None) == set()


def test_matrix_of_a_condition(spark, normal):
    rows = fact_rows(normal)
    m = M.condition_matrix(rows, "концентрация", least=1).collect()
    assert [(r["material"], r["n"], r["low"], r["high"]) for r in m] == [("кек", 1, 0.5, 0.5), ("шлак", 1, 0.5, 0.5)]
    assert M.condition_matrix(rows, "нет такой").count() == 0
    assert M.axis_filter("Materials", "кек") == {"material": "кек"} and M.axis_filter("results", "x") == {"property_query": "x"} and M.axis_filter("colour", "x") == {}
    assert M.title("material", "process") == "material × process" and M.axis("??") is None


def test_ranks_are_whole(spark, normal):
    rows = fact_rows(normal)
    got = [(r["rank"], r["score"]) for r in A.ranked(rows).orderBy("rank").collect()]
    assert [r for r, _ in got] == list(range(1, rows.count() + 1)) and [s for _, s in got] == sorted((s for _, s in got), reverse=True)


def test_graph_counts(normal):
    n = {r["node_id"]: r["mention_count"] for r in G.nodes(normal).collect()}
    assert n["Material:кек"] == 4 and n["Equipment:печь"] == 2 and "Equipment:мельница" not in n and n["Expert:Иванов"] == 2 and n["Document:unknown_source_5"] == 1
    e = G.edges(normal)
    assert G.degree(e).agg(F.sum("degree")).first()[0] == 2 * e.count()
    assert e.where("edge_type = 'uses_equipment'").count() == 2
    both = G.neighbours(e, normal.sparkSession.createDataFrame([("Process:обжиг",)], "node_id string"))
    assert both.count() == e.where("src = 'Process:обжиг' or dst = 'Process:обжиг'").count()


def test_matrix_adds_up(normal):
    records, _, _ = M.matrix(fact_rows(normal), least=1)
    total = records.count()
    cells = M.cells(records)
    assert cells.agg(F.sum("n")).first()[0] == total == M.all_cells(records).agg(F.sum("n")).first()[0]
    assert M.gaps(records).count() == 0 and M.examples(records).where("no > 3").count() == 0
    states = M.all_cells(records).select(M.cell_state(F.col("n")).alias("s")).distinct().collect()
    assert {r["s"] for r in states} <= {"empty", "single", "partial", "covered"}


@pytest.mark.parametrize(("n", "expected"), [(1, 1), (2, 5), (30, 5), (31, 6), (42, 6), (43, 7), (57, 8), (100, 8)])
def test_bucket_counts(spark, n, expected):
    points = spark.range(n).select(F.col("id").cast("double").alias("point"))
    b = M.buckets(points)
    assert b.select("count").first()[0] == expected and b.agg(F.max("bucket")).first()[0] == expected - 1
    assert M.buckets(points.where("point < 0")).count() == 0


def test_answers(normal):
    rows = fact_rows(normal)
    once = A.keep_first(rows)
    assert once.count() == A.keep_first(once.withColumn("branch", F.lit(0))).count() == 7
    conflict = A.conflicts(rows).collect()
    assert [(r["material"], r["result_values"]) for r in conflict] == [("кек", "200; 300"), ("шлак", "200; 300")]
    assert A.evidence(rows, 3).where("pass = 0").count() == 3
    rules = {r["rule"] for r in A.gap_rules(rows).collect()}
    assert "quotes" in rules and "none" not in rules
    assert [r["rule"] for r in A.gap_rules(rows.where("fact_id < 0")).collect()] == ["empty"]
    assert A.limitations(rows).count() == 3 and A.limitations(rows.where("fact_id < 0")).count() == 4 and A.summary_text(rows, "t").first()["summary"].startswith("7 facts from 3 documents")
    assert A.metrics(rows).first()["facts"] == 7 and A.summary(rows, "process", 5).first()["documents"] == 3


def test_empty_tables(spark, normal):
    empty = normal.where("fact_id < 0")
    rows = fact_rows(empty)
    nodes, edges = G.nodes(empty), G.edges(empty)
    for df in (rows, nodes, edges, G.degree(edges), *M.matrix(rows), M.gaps(rows), M.examples(rows), A.conflicts(rows), A.evidence(rows), A.summary(rows, "process", 5), A.keep_first(rows), S.free_search(rows, nodes, edges, "кек")):
        assert df.count() == 0
    assert A.metrics(rows).first()["facts"] == 0
