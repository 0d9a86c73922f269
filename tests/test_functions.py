from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orelode.functions import text as T
from orelode.functions import units as U
from orelode.functions.numbers import interval, number_range
from orelode.operators.chunking import greedy_chunks
from orelode.operators.mojibake import repair_text
from orelode.session import shared_folder
from orelode.operators.search import FactFilter, query_variants


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_units(spark):
    spellings = {"мг/дм3": "mg/l", "г/дм³": "g/l", "°C": "c", "°С": "c", "℃": "c", "м3/ч": "m3/h", "л/с": "l/s", "МПа": "mpa", "мас.%": "%_mass", "% мас.": "%_mass", "мин.": "min", " мм ": "mm", "штук": None, None: None}
    assert values(spark, U.canonical_unit, list(spellings)) == list(spellings.values())


@pytest.mark.parametrize(
    ("value", "source", "target", "expected"),
    [(0.5, "г/л", "мг/л", 500), (300, "мг/дм3", "mg/l", 300), (1, "кг/м3", "мг/л", 1000), (0, "°C", "K", 273.15), (32, "°F", "°C", 0), (212, "°F", "°C", 100), (1, "л/с", "м3/ч", 3.6), (1, "бар", "МПа", 0.1), (1, "атм", "МПа", 0.101325), (1, "мг/л", "°C", None), (1, "%", "мас.%", None)],
)
def test_conversion(spark, value, source, target, expected):
    found = spark.range(1).select(U.convert(F.lit(float(value)), U.canonical_unit(F.lit(source)), U.canonical_unit(F.lit(target)))).first()[0]
    assert found == (None if expected is None else pytest.approx(expected))
    assert U.convert_literal(value, source, target) == found if found is None else pytest.approx(U.convert_literal(value, source, target)) == found


@settings(max_examples=50, deadline=None)
@given(st.sampled_from(sorted(U.UNITS)), st.sampled_from(sorted(U.UNITS)), st.floats(-1e6, 1e6))
def test_conversion_round_trip(a, b, x):
    there = U.convert_literal(x, a, b)
    if there is not None:
        assert U.convert_literal(there, b, a) == pytest.approx(x, rel=1e-6, abs=1e-6)


def test_number_ranges(spark):
    cases = {
        "40-60": (40, 60), "750±10": (10, 750), ">95": (95, 95), "≤0,01": (0.01, 0.01), "0,5-1,0": (0.5, 1), "-5": (-5, -5), "72-75%": (72, 75), "2019-2021": (2019, 2021), "1 000": (0, 1), "1,2,3": (1.2, 3),
        "10^-3": (-3, 10), "1e3": (1, 3), "5–-2": (-2, 5), "-5 - -2": (-5, -2), "н/д": None, "pH 2-3 при 25 °C": (2, 25), None: None, "": None,
    }
    assert [r and (r["lo"], r["hi"]) for r in values(spark, number_range, list(cases))] == list(cases.values())


def test_intervals(spark):
    cases = {"7,295–7,438\xa0мм": (7.295, 7.438, "мм"), "563,8 ± 14,6": (549.2, 578.4, ""), "не более 269,4 г/т": (269.4, 269.4, "г/т"), "5\xa0948 мг/м3": (5948, 5948, "мг/м3"), "924,6мг/л": (924.6, 924.6, "мг/л"), "высокое": (None, None, "")}
    found = [(r["lo"] if r["lo"] is None else round(r["lo"], 6), r["hi"] if r["hi"] is None else round(r["hi"], 6), r["tail"]) for r in values(spark, interval, list(cases))]
    assert found == list(cases.values())


def test_text(spark):
    assert values(spark, T.clean_value, [" a\xa0\t b ", "Н/Д", " NULL", "", None]) == ["a b", None, None, None, None]
    assert values(spark, T.year, ["в 1998 году", "2019г", "12019", "2019-2021", None]) == [1998, None, None, 2019, None]
    assert values(spark, T.split_experts, ["А. Б; а. б; Иванов и Петров и др.", None]) == [["А. Б", "Иванов", "Петров и др."], None]
    assert values(spark, lambda c: T.paren_alias(c)[0], ["кек (медный)", "ab (x)", "кек"]) == ["кек", "ab (x)", "кек"]
    assert values(spark, T.category, ["Статьи__a.txt", "a.txt", None]) == ["Статьи", None, None]
    assert values(spark, T.stem, ["осаждениями", "руда", "медной"]) == ["осажден", "руда", "медн"]
    assert values(spark, T.word_set, ["Шлак медный (старый)", "медный шлак"]) == ["медный шлак"] * 2
    assert values(spark, T.url_encoded, ["a b*~я"]) == ["a%20b%2A~%D1%8F"]
    assert values(spark, lambda c: T.compact_text(c, 5), ["abcdefgh", "", None]) == ["abcd...", "—", "—"]


def test_queries_of_words():
    assert query_variants("???") == []
    assert query_variants("ЭЭ", {"ээ": "электроэкстракция"}) == ["ээ", "электроэкстракция"]
    assert FactFilter.of({"material": "", "value_min": "1,5", "year_min": "x", "other": 1}) == FactFilter(value_min=1.5)


def test_greedy_chunks(spark):
    text = "\n\n".join(ch * 1400 for ch in "abc") + "\n\n" + "d" * 6000
    gaps = "e" * 2690 + " " * 20 + "f" * 800  # a window ends in blanks, which cleaning makes one
    found = values(spark, greedy_chunks, ["", " \n\n ", None, text, gaps, "a \t b\0\n\n\n\nc"])
    assert found[:3] == [[], [], None] and found[5] == ["a b\n\nc"]
    chunks = found[3]
    assert chunks[0] == "a" * 1400 + "\n\n" + "b" * 1400
    assert chunks[1] == "b" * 300 + "\n\n" + "c" * 1400
    assert [len(c) for c in chunks[2:]] == [3000, 3000, 600]
    assert found[4][0] == "e" * 2690 + " " + "f" * 309 and found[4][1].startswith("f")


def test_shared_folder_needs_a_setting_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Java:
        getCheckpointDir = staticmethod(lambda: type("None_", (), {"isDefined": staticmethod(lambda: False)}))

    context = type("Context", (), {"master": "local-cluster[3,2,1024]", "_jsc": type("J", (), {"sc": staticmethod(lambda: Java)})})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(type("Session", (), {"conf": Conf, "sparkContext": context}))


def test_mojibake():
    assert repair_text("Привет".encode().decode("cp1251")) == "Привет"
    assert repair_text("Привет") == "Привет" and repair_text(None) is None and repair_text("") == ""
