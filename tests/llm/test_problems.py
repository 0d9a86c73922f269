from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orelode.llm import chunks, copies, encoding, leakage, names, packing, prose, reference_list, scans
from orelode.llm.boosting import Boosted

LONG = "слово " * 60_000


# exact copies


def test_copies_against_brute_force(spark):
    rng = random.Random(1)
    words = ["Шлак", "шлак ", "(ШЛАК)", "«кек»", "кек", "1,5", "15", "1.5", "10-20", "1020", "a b", "ab", None, ""]
    rows = [(i, rng.choice(words), rng.choice(words), rng.choice(words), "p", rng.choice(words), "x") for i in range(400)]
    df = spark.createDataFrame(rows, "fact_id long, material string, process string, source_quote string, result_property string, result_value string, id_a string")
    key = copies.fact_key()
    found = sorted((r["id_a"], r["id_b"]) for r in copies.copies(df.repartition(7), key, "fact_id").collect())
    groups: dict = {}
    for r in df.select("fact_id", key.alias("k")).orderBy("fact_id").collect():
        if r["k"] is not None:
            groups.setdefault(r["k"], []).append(r["fact_id"])
    assert found == sorted((g[0], x) for g in groups.values() for x in g[1:])
    one = copies.representatives(df, key, "fact_id")
    assert one.agg(F.sum("copies")).first()[0] == 400 and one.count() == 400 - len(found)


def test_copies_keep_signs_in_numbers(spark):
    texts = ["потери 7,5 %", "Потери  7,5%.", "потери 75 %", "потери 7.5 %", "«потери» 7,5 %!", "от 4517 - 4980", "от 4517–4980", "от 45174980", "t -5", "t 5", "a - 5", "a 5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    k = [r["k"] for r in df.select("i", copies.canonical(F.col("t")).alias("k")).orderBy("i").collect()]
    blanks = [r["k"] for r in spark.createDataFrame([(i, f"5{' ' * i}-{' ' * j}6") for i in range(12) for j in (0, 1, 9, 60)], "i long, t string").select(copies.canonical(F.col("t")).alias("k")).collect()]
    assert set(blanks) == {"5-6"}  # a dash between numbers stays, however many blanks stand around it
    assert k[0] == k[1] == k[4] and len({k[0], k[2], k[3]}) == 3 and k[5] == k[6] != k[7] and k[8] != k[9] and k[10] == k[11]


def test_copies_of_one_hot_group_over_many_partitions(spark):
    df = spark.range(5_000).select(F.col("id"), F.lit("same").alias("t")).repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = copies.copies(df, copies.record_key([], ["t"]), "id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(pairs) == 4_999 and {r["id_a"] for r in pairs} == {0}
    assert copies.copies(df.where("id < 0"), copies.record_key([], ["t"]), "id").count() == 0


# encodings

SENTENCE = "Степень очистки раствора достигла 78,93 % при 20 °C, проба 12"


@pytest.fixture(scope="module")
def repairer(spark):
    rows = [(SENTENCE,), ("Для медного шлака, смена 582, журнал 979, прочность брикетов - 5 МПа",), ("коллективная цементация через 30 мин, извлечение железа",), ("Größe d80, Müllner-Zelle 7 (façade side, Ø 25 µm)",)] * 20
    return encoding.Repairer(encoding.pair_model(spark.createDataFrame(rows, "t string"), ["t"]))


@pytest.mark.parametrize(("real", "wrong"), [("utf-8", "cp1251"), ("utf-8", "latin-1"), ("utf-8", "cp866"), ("cp1251", "latin-1"), ("cp1251", "cp866"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r")])
def test_wrong_encodings_are_undone(repairer, real, wrong):
    text = SENTENCE.replace("°", "")
    garbled = text.encode(real).decode(wrong)
    assert repairer.value(garbled) == (text, True, True)
    half = text[:30] + text[30:].encode(real).decode(wrong)
    assert repairer.value(half)[1]


def test_twice_wrong_and_lost(repairer):
    twice = SENTENCE.encode().decode("cp1251").encode().decode("cp1251", "replace")
    assert repairer.value(twice)[1]
    assert repairer.value("Степень ��� 5")[1:] == (True, False)
    for clean in (SENTENCE, "Größe d80, Müllner-Zelle 7 (façade side, Ø 25 µm)", "plain ascii", "", "℃"):
        assert repairer.value(clean) == (clean, False, True)


def test_bounds_of_the_search_lose_nothing_here(repairer):
    """Without bounds on states, detours and usual tokens the same texts are found."""
    free = encoding.Repairer(repairer.model, expanded=None, detour=float("inf"), usual=0.0)
    parts = ["Степень очистки", "раствора достигла", "прочность брикетов - 5 МПа", "извлечение железа", "проба 12"]
    for real, wrong in (("utf-8", "cp1251"), ("utf-8", "cp866"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r")):
        for text in parts:
            garbled = text.encode(real).decode(wrong, "replace")
            assert repairer.value(garbled) == free.value(garbled)
    for text in parts:
        assert repairer.value(text) == free.value(text) == (text, False, True)


def test_several_short_words_prove_an_exchange_together(repairer):
    text = "шлак кек пыль руда"
    garbled = text.encode("koi8-r").decode("cp1251")
    assert repairer.value(garbled)[1] and not repairer.value("МПа")[1] and not repairer.value("МПа"[:2])[1]


def test_encoding_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, LONG, "x"), (3, LONG, "x")], "id long, t string, t__text2 string")
    rows = encoding.repaired(df, ["t"]).collect()
    assert [(r["id"], r["t__text"], r["t__garbled"], r["t__restored"]) for r in rows] == [(1, None, False, True), (2, "", False, True), (3, LONG, False, True), (3, LONG, False, True)]
    assert encoding.repaired(df.where("id > 9"), ["t"]).count() == 0


def test_garbled_values_on_many_rows(spark):
    rng = random.Random(5)
    words = sorted({w for w in "степень очистки раствора достигла после обжига остаток сушили и направляли на анализ а газ отводили через скруббер в течение часа извлечение железа из медного шлака при цементации составило прочность брикетов".split()})
    text = lambda: " ".join(rng.choice(words) for _ in range(8)).capitalize()
    swap = lambda t: t.encode("koi8-r").decode("cp1251")
    clean = [text() for _ in range(200)]
    hot, many = swap(text()), [swap(text()) for _ in range(90)]
    for garbled, copies_of in (([hot], 100), (many, 1)):
        rows = [*clean, *garbled * copies_of]
        df = spark.createDataFrame(list(enumerate(rows)), "id long, t string").repartition(5)
        found = {r["t"]: r["t__garbled"] for r in encoding.repaired(df, ["t"]).collect()}
        assert [t for t in garbled if not found[t]] == [] and [t for t in clean if found[t]] == []


# reference list

ENTRIES = [(1, "сурьмянистый агломерат", ["сурьмянистые агломераты"]), (2, "золотосодержащий штейн", ["gold-bearing matte", "ЗШ"]), (3, "свинцово-цинковый кек", []), (4, "криолит", ["cryolite"]), (5, "свинцовая пыль", None), (6, "электроэкстракция", ["ЭЭ"])]


def test_typed_values(spark):
    cases = {
        "сурьмянистого агломерата": 1, "АГЛОМЕРАТ (сурьмянистый)": 1, "сурь. агломерат": 1, "surmyanistyj aglomerat": 1, "сурьмянситый аглмерат": 1, "cурьмянистый aгломерат (проба 39)": 1, "зш": 2, "Gold‑bearing  matte;": 2,
        "свинцово цинковый кек": 3, "свинцово–цинковый кек №5": 3, "куиолит": 4, "свинцовая плыь": 5, "elektroekstraktsiya": 6, "ЭЭ.": 6, "(электроэкстракция №2)": 6,
        "свинцовый кек": 0, "сурьмянистый штейн": 0, "лазерная наплавка": 0, "см. таблицу 4": 0, "": 0, "???": 0, "XX": 0, "кек": 0, LONG: 0,
    }
    entries = spark.createDataFrame(ENTRIES, "canonical_id int, canonical string, aliases array<string>")
    values = spark.createDataFrame([(v,) for v in [*cases, None, "криолит", "криолит"]], "value string")
    found = {r["value"]: r["canonical_id"] for r in reference_list.mapped(values, entries).collect()}
    assert found == cases | {"криолит": 4}
    assert reference_list.mapped(values.where("value = 'no'"), entries).count() == 0
    assert {r["canonical_id"] for r in reference_list.mapped(values, entries.where("canonical_id < 0")).collect()} == {0}


def test_distance_counts_exchanges():
    assert reference_list.distance("осаждение", "осажедние", 3) == 1 and reference_list.distance("abc", "", 2) == 3 and reference_list.distance("", "", 0) == 0


# pieces


def test_pieces_rebuild_the_text_and_keep_the_limit(spark):
    rng = random.Random(3)
    sentence = lambda: " ".join("".join(rng.choice("абвгдежз") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(3, 15))) + ". "
    texts = ["".join(sentence() + ("\n\n" if rng.random() < 0.1 else "") for _ in range(rng.randint(1, 300))) for _ in range(30)] + ["x" * 20_000, "a b", "я" * 3000, "я" * 3001, "\U0001f600" * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "id long, t string")
    rows = chunks.pieces(df, "id", "t").orderBy("id", "piece_no").collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    assert len(by) == len(texts)
    for i, t in enumerate(texts):
        p = by[i]
        assert all(len(r["piece"]) <= 3000 and t[r["start"] : r["stop"]] == r["piece"] for r in p)
        assert p[0]["start"] == 0 and p[-1]["stop"] == len(t) and all(a["stop"] - b["start"] == 300 for a, b in zip(p, p[1:]))
        assert (len(p) > 1) == (len(t) > 3000)


def test_an_edit_moves_only_the_pieces_beside_it():
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("абвгдежзик") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "."]) for _ in range(12_000))
    edited = text[:20_000] + "вставка " + text[20_000:]
    before, after = {c for c, _ in chunks.cuts(text)}, {c for c, _ in chunks.cuts(edited)}
    shifted = {c if c < 20_000 else c + 8 for c in before}
    assert len(shifted ^ after) <= 6 and len(before) > 25


def test_long_paragraphs():
    assert chunks.long_paragraphs("a" * 3001, 3000) == [1] and chunks.long_paragraphs(" \n \n" + "a" * 3000 + "\n\t\n\n\n" + "b" * 3001 + "  ", 3000) == [2]


# names


def test_spellings_of_names(spark):
    groups = [
        ["Иванченко Пётр Львович", "П. Л. Иванченко", "Иванченко ПЛ", "ИВАНЧЕНКО П.Л.", "проф. Иванченко П.Л.", "Ivanchenko P.L.", "Петя Иванченко", "Иванченко, П. Л.", "Иванчекно П.Л."],
        ["Иванченко Дмитрий Олегович", "Дима Иванченко", "Dmitrij Ivanchenko", "Д. Иванченко"],
        ["Научно-технический центр «Кивамипольм»", "НТЦ Кивамипольм", "НТЦ «Кивамипльм»", "Кивамипольм (НТЦ)", "Kivamipolm", "НАУЧНО-ТЕХНИЧЕСКИЙ ЦЕНТР «КИВАМИПОЛЬМ»", "Науч.-тех. центр «Кивамипольм»"],
        ["Лаборатория № 9, НТЦ «Кивамипольм»", "НТЦ «Кивамипольм», лаб. 9", "лаб. №9 НТЦ Кивамипольм"],
        ["Лаборатория № 2, НТЦ «Кивамипольм»"], ["Отдел технического контроля", "отдел  технического контроля"], ["С. Двойников А.Б. и ещё"],
        ["Лапина А. Б."], ["Лапина А. В."],
    ]
    common = {"Иванченко Пётр Львович", "Научно-технический центр «Кивамипольм»", "П. Л. Иванченко"}
    rows = [(x, 50 if x in common else 2) for g in groups for x in g] + [("А. Лапина", 1), ("Лапина", 1)]
    df = spark.createDataFrame(rows, "name string, n long")
    found = {(r["name_a"], r["name_b"]) for r in names.linked(df).collect()}
    assert found == {(a, b) for g in groups for a in g for b in g if a < b}
    assert names.linked(df.where("n < 0")).count() == 0


def test_misspelt_names_of_similar_counts(spark):
    rows = [
        ("Кафедра металлургии цветных металлов «Пимугисист»", 41), ("каф. МЦМ «Пипугисист»", 17), ("ООО «Мекефизалаб»", 16), ("ООО «Меекефизалаб»", 8), ("ООО «Меекефизаллаб»", 8),
        ("НТЦ «Зенофумунс»", 1), ("Научно-технический центр «Зенофуунс»", 1), ("ИГИ «Вигизуникс»", 14), ("ПБПА «Вигизунист»", 12), ("Бедозупоук И.А.", 2), ("И.А. Бедозпуоук", 2), ("Бедозпуоук Л.Л.", 2),
    ]
    found = {(r["name_a"], r["name_b"]) for r in names.linked(spark.createDataFrame(rows, "name string, n long")).collect()}
    groups = [[rows[0][0], rows[1][0]], [x for x, _ in rows[2:5]], [rows[5][0], rows[6][0]], [rows[9][0], rows[10][0]]]
    assert found == {(a, b) for g in groups for a in g for b in g if a < b}


def test_typed_names_leave_out_what_is_no_single_name(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("н/д",), ("a; b",), ("",), (" нет ",)], "x string")
    assert [(r["name"], r["n"]) for r in names.typed_names(df, "x").collect()] == [("a", 2)]


def test_functions_travel_without_the_package(tmp_path):
    """What the executors run must not need a copy of the repository there."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    for f in (prose.described_batch, leakage.passage, names.readings, encoding.Repairer, scans.repair, reference_list.value_tokens, chunks.cuts):
        run = subprocess.run([sys.executable, "-c", "import pickle, sys; pickle.load(sys.stdin.buffer)"], input=cloudpickle.dumps(f), cwd=tmp_path, capture_output=True, env={"PATH": "/usr/bin"})
        assert run.returncode == 0, (f, run.stderr.decode()[-300:])


# packing


def test_packing_is_complete_and_full(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["руда", "шлак", "ore", "17,5"]) for _ in range(int(rng.paretovariate(1.1) * 40) % 3000)) for _ in range(600)] + ["", None, "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").repartition(5)
    sizes = {r["id"]: r["n_tokens"] for r in packing.token_sizes(df, "id", "t").collect()}
    rows = packing.packed(df, "id", "t", capacity=512, buckets=40).collect()
    total: dict = {}
    each: dict = {}
    for r in rows:
        total[r["container_id"]] = total.get(r["container_id"], 0) + r["n_tokens"]
        each.setdefault(r["id"], []).append(r)
    assert max(total.values()) <= 512 and {i: sum(r["n_tokens"] for r in v) for i, v in each.items()} == sizes
    assert all(len(v) == 1 for i, v in each.items() if sizes[i] <= 512) and any(len(v) > 1 for v in each.values())
    assert sum(total.values()) / (512 * len(total)) > 0.93
    assert packing.packed(df.where("id < 0"), "id", "t").count() == 0


def test_bucket_bounds_are_optimal():
    histogram = {1: 5, 2: 1, 7: 4, 8: 4, 20: 1, 21: 3, 30: 1}
    cost = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())
    from itertools import combinations

    best = min(cost([*c, 30]) for c in combinations([x for x in histogram if x != 30], 2))
    assert cost(packing.bucket_bounds(histogram, 30, 3)) == best


# leakage


def test_leaked_passages(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("абвгдежзик") for _ in range(6)) for _ in range(300)]
    item = [rng.choice(vocabulary) for _ in range(40)]
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    altered = [w if i % 9 else "иное" for i, w in enumerate(item)]
    docs = {
        1: " ".join([*noise(50), *item, *noise(50)]), 2: " ".join([*noise(20), *item[:12], *noise(30), *item[25:33], *noise(9)]), 3: ", ".join(w.upper() for w in [*noise(5), *altered]), 4: " ".join([*noise(30), *item[:10], *noise(40)]),
        5: " ".join(noise(400)), 6: " ".join(rng.sample(item, len(item))), 7: None, 8: "", 9: LONG, 10: " ".join(w if i % 2 else "другое" for i, w in enumerate(item)),
    }
    corpus = spark.createDataFrame([(k, v, "clash") for k, v in docs.items()], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "короткий текст")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in leakage.leaked(corpus, items).collect()}
    assert set(found) == {(1, 7), (2, 7), (3, 7)}
    assert found[1, 7]["exact"] and not found[3, 7]["exact"] and found[2, 7]["stretches"] == 2
    index = leakage.positional_index(corpus, "doc_id", "text").cache()
    assert set(found) == {(r["doc_id"], r["item_id"]) for r in leakage.leaked(corpus, items, index).collect()}
    assert leakage.leaked(corpus.where("doc_id < 0"), items).count() == 0 and leakage.leaked(corpus, items.where("item_id < 0")).count() == 0


# statistics


def test_classes_of_text(spark):
    line = "После обжига остаток сушили и направляли на анализ, а газ отводили через скруббер в течение часа."
    words = " ".join("".join(random.Random(i).choice("абвгдеёжзийклмнопрстуфхцчшщъыьэюя") for _ in range(3 + i % 7)) for i in range(80))
    cases = {
        "prose": [line, f"{line}\n\n- шлак\n- кек\n\n{line} {line}", "\n".join(line[i : i + 48] for i in range(0, len(line) - 3, 48)), f"– {line}\n– Да, и в цехе это видно."],
        "list": ["\n".join(f"{i}. шлак, обжиг" for i in range(9)), "\n".join(["медный кек", "цинковая пыль - 5 кг", "чан с мешалкой, 2 шт.", "обжиг (6 ч)"] * 3), "[1] Lobo И. Кек: обжиг. 2004. С. 56–108\n[2] Mega В. Шлак: плавка. 1997. С. 30–136"],
        "table": ["a; b; c\n1; 2; 3\n4; 5; 6", "x | y | z\n1 | 2 | 3", "a\tb\n1\t2"],
        "junk": ["С|т~*дни1и смен1 о&^ясня'¦ это с1~,п&л|ым ^кислением %еiе¦аi об'а*ц~ в0лjфрамов.г| раство'а%объёi^м~41", "ян мятчцыирйнэмю рдапыпэ цкрнмручйхщэ бэфя лищ ьфат хгхэахдн и в ъыо жйц щшчк ггрч вбю ьоо", words, "12345 67890 " * 30, "=/*;;::~~^^||" * 20, "Назад > Поиск > Каталог\nПечать > Вход > Архив", "Перед " * 40, "aB3" * 60, "", None, "   \n"],
    }
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in cases.items() for t in ts)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, words string")
    found = {r["doc_id"]: r for r in prose.described(df, "doc_id", "text").collect()}
    assert [(t and t[:30], found[i]["text_class"]) for i, t, _ in rows] == [(t and t[:30], k) for _, t, k in rows]
    deciding = {"empty", "junk_lines", "mostly_symbols", "mostly_digits", "few_distinct_words", "few_common_words", "broken_words", "no_sentence", "table_rows", "list_entries"}
    assert all((found[i]["text_class"] == "prose") == (not deciding & set(found[i]["reasons"])) for i, _, _ in rows)
    # a text alone has what it has among others
    for i, t, _ in rows:
        alone = [c[0].as_py() for c in prose.described_batch([t or ""])]
        assert [v if v == v else None for v in alone] == [found[i][c] for c in prose.FIELDS]
    r = prose.described(spark.createDataFrame([(1, "Кек и шлак.\nab 12")], "doc_id long, text string"), "doc_id", "text").first()
    assert (r["chars"], r["words"], r["lines"], r["line_end_punctuation"], r["distinct_words"]) == (17, 4, 2, 0.5, 4) and r["common_words"] == pytest.approx(0.25)


def test_statistics_by_hand(spark):
    twice = "The ore and the slag. The ore and the slag."
    symbols = ["=/*;:~^|" * 49, "=/*;:~^|" * 52]  # a line is junk by its symbols at any length
    texts = [twice, twice.lower(), *symbols, "a" * 40 + " " * 30 + "кек.", "Ключ {x}... да…\r\n(12) б)\r\n\tв"]
    rows = [r.asDict() for r in prose.described(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string"), "i", "t").orderBy("i").collect()]
    assert rows[0]["common_words"] == rows[1]["common_words"] == 0.6 and rows[0]["distinct_words"] == 4
    assert rows[2]["junk_share"] == rows[3]["junk_share"] == 1.0 and rows[4]["line_end_punctuation"] == 1.0
    assert rows[5]["lines"] == 3 and "c4_braces" in rows[5]["reasons"] and "gopher_words" in rows[5]["reasons"] and rows[5]["bullet_lines"] == pytest.approx(1 / 3)
    # repeated lines and words against plain Python
    rng = random.Random(8)
    for _ in range(20):
        lines = [" ".join(rng.choice(["Руда", "руда", "и", "шлак", "ore", "5,1"]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))]
        got = dict(zip(prose.FIELDS, [c[0].as_py() for c in prose.described_batch(["\n".join(lines)])]))
        words = [w for x in lines for w in x.lower().replace("5,1", " ").split()]
        assert (got["words"], got["distinct_words"], got["lines"]) == (len(words), len(set(words)), len(lines))
        repeated = len(lines) - len({x.lower() for x in lines})
        assert ("gopher_repeated_lines" in got["reasons"]) == (repeated > 0.3 * len(lines))


# scans


def test_boosting_learns_and_is_deterministic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    a, b = Boosted(depth=3).fit(x, y), Boosted(depth=3).fit(x, y)
    held = rng.normal(size=(500, 4))
    right = ((held[:, 0] > 0) ^ (held[:, 1] > 0.3)) == (a.predict(held) > 0.5)
    assert right.mean() > 0.95 and np.array_equal(a.predict(held), b.predict(held))
    assert Boosted().fit(x[:0], y[:0]).predict(held).shape == (500,)


def _scan_corpus(n: int = 120, seed: int = 1):
    rng = random.Random(seed)
    words = ["содержание", "никеля", "возрастает", "после", "медленной", "промывки", "раствора", "снижается", "извлечение", "железа", "показано", "что", "при", "температуре", "процесс", "останавливают", "плотность", "пульпы", "чистого", "шлака", "мешалки"]
    texts = []
    for _ in range(n):
        lines, line = [], ""
        for _ in range(60):
            s = " ".join(rng.choice(words) for _ in range(rng.randint(5, 11))).capitalize() + ("." if rng.random() < 0.9 else "?")
            for w in s.split():
                if len(line) + len(w) > 58:
                    lines.append(line)
                    line = ""
                line = f"{line} {w}".strip()
        texts.append([*lines, line])
    return rng, texts


def test_noise_of_scans_is_found_and_taken_out(spark):
    rng, texts = _scan_corpus()
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    dirty, page = [], 10
    for k, x in enumerate(texts[0]):
        dirty.append(x)
        if k % 14 == 13 and k < len(texts[0]) - 1:
            dirty += [str(page), "Записки опытного цеха"]
            page += 1
    words = "\n".join(dirty)
    divided = "\n".join(texts[1][:5] + ["Показано, что при температуре извле-", "чение железа возрастает после промывки."] + texts[1][5:])
    misread = "\n".join(texts[2][:3] + ["Из8лечение жeлеза сн0жается, п0казано снuжается."] + texts[2][3:])
    column = "\n".join(texts[3][:6] + ["", "17", "74", "48", "13", ""] + texts[3][6:])
    rows += [(1000, words), (1001, divided), (1002, misread), (1003, column), (1004, None), (1005, ""), (1006, LONG)]
    df = spark.createDataFrame(rows, "id long, text string")
    found: dict = {}
    marks = scans.noise(df).collect()
    for r in marks:
        found.setdefault(r["id"], set()).add(r["kind"])
    assert {"pageno", "header"} <= found[1000] and "hyphen" in found[1001] and "ocr" in found[1002]
    assert not found.get(1003) and not {1004, 1005, 1006} & set(found)
    assert sum(bool(found.get(i)) for i in range(120)) <= 3
    out = {i: " ".join(scans.repair(t, [r.asDict() for r in marks if r["id"] == i])) for i, t in rows if t and i >= 1000}
    assert "извлечение железа возрастает" in out[1001] and "снижается" in out[1002] and "снuжается" not in out[1002]
    assert out[1000] == " ".join(texts[0]) and "Записки" not in out[1000]
    paragraphs = scans.repaired_texts(df.where("id >= 1003")).collect()
    assert {r["id"] for r in paragraphs} == {1003, 1006}


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert scans.noise(empty).count() == 0 and scans.repaired_texts(empty).count() == 0


def test_accuracy_of_replacements_on_held_out_words(spark):
    rng = np.random.default_rng(5)
    _, texts = _scan_corpus(40, 9)
    counts: dict = {}
    for t in texts:
        for w in scans.TOKEN.findall(" ".join(t).lower()):
            counts[w] = counts.get(w, 0) + 1
    damaged = {}
    for w in counts:
        if len(w) >= 5:
            bad = scans._damaged(w, rng)
            if bad != w:
                damaged[bad] = w
    rows = [*counts.items(), *((b, 1) for b in damaged)]
    found = {r["token"]: r["word"] for r in scans.replacements(spark.createDataFrame(rows, "key string, n long")).collect()}
    assert np.mean([found.get(b) == w for b, w in damaged.items()]) >= 0.9
    assert not set(found) & set(counts)
