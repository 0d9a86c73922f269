"""Leaks in one and two stretches, against planted truth and against an alignment of every document with every item."""

from __future__ import annotations

import random

import pytest

from orelode.llm import leakage as L

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def word(rng: random.Random, letters: str = "абвгдежзик", n: int = 6) -> str:
    return "".join(rng.choice(letters) for _ in range(n))


def found(spark, docs: dict[int, str], items: dict[int, str]) -> set[tuple[int, int]]:
    rows = L.leaked(spark.createDataFrame(list(docs.items()), DOCS).repartition(3), spark.createDataFrame(list(items.items()), ITEMS)).collect()
    return {(r["doc_id"], r["item_id"]) for r in rows}


def brute(docs: dict[int, str], items: dict[int, str]) -> set[tuple[int, int]]:
    """Every document aligned with every item, without an index and without the test of runs."""
    out = set()
    for d, text in docs.items():
        document = L.Document(text)
        for i, t in items.items():
            w = L.tokens(t)
            document.runs = type("Any", (), {"__contains__": lambda *_: True})()
            if L.passage(w, document, L.needed(len(w))):
                out.add((d, i))
    return out


@pytest.mark.parametrize("common", [False, True])
def test_two_stretches_with_foreign_words_between(spark, common):
    rng = random.Random(1)
    few = [word(rng) for _ in range(400)]
    items, docs, true = {}, {}, set()
    for k, size in enumerate([(6, 6), (8, 8), (10, 10), (12, 12)] * 25):
        words = [rng.choice(few) if common and rng.random() < 0.5 else word(rng, n=9) for _ in range(30)]
        items[k] = " ".join(words)
        a, b = size
        docs[k] = " ".join([*(rng.choice(few) for _ in range(40)), *words[:a], *(word(rng) for _ in range(70)), *words[30 - b :], *(rng.choice(few) for _ in range(40))])
        true.add((k, k))
        # the rare words in the first stretch only, and a quotation that is too short
        docs[1000 + k] = " ".join([*(rng.choice(few) for _ in range(50)), *words[:9], *(rng.choice(few) for _ in range(50))])
    assert found(spark, docs, items) == true


def test_rare_words_in_one_stretch(spark):
    """The second stretch of each leak is of words that most documents hold."""
    rng = random.Random(2)
    few = [word(rng, n=4) for _ in range(60)]
    docs = {1000 + k: " ".join(rng.choice(few) for _ in range(300)) for k in range(20)}
    items = {}
    for k in range(20):
        words = [*(word(rng, n=9) for _ in range(8)), *(rng.choice(few) for _ in range(22))]
        items[k] = " ".join(words)
        docs[k] = " ".join([*words[:6], *(word(rng) for _ in range(30)), *words[12:22], "конец"])
    got = found(spark, docs, items)
    assert {(k, k) for k in range(20)} <= got and got == brute(docs, items)


def test_random_plants_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [word(rng, n=rng.randint(2, 8)) for _ in range(700)]
    weights = [1 / (i + 8) for i in range(700)]
    pick = lambda: rng.choices(vocabulary, weights)[0]
    items = {k: " ".join(pick() for _ in range(rng.randint(24, 60))) for k in range(20)}
    docs, true = {}, set()
    for d in range(150):
        k = rng.randrange(20)
        words = L.tokens(items[k])
        need = L.needed(len(words))
        m = rng.randint(need, len(words))
        if rng.random() < 0.5:
            at = rng.randint(0, len(words) - m)
            parts = [words[at : at + m]]
        else:
            a = rng.randint(6, m - 6)
            parts = [words[:a], words[len(words) - (m - a) :]]
        altered = []
        for part in parts:
            part = list(part)
            # a word in twelve altered, added or dropped, as long as enough stays
            for i in range(3, len(part) - 3, 12):
                if m > need and rng.random() < 0.6:
                    m -= 1
                    part[i] = rng.choice(["иное", "", f"{part[i]} сверх"])
            altered.append(" ".join(part))
        docs[d] = " ".join([*(pick() for _ in range(rng.randint(0, 200))), altered[0], *(pick() for _ in range(40)), *altered[1:], *(pick() for _ in range(rng.randint(0, 200)))])
        true.add((d, k))
    got = found(spark, docs, items)
    few = {d: docs[d] for d in range(40)}
    assert {x for x in got if x[0] < 40} == brute(few, items)
    assert len(true & got) >= 0.99 * len(true) and len(true & got) >= 0.99 * len(got)


def test_loose_chains_count_by_their_dense_parts():
    rng = random.Random(4)
    for size, parts in ((24, (7, 4, 7)), (40, (10, 5, 8)), (30, (3, 1, 3, 1, 3, 1, 3))):
        words = [word(rng) for _ in range(size)]
        text, at = [], 0
        for i, n in enumerate(parts):
            text += words[at : at + n] if i % 2 == 0 else [word(rng) for _ in range(n)]
            at += n
        assert L.passage(words, L.Document(" ".join(text)), L.needed(size))
    words = [word(rng) for _ in range(30)]
    scattered = " ".join(w if i % 3 else "иное" for i, w in enumerate(words))
    assert L.passage(words, L.Document(scattered), L.needed(30)) is None


def test_index_holds_every_term_at_its_place(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["в", "на", "шлак", "17,5", word(rng)]) for _ in range(200)) for _ in range(40)] + ["", None]
    monkeypatch.setattr(L, "SEGMENT_CHARS", 3_000)
    rows = L.positional_index(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3), "doc_id", "text").collect()
    begins = {r["segment"]: list(zip(r["bounds"], r["docs"])) for r in rows if r["term"] is None}
    rebuilt: dict = {}
    for r in rows:
        if r["term"] is not None:
            assert len(r["places"]) == r["n"]
            for g in r["places"]:
                start, doc = max(x for x in begins[r["segment"]] if x[0] <= g)
                rebuilt.setdefault(doc, {})[g - start] = r["term"]
    assert sorted(d for v in begins.values() for _, d in v) == list(range(42)) and len(begins) > 3
    assert {d: [v[i] for i in range(len(v))] for d, v in rebuilt.items()} == {i: L.tokens(t) for i, t in enumerate(texts) if t}


def test_repeated_rows_and_items(spark, monkeypatch):
    rng = random.Random(6)
    words = [word(rng) for _ in range(30)]
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text, 0), (1, text, 1), (2, text, 2), (None, text, 3)], "doc_id long, text string, words int")
    items = spark.createDataFrame([(7, text, "x"), (7, text, "x"), (8, text, "y"), (9, "раз " * 11, "z")], "item_id long, text string, need string")
    rows = L.leaked(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 7), (1, 8), (2, 7), (2, 8)} and all(r["exact"] and r["matched"] == 30 for r in rows)
    # many items are joined to the documents instead of being held by every task
    monkeypatch.setattr(L, "CARRIED", 10)
    monkeypatch.setattr(L, "GROUP", 1)
    assert sorted(map(tuple, L.leaked(docs, items).collect())) == sorted(map(tuple, rows))
