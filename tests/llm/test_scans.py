"""What no bound may hide in scanned text, and the recall of each kind of noise on planted texts."""

from __future__ import annotations

import random

from orelode.llm import scans as S
from tests.llm.test_problems import _scan_corpus


def test_partners_and_last_words_of_any_length():
    far = ["металлур-", *["Журнал Цеха"] * 9, "12", "гия продолжается"]
    assert S.divided_words(far) == [(0, 11, "металлур", "гия", "-")]
    assert S.divided_words(["x" * 90 + "-", "гия"])[0][2] == "x" * 90
    assert S.divided_words(["металлур-", "Б" * 81, "гия"]) == [] and S.divided_words(["12-", "гия"]) == [] and S.divided_words(["а-"]) == []


def test_long_headers_and_numbers_are_candidates():
    header = "Труды " + " ".join(["металлургического"] * 5)
    assert len(header) > S.LINE_CHARS
    lines = [header, "текст идёт дальше", header, "10234", "и ещё дальше"]
    found = {i: k for i, k, _, _ in S.candidate_lines(lines)}
    assert set(found) == {0, 2, 3} and found[3] == ""
    numbered = [f"{header} 7", "текст идёт дальше", f"{header} 8"]
    assert [v for _, _, _, v in S.candidate_lines(numbered)] == [7, 8]
    assert 0 not in {i for i, *_ in S.candidate_lines([header, "текст", "ещё"])}


def test_misread_words_of_letters_alone(spark):
    """Words of one script are looked at in every text; what is spelt right stays."""
    counts = {"извлечение": 400, "извлечениe": 3, "снижается": 300, "снuжается": 2, "возрастает": 500, "возрастают": 40, "промывки": 200, "промьiвки": 4, "шлака": 300, "шлаки": 50}
    words = ["содержание", "никеля", "медленной", "раствора", "процесс", "плотность", "чистого", "мешалки", "температуре", "показано", "железа", "пульпы", "останавливают"]
    counts |= {w: 100 + i for i, w in enumerate(words)}
    found = {r["token"]: r["word"] for r in S.replacements(spark.createDataFrame(list(counts.items()), "key string, n long")).collect()}
    assert found == {"извлечениe": "извлечение", "снuжается": "снижается", "промьiвки": "промывки"}


def test_recall_of_each_kind(spark):
    rng, texts = _scan_corpus(260, 7)
    rows, true = [], set()
    for i, lines in enumerate(texts):
        lines = list(lines)
        if i < 40:
            k = next(k for k, x in enumerate(lines[5:], 5) if len(x.split()[-1]) >= 8)
            w = lines[k].split()[-1]
            at = rng.randint(3, len(w) - 3)
            lines[k], lines[k + 1] = lines[k][: len(lines[k]) - len(w) + at] + "-", w[at:] + " " + lines[k + 1]
            true.add((i, "hyphen"))
        elif i < 80:
            swap = str.maketrans({"и": "u", "о": "0", "п": "n"})
            for k in rng.sample(range(len(lines)), 4):
                ws = lines[k].split()
                j = max(range(len(ws)), key=lambda j: len(ws[j]))
                ws[j] = ws[j][:2] + ws[j][2:].translate(swap)
                lines[k] = " ".join(ws)
            true.add((i, "ocr"))
        elif i < 160:
            name, out = f"Записки {rng.choice(['цеха', 'опытной фабрики', 'общества'])} {rng.choice('АБВГД')}", []
            for k, x in enumerate(lines):
                out.append(x)
                if k % 15 == 14:
                    out += [str(40 + k // 15)] * (i < 120) + [name] * (i >= 120)
            lines = out
            true.add((i, "pageno" if i < 120 else "header"))
        rows.append((i, "\n".join(lines)))
    got = {(r["id"], r["kind"]) for r in S.noise(spark.createDataFrame(rows, "id long, text string")).collect()}
    for kind in ("hyphen", "ocr", "pageno", "header"):
        want = {x for x in true if x[1] == kind}
        assert len(want & got) >= 0.9 * len(want), (kind, len(want & got), len(want))
    assert len(got - true) <= 0.03 * len(rows), sorted(got - true)[:10]
