"""Text of scanned pages repaired into continuous paragraphs.

One pass over the texts finds the lines that may be page furniture, the words divided at line ends, and the words whose
letters look misrecognised. Candidates for such words come from a join of character q-grams with the words of the corpus,
and gradient-boosted trees choose among them; boosted classifiers over pairs of lines decide on divided words and on
furniture. All models are fitted on bounded samples of clean words and texts that are damaged on purpose.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.boosting import Boosted
from orelode.session import stored
from orelode.sources.tables import table

# Bounds of what the models are fitted on: whole texts for the classifier of lines, words for the ranking of replacements and
# for the classifier of divided words.
SAMPLE_TEXTS, SAMPLE_WORDS = 300, 1500
# A word is known from WORD_COUNT occurrences on, and a token is misread for a word that is COMMONER times as frequent at least.
WORD_COUNT, COMMONER = 3, 4
# A line alone is a heading rather than prose up to so many characters and words; longer ones are furniture only if repeated.
LINE_CHARS, LINE_WORDS, NUMBER_CHARS = 80, 8, 40
# Score from which a replacement counts, and from which it does in texts without tokens of mixed signs, which aren't scanned.
LEAST_SCORE, CLEAN_SCORE = 0.5, 0.9
HEADING_SCORE = 0.9  # from which a line that stands as headings do is furniture
# Letters and what scanning makes of them, for damaging clean words.
CONFUSED_CYRILLIC = {"о": "0", "з": "3", "б": "6", "ч": "4", "н": "ii", "ш": "iii", "п": "n", "т": "m", "г": "r", "и": "u", "у": "y", "с": "c", "ы": "ьi", "й": "и"}
CONFUSED_LATIN = {"o": "0", "l": "1", "i": "1", "s": "5", "m": "rn", "e": "c", "b": "6", "g": "9"}
# Shapes that are read for one another, folded to one sign, the longer ones first.
FOLD_CYRILLIC = (("iii", "ш"), ("ii", "н"), ("ьi", "ы"), ("rn", "т"))
FOLD_CYRILLIC_SIGNS = ("036 4nmruyceoapxkhbй".replace(" ", ""), "озбчптгиусеоархкнви")
FOLD_LATIN = (("rn", "m"), ("vv", "w"))
FOLD_LATIN_SIGNS = ("0156i9c", "olsblge")
CYRILLIC_TABLE, LATIN_TABLE = str.maketrans(*FOLD_CYRILLIC_SIGNS), str.maketrans(*FOLD_LATIN_SIGNS)

LINES = re.compile(r"\r\n|\n|\r")
TOKEN = re.compile(r"[^\W_]+")
COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")
PAGE = re.compile(r"[\W_]*(?:page|стр|с|p|лист)?[\W_]*(\d{1,5})[\W_]*", re.I)
END = re.compile(r"[.!?:;»\"]\s*$")
LAST_WORD = re.compile(r"[^\W_]+$")
FIRST_WORD = re.compile(r"[^\W_]+")
TAIL = re.compile(r"^(.*?[^\W\d_].*?)(\s+)(\d{1,5})$")
LAST_NUMBER = re.compile(r"\s+\d{1,5}$")
LETTER = re.compile(r"[^\W\d_]")
NUMBERED = re.compile(r"\d{1,4}[.)]\s")  # a numbered heading or list entry; a running header is numbered at its end
CYRILLIC = re.compile("[а-яё]")
SIGNS = "-¬\xad‐"
FEATURES = 16


def fold(token: str) -> str:
    """Shape of a token in lower case: what is misread for another sign is one sign."""
    pairs, signs = (FOLD_CYRILLIC, CYRILLIC_TABLE) if CYRILLIC.search(token) else (FOLD_LATIN, LATIN_TABLE)
    for a, b in pairs:
        token = token.replace(a, b)
    return token.translate(signs)


def is_mixed(token: str) -> bool:
    """Whether a token in lower case has letters beside digits, or letters of two scripts."""
    if token.isascii():
        return not token.isalpha() and not token.isdigit()
    return bool(token.encode("ascii", "ignore"))


def line_key(text: str) -> str:
    return " ".join(fold(t) if LETTER.search(t) else re.sub(r"\d+", "#", t) for t in text.lower().split())


def candidate_lines(lines: list[str]) -> list[tuple[int, str, list[float], int]]:
    """(line, key, features, number) of the lines that may be furniture; key is empty for a number alone, number -1 for none."""
    n = len(lines)
    plain = [x.strip(" \t\x0c\xa0") for x in lines]
    numbers = {i: int(m[1]) for i, x in enumerate(plain) if 0 < len(x) <= NUMBER_CHARS and x[-1:] != "." and x[-1].isascii() and (m := PAGE.fullmatch(x))}
    again = Counter(plain)
    headed_again = Counter(LAST_NUMBER.sub("", x) if x[-1:].isdigit() else x for x in plain if len(x) > 3)
    found: list[tuple[int, str, int, bool]] = []
    for i, x in enumerate(plain):
        if i in numbers:
            found.append((i, "", numbers[i], False))
        elif x and (x[0].isupper() or x[0].isdigit()) and not ("\t" in x or "|" in x or ";" in x) and (x[-1] not in '.!?:;»"' or again[x] > 1) and x[-1] not in "-¬­,%":
            m = TAIL.match(x) if x[-1].isdigit() else None
            text = LAST_NUMBER.sub("", m[1]) if m else x
            short = len(x) <= LINE_CHARS and len(text.split()) <= LINE_WORDS or headed_again[LAST_NUMBER.sub("", x) if m else x] > 1
            if NUMBERED.match(x) and again[x] == 1:
                continue
            if len(text) >= 4 and short and len(LETTER.findall(text)) * 2 >= len(text):
                found.append((i, line_key(text), int(m[3]) if m else -1, bool(m) and len(m[2]) >= 2))
    same = Counter(k for _, k, _, _ in found if k)
    width = float(np.median([len(x) for x in plain if len(x) > 25] or [60]))
    content = [i for i, x in enumerate(plain) if x and i not in numbers]
    at = {i: j for j, i in enumerate(content)}
    alone = {i for i in numbers if not any(j in numbers for j in range(i - 2, i + 3) if j != i)}
    values = {numbers[i] for i in alone}
    tails: dict[str, set[int]] = {}
    for _, k, v, _ in found:
        if k and v >= 0:
            tails.setdefault(k, set()).add(v)
    out = []
    headed = {h for h, hk, _, _ in found if hk and same[hk] > 1}
    for i, k, v, wide in found:
        if k:
            j = at[i]
            a, b = j - 1, j + 1
        else:
            b = int(np.searchsorted(content, i))
            a = b - 1
        # beyond another candidate that stands right beside, as numbers and headers come together
        heads = headed if not k else ()
        while a >= 0 and content[a] in heads:
            a -= 1
        while b < len(content) and content[b] in heads:
            b += 1
        before, after = plain[content[a]] if a >= 0 else "", plain[content[b]] if b < len(content) else ""
        open_ = bool(before) and not END.search(before) and len(before) > 15
        lower = bool(after) and (m := LETTER.search(after)) is not None and m[0].islower()
        near = sum(j in numbers for j in range(i - 2, i + 3) if j != i)
        sequence = (v + 1 in values or v - 1 in values or v + 2 in values or v - 2 in values) if not k else len(tails.get(k, ())) > 1
        feed = any("\x0c" in lines[j] for j in range(max(0, i - 2), min(n, i + 3)))
        out.append(
            (i, k, [float(not k), float(v >= 0), min(same[k], 20) if k else min(len(alone), 20), float(open_), float(lower), float(near), float(i == 0 or not plain[i - 1]),
              float(i == n - 1 or not plain[i + 1]), float(feed), float(len(plain[i])), float(plain[i].isupper()), float(sequence), float(wide), float(open_ and lower),
              len(plain[i]) / width, min(len(after), 200) / width if after and not open_ else 9.0], v)
        )
    return out


def divided_words(lines: list[str]) -> list[tuple[int, int, str, str, str]]:
    """(line, next line, left part, right part, sign) of the words that a line end may divide.

    The next line is the first after it that begins with a small letter; only page numbers, blank and short capital lines, as
    furniture has them, may stand between.
    """
    out = []
    goes_on: list[tuple[int, str] | None] = [None] * (len(lines) + 1)  # for each line, where the text goes on from it
    for i in range(len(lines) - 1, -1, -1):
        y = lines[i].strip(" \t\x0c\xa0")
        right = FIRST_WORD.match(y)
        if right and right[0][0].islower() and not (len(y) <= NUMBER_CHARS and PAGE.fullmatch(y)):
            goes_on[i] = (i, right[0])
        elif len(y) <= LINE_CHARS:
            goes_on[i] = goes_on[i + 1]
    for i, x in enumerate(lines):
        x = x.rstrip()
        if x and x[-1] in SIGNS and goes_on[i + 1]:
            last = x[x.rfind(" ") + 1 : -1]
            if (m := LAST_WORD.search(last)) and len(m[0]) >= 2 and not m[0].isdigit():
                j, right = goes_on[i + 1]
                out.append((i, j, m[0], right, x[-1]))
    return out


MARKS = "kind string, id long, line int, other int, key string, aux string, n long, value long, features array<double>"
_KINDS = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.strip().split(" ")[0] for f in MARKS.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=names)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one pass over (id, text) finds: token counts, candidate lines, divided words, and tokens of texts that look misread."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            counts: Counter = Counter()
            rows: list[tuple] = []
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if not text:
                    continue
                low = text.lower()
                tokens = Counter(TOKEN.findall(low))
                counts.update(tokens)
                counts.update(c for w in low.split() if "-" in w for c in COMPOUND.findall(w))
                lines = LINES.split(text)
                for line, key, features, value in candidate_lines(lines):
                    rows.append(("line", i, line, None, key, None, 1, value, features))
                for line, other, left, right, sign in divided_words(lines):
                    rows.append(("divided", i, line, other, left.lower(), right.lower(), 1, float(sign != "-"), None))
                mixed = [t for t in tokens if len(t) >= 3 and is_mixed(t) and sum(map(str.isalpha, t)) >= 2]
                rows += [("token", i, None, None, t, None, tokens[t], 1, None) for t in mixed]
                # value: 1 for a mixed token, 0 for one of letters alone in a text that has mixed ones, -1 in one that has none
                rows += [("token", i, None, None, t, None, c, 0 if mixed else -1, None) for t, c in tokens.items() if len(t) >= 4 and t.isalpha() and not is_mixed(t)]
            rows += [("count", None, None, None, t, None, c, None, None) for t, c in counts.items()]
            if rows:
                yield _batch(rows)


def _damaged(word: str, rng: np.random.Generator) -> str:
    table_ = CONFUSED_CYRILLIC if re.search("[а-яё]", word) else CONFUSED_LATIN
    places = [i for i, ch in enumerate(word) if ch in table_]
    if not places:
        return word
    chosen = set(rng.choice(places, size=min(len(places), int(rng.integers(1, 3))), replace=False).tolist())
    return "".join(table_[ch] if i in chosen else ch for i, ch in enumerate(word))


def _grams(shape: Column) -> Column:
    padded = F.concat(F.lit("^"), shape, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))


def _shapes(words: DataFrame) -> DataFrame:
    """words with the column shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = pa.array([fold(w) for w in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, shape], names=[*batch.schema.names, "shape"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(run, f"{fields}, shape string")


RANKING = ("shape_steps", "steps", "n_chars", "ratio", "n_word", "mixed", "digits", "longer")


def _pair_features(pairs: DataFrame) -> DataFrame:
    mixed = F.col("token").rlike("[а-яё]") & F.col("token").rlike("[a-z0-9]") | F.col("token").rlike("[a-z]") & F.col("token").rlike("[0-9]")
    values = [
        F.levenshtein("shape", "word_shape"), F.levenshtein("token", "word"), F.length("token"), F.log(F.col("word_n") / F.col("n")), F.log("word_n"),
        mixed.cast("int"), F.col("token").rlike("[0-9]").cast("int"), F.length("token") - F.length("word"),
    ]
    return pairs.withColumn("x", F.array(*[v.cast("double") for v in values]))


def slips(shape: str) -> int:
    """Letters by which the shape of a misread token may differ from that of its word; each spoils three q-grams."""
    return 1 if len(shape) < 7 else 2


def replacements(counts: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(token, word, score): the word of the corpus that each misread token stands for.

    counts has key and n, tokens in lower case over the whole corpus. Words are tokens of one script, without digits, that
    occur WORD_COUNT times or more. A token is paired with the words that share one of its rarest q-grams of shape, one more
    than its slips can spoil, so that none is missed; pairs are ranked by boosted trees, fitted on at most SAMPLE_WORDS words damaged on purpose, and on words left as they are.
    """
    spark = counts.sparkSession
    pure = F.col("key").rlike("^([а-яё]+|[a-z]+)$")
    words = stored(_shapes(counts.where(pure & (F.col("n") >= WORD_COUNT) & (F.length("key") >= 3)).select(F.col("key").alias("word"), F.col("n").alias("word_n"))), "words")
    gram_df = {r["g"]: r["c"] for r in words.select(F.explode(_grams(F.col("shape"))).alias("g")).groupBy("g").agg(F.count("*").alias("c")).collect()}  # bounded by the alphabet
    rng = np.random.default_rng(7)
    sample = [r for r in words.where("word_n >= 10 and length(word) >= 4").orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS).collect()]
    made = {}
    for r in sample:
        for _ in range(3):
            bad = _damaged(r["word"], rng)
            if bad != r["word"]:
                made[bad] = (r["word"], max(1, int(r["word_n"] * 10 ** -rng.uniform(1, 4.5))))  # a share of the word's count, at any size of the corpus
    training = [(b, n, w) for b, (w, n) in made.items()] + [(r["word"], r["word_n"], "") for r in sample]
    train = spark.createDataFrame(training, "key string, n long, truth string")
    real = counts.where((F.length("key") >= 3) & F.col("key").rlike("[а-яёa-z]")).select("key", "n", F.lit(None).cast("string").alias("truth"))
    tokens = _shapes(real.unionByName(train).withColumnRenamed("key", "token"))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "n", "truth", "shape", "gram"]
        for batch in batches:
            index, grams_ = [], []
            for k, s in enumerate(batch.column(3).to_pylist()):
                t = f"^{s}$"
                own = sorted({t[i : i + 3] for i in range(max(len(t) - 2, 1))}, key=lambda g: (gram_df.get(g, 0), g))[: 3 * slips(s) + 1]
                own = [g for g in own if g in gram_df]
                index += [k] * len(own)
                grams_ += own
            taken = batch.take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(grams_, pa.string())], names=names)

    queries = tokens.mapInArrow(rarest, "token string, n long, truth string, shape string, gram string")
    index = words.select("word", "word_n", F.col("shape").alias("word_shape"), F.explode(_grams(F.col("shape"))).alias("gram"))
    pairs = queries.join(index, "gram").where((F.col("token") != F.col("word")) & (F.abs(F.length("shape") - F.length("word_shape")) <= 1))
    near = F.levenshtein("shape", "word_shape", 2)
    pairs = pairs.where((near >= 0) & (near <= F.when(F.length("shape") < 7, 1).otherwise(2))).drop("gram").dropDuplicates(["token", "truth", "word"])
    # a token is misread only for a clearly commoner word
    pairs = stored(_pair_features(pairs.where(f"word_n >= {COMMONER} * n")), "pairs")
    known = pairs.where("truth is not null").select("x", (F.col("truth") == F.col("word")).alias("y")).collect()
    model = Boosted().fit(np.array([r["x"] for r in known]).reshape(-1, len(RANKING)), np.array([r["y"] for r in known], float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), float).reshape(-1, len(RANKING))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.predict(x))], names=["token", "word", "score"])

    scored = pairs.where("truth is null").select("token", "word", "x").mapInArrow(score, "token string, word string, score double")
    best = scored.where(F.col("score") >= least).groupBy("token").agg(F.max_by(F.struct("word", "score"), F.struct(F.col("score"), F.col("word"))).alias("b"))
    return best.select("token", "b.word", "b.score")


HYPHEN = ("n_joined", "n_compound", "n_left", "n_right", "sign", "n_chars")


def _cut_words(counts: DataFrame) -> list[tuple[str, str, int, float, bool]]:
    """(left, right, sign, truth, unseen) of words and compounds of the corpus, cut on purpose as a line end cuts them.

    A word is cut anywhere, a compound at its hyphen, which it keeps. unseen: the word is taken for one that the corpus
    holds nowhere else, as names are.
    """
    words = counts.where("n >= 5").orderBy(F.xxhash64("key"), "key")
    whole = [r["key"] for r in words.where(F.col("key").rlike("^[а-яёa-z]{6,}$")).limit(SAMPLE_WORDS).collect()]
    hyphened = [r["key"] for r in words.where(F.col("key").rlike("^[а-яёa-z]{2,}-[а-яёa-z]{2,}$")).limit(SAMPLE_WORDS).collect()]
    rng = np.random.default_rng(11)
    rows = []
    for w in whole:
        for unseen in (False, True):
            at = int(rng.integers(2, len(w) - 1))
            rows.append((w[:at], w[at:], int(rng.random() < 0.3), 1.0, unseen))
    return rows + [(*w.split("-", 1), 0, 0.0, False) for w in hyphened]


def joins(divided: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of divided whose two parts are one word that the line end divides, not a compound that keeps its hyphen.

    The classifier is fitted on words of the corpus that are cut on purpose; their features come through the same joins.
    """
    lookup = lambda name: counts.select(F.col("key").alias(f"_{name}"), F.col("n").alias(f"n_{name}"))
    none = F.lit(None)
    rows = divided.select("id", "line", "other", F.col("key").alias("left"), F.col("aux").alias("right"), F.col("value").alias("sign"), none.cast("double").alias("truth"), F.lit(False).alias("unseen"))
    cut = divided.sparkSession.createDataFrame(_cut_words(counts), "left string, right string, sign long, truth double, unseen boolean")
    cut = cut.select(none.cast("long").alias("id"), none.cast("int").alias("line"), none.cast("int").alias("other"), "left", "right", "sign", "truth", "unseen")
    rows = rows.unionByName(cut)
    rows = rows.withColumn("_joined", F.concat("left", "right")).withColumn("_compound", F.concat_ws("-", "left", "right")).withColumn("_left", F.col("left")).withColumn("_right", F.col("right"))
    for name in ("joined", "compound", "left", "right"):
        rows = rows.join(lookup(name), f"_{name}", "left")
    log = lambda name: F.log1p(F.coalesce(f"n_{name}", F.lit(0)).cast("double"))
    joined = F.when(F.col("unseen"), 0.0).otherwise(log("joined"))
    x = F.array(joined, log("compound"), log("left"), log("right"), F.col("sign").cast("double"), (F.length("left") + F.length("right")).cast("double"))
    rows = stored(rows.select("id", "line", "other", "left", "right", "truth", x.alias("x")), "divided")
    known = rows.where("truth is not null").select("x", "truth").collect()  # what _cut_words made
    model = Boosted(trees=30).fit(np.array([r["x"] for r in known]).reshape(-1, len(HYPHEN)), np.array([r["truth"] for r in known], float))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.predict(np.array(batch.column(5).to_pylist(), float).reshape(-1, len(HYPHEN))) if model.forest else np.ones(batch.num_rows)
            yield batch.filter(pa.array(p >= 0.5)).select([0, 1, 2, 3, 4])

    return rows.where("truth is null").select("id", "line", "other", "left", "right", "x").mapInArrow(keep, "id long, line int, other int, left string, right string")


def _paged(lines: list[str], header: str, rng: np.random.Generator) -> tuple[list[str], set[int]]:
    """Clean lines as pages with furniture, and the numbers of the lines put in."""
    out, put = [], set()
    page, every = int(rng.integers(1, 200)), int(rng.integers(12, 30))
    style, blank, feed, top = int(rng.integers(0, 6)), rng.random() < 0.5, rng.random() < 0.3, int(rng.integers(0, 4))
    for i, x in enumerate(lines):
        if i == 0 and top > 1:
            put.add(0)
            out.append(f"{header}    {page}" if top == 2 else header)
        out.append(x)
        if i % every == every - 1 and i < len(lines) - 1:
            number = ("{}", "- {} -", "[{}]", "стр. {}", "Page {}", "            {}")[style].format(page)
            page += 1
            shown = []
            if top != 1:
                shown.append(number)
            if feed:
                shown.append("\x0c")
            if top != 0:
                shown.append(f"{header}    {page}" if top == 2 else f"{header} {every}" if top == 3 else header)
            for s in shown:
                if blank and s != "\x0c":
                    out.append("")
                if s != "\x0c":
                    put.add(len(out))
                out.append(s)
                if blank and s != "\x0c":
                    out.append("")
    return out, put


def furniture(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, line, key, value, wide, varied) of the candidate lines that are page furniture.

    lines are the candidates of the survey; texts (id, text) serve for fitting: at most SAMPLE_TEXTS that show no
    sign of furniture are cut into pages with furniture put in. Besides its features in the text, a line has the share of the lines
    with its key in the corpus that interrupt a sentence.
    """
    keys = lines.where("key <> ''").groupBy("key").agg(F.count("*").alias("key_n"), F.sum(F.get("features", F.lit(13))).alias("key_cut"), F.sum((F.get("features", F.lit(2)) > 1).cast("int")).alias("key_again"))
    rng = np.random.default_rng(3)
    # texts that may hold furniture already: with a lone number, or a line that often interrupts a sentence and is repeated
    cutting = keys.where("key_cut >= 4 and key_cut >= 0.05 * key_n and key_again >= 2").select("key")
    marked = lines.where("key = ''").select("id").unionByName(lines.join(cutting, "key", "left_semi").select("id")).distinct()
    fit = texts.where("length(text) > 800 and text like '%\n%\n%\n%'").select("id").join(marked, "id", "left_anti")
    chosen = [r["id"] for r in fit.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_TEXTS).collect()]
    sample = texts.where(F.col("id").isin(chosen)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_TEXTS).collect() if chosen else []
    x, y, held = [], [], []
    for r in sample:
        plain = LINES.split(r["text"])
        if np.mean([len(p) for p in plain if p] or [0]) > 120:
            plain = [w for p in plain for w in ([p[i : i + 64] for i in range(0, len(p), 64)] or [""])]
        words = re.findall(r"[^\W\d_]{5,}", r["text"])
        header = " ".join(words[int(i)].lower() for i in rng.integers(0, len(words), int(rng.integers(2, 6)))).capitalize() if len(words) > 5 else "Без названия"
        if rng.random() < 0.2:
            header = header.upper()
        for damaged in (True, True, False):
            paged, put = _paged(plain, header, rng) if damaged else (plain, set())
            if damaged and rng.random() < 0.5:
                # a column of numbers, which is no furniture
                at = int(rng.integers(0, len(paged)))
                column = ["", *(str(int(v)) for v in rng.integers(1, 99, int(rng.integers(3, 9)))), ""]
                put = {i + len(column) if i >= at else i for i in put}
                paged = [*paged[:at], *column, *paged[at:]]
            for line, key, features, _ in candidate_lines(paged):
                held.append((key, line in put, features))
    total: dict[str, list] = {}
    for key, _, features in held:
        if key:
            t = total.setdefault(key, [0, 0.0])
            t[0] += 1
            t[1] += features[13]
    for key, good, features in held:
        n, cut = total.get(key, (0, 0.0))
        x.append([*features, cut / n if n else 0.0])
        y.append(float(good))
    model = Boosted(trees=50, depth=4).fit(np.array(x).reshape(-1, FEATURES + 1), np.array(y))
    # lines that are a number alone have no key, and would all be one
    keyed = lines.where("key <> ''").join(keys.select("key", "key_n", "key_cut"), "key").select(*lines.columns, "key_n", "key_cut")
    alone = lines.where("key = ''").withColumn("key_n", F.lit(None).cast("bigint")).withColumn("key_cut", F.lit(None).cast("double"))
    rows = keyed.unionByName(alone).select(
        "id", "line", "key", "value", "features", F.coalesce(F.col("key_cut") / F.col("key_n"), F.lit(0.0)).alias("cut")
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array(batch.column(4).to_pylist(), float).reshape(-1, FEATURES)
            p = model.predict(np.column_stack([f, batch.column(5).to_numpy()]))
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(f[:, 12] > 0), pa.array(f[:, 11] > 0), pa.array(p)], names=["id", "line", "key", "value", "wide", "varied", "p"])
            # a line between blank ones that interrupts nothing, with no number or page break near, is more likely a heading
            heading = (f[:, 6] > 0) & (f[:, 7] > 0) & (f[:, [1, 3, 5, 8]] == 0).all(axis=1) & (f[:, 0] == 0)
            yield out.filter(pa.array(p >= np.where(heading, HEADING_SCORE, 0.5)))

    return rows.mapInArrow(keep, "id long, line int, key string, value long, wide boolean, varied boolean, p double")


def noise(texts: DataFrame) -> DataFrame:
    """(id, kind, line, other, before, after) of every noise found in texts, a table of id and text.

    kind is hyphen (line and the line that goes on, its two parts), header and pageno (the line to leave out), or ocr (a
    token in lower case and the word that it stands for, line NULL). NULL and empty texts have none.
    """
    survey = stored(texts.select("id", "text").mapInArrow(_survey, MARKS), "survey", "kind")
    counts = stored(survey.where("kind = 'count'").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    none = F.lit(None)
    hyphens = joins(survey.where("kind = 'divided'"), counts).select("id", F.lit("hyphen").alias("kind"), "line", "other", F.col("left").alias("before"), F.col("right").alias("after"))
    lines = furniture(survey.where("kind = 'line'"), texts)
    found = F.array_compact(F.array(
        F.when(F.col("key") != "", F.lit("header")), F.when((F.col("key") == "") | (F.col("value") >= 0) & (F.col("wide") | F.col("varied")), F.lit("pageno"))
    ))
    pages = lines.select("id", F.explode(found).alias("kind"), "line", none.cast("int").alias("other"), F.col("key").alias("before"), none.cast("string").alias("after"))
    tokens = survey.where("kind = 'token'").select("id", F.col("key").alias("token"), "value")
    words = tokens.join(replacements(counts), "token").where((F.col("value") >= 0) | (F.col("score") >= CLEAN_SCORE))
    words = words.select("id", F.lit("ocr").alias("kind"), none.cast("int").alias("line"), none.cast("int").alias("other"), F.col("token").alias("before"), F.col("word").alias("after"))
    return hyphens.unionByName(pages).unionByName(words)


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def repair(text: str, marks: list[dict]) -> list[str]:
    """The paragraphs of a text after its noise, rows of ``noise`` as dictionaries, is taken out."""
    lines = LINES.split(text)
    gone = {m["line"] for m in marks if m["kind"] in ("header", "pageno")}
    divided = {m["line"] for m in marks if m["kind"] == "hyphen"}
    words = {m["before"]: m["after"] for m in marks if m["kind"] == "ocr"}
    paragraphs, current, glued, cut = [], "", False, False
    for i, line in enumerate(lines):
        x = line.strip(" \t\x0c\xa0")
        if i in gone:
            cut = True
            continue
        if not x:
            # a blank line ends the paragraph, unless furniture stood here and the sentence goes on
            if current and not glued and not cut:
                paragraphs.append(current)
                current = ""
            continue
        if cut and current and not glued and END.search(current) and not x[:1].islower():
            paragraphs.append(current)
            current = ""
        cut = False
        current = current + x if glued else f"{current}\n{x}" if current and ("\t" in x or " | " in x) else f"{current} {x}" if current else x
        glued = i in divided
        if glued:
            current = current.rstrip("-¬­‐")
    if current:
        paragraphs.append(current)
    fix = lambda m: _cased(words[w], m[0]) if (w := m[0].lower()) in words else m[0]
    return [TOKEN.sub(fix, p) for p in paragraphs] if words else paragraphs


def repaired_texts(texts: DataFrame) -> DataFrame:
    """(id, para_no, paragraph): continuous paragraphs of texts, a table of id and text, without the noise of scanning."""
    marks = noise(texts).groupBy("id").agg(F.collect_list(F.struct("kind", "line", "before", "after")).alias("marks"))  # of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, found in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows += [(i, k, p) for k, p in enumerate(repair(text or "", found or []), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["id", "para_no", "paragraph"])

    return texts.select("id", "text").join(marks, "id", "left").mapInArrow(run, "id long, para_no long, paragraph string")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "extracted").select(F.col("text_id").alias("id"), "text")
    return noise(texts).select(F.col("id").alias("text_id"), F.col("kind").alias("noise")).distinct()


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "extracted").select(F.col("text_id").alias("id"), "text")
    return repaired_texts(texts).withColumnRenamed("id", "text_id")


QUERIES = {"p3_found": p3_found, "p3_repaired": p3_repaired}
SQL: dict[str, str] = {}
