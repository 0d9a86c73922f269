"""Freely typed values mapped to the entry of a reference list that they name.

Each distinct token is joined to the vocabulary of the list by edit distance, over shared character q-grams; the repaired
tokens are then combined by soft TF-IDF to rank complete entries. An entry must be covered by the value and the value by
the entry, so that sharing one word is not enough.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.functions.nulls import is_null_like
from orelode.llm.encoding import pair_model, repaired
from orelode.session import stored
from orelode.sources.tables import table

# Latin letters that look like Cyrillic ones.
LOOKALIKES = str.maketrans("aAeEoOpPcCyYxXkKmMTtHBbi", "аАеЕоОрРсСуУхХкКмМТтНВьи")
# Inflectional endings of Russian adjectives and nouns, the longest first.
ENDINGS = (
    "иями ями ами ого его ому ему ыми ими ией иям иях ого ая яя ое ее ый ий ой ые ие ых их ым им ую юю ою ею ом ем ам ям ах ях ов ев ей ия ья ию ью ии а я о е ы и у ю ь й"
).split()
# Words beside a name that don't belong to it.
ASIDE = frozenset("проба пробы пробе образец образца обр пр исх исходный партия партии навеска опыт № no sample см табл nr".split())
TRANSLIT = dict(zip("абвгдезийклмнопрстуфхцчшщъыьэюяжё", "a b v g d e z i j k l m n o p r s t u f kh ts ch sh shch  y  e yu ya zh yo".split(" ")))
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def stem(token: str) -> str:
    """token without hyphens and without its ending, at least three letters long."""
    token = token.replace("-", "")
    if token.isascii():
        return token
    for ending in ENDINGS:
        if token.endswith(ending) and len(token) - len(ending) >= 3:
            return token[: -len(ending)]
    return token


def transliterated(word: str) -> str:
    return "".join(TRANSLIT.get(ch, ch) for ch in word)


def spelled(text: str) -> str:
    """text in lower case, dashes and blanks alike, look-alike letters of the other script in a word put right."""
    text = re.sub(r"[‐‑‒–—−]", "-", unicodedata.normalize("NFKC", text)).replace("ё", "е").replace("Ё", "Е")
    text = re.sub(r"\s*-(?=\s)|(?<=\s)-\s*", " - ", text)
    fix = lambda m: m[0].translate(LOOKALIKES) if re.search(r"[а-яА-Я]", m[0]) and re.search(r"[a-zA-Z]", m[0]) else m[0]
    return re.sub(r"[^\W\d_]+", fix, text).lower()


def acronym(text: str) -> str:
    """The letters of a value that is an acronym and nothing else, else an empty text."""
    letters = re.sub(r"[^\w]", "", unicodedata.normalize("NFKC", text))
    return letters.upper().translate(LOOKALIKES) if 2 <= len(letters) <= 4 and letters.isalpha() else ""


def value_tokens(value: str) -> list[str]:
    """Words of a value without hyphens, abbreviated ones with a full stop after; what stands beside the name is left out."""
    text = spelled(value)
    inner = re.findall(r"\(([^()]*)\)", text)
    for part in inner:
        if re.search(r"\d|\?", part) or re.fullmatch(r"\W*[^\W\d_]{1,4}\W*", part):
            rest = text.replace(f"({part})", " ")
            text = rest if WORD.search(rest) else text
    text = re.sub(r"(?:№|\bno\.?|#)\s*\d+", " ", text)
    out = []
    for m in WORD.finditer(text):
        w = m[0]
        if w in ASIDE:
            continue
        short = text[m.end() : m.end() + 1] == "." and 2 <= len(w) <= 6 and re.match(r"\.\s*[^\W_]", text[m.end() :])
        out.append(f"{w}." if short else w.replace("-", ""))
    return out


def distance(a: str, b: str, limit: int) -> int:
    """Edit distance with exchanged neighbours as one step; more than limit if it is certain to be."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            new.append(d)
        if min(new) > limit:
            return limit + 1
        older, old = old, new
    return old[-1]


def allowed(length: int) -> int:
    """Steps that a token of this length may differ by."""
    return 0 if length < 2 else 1 if length < 6 else 2 if length < 11 else 3


def grams(token: str) -> list[str]:
    t = f"^{token}$"
    return sorted({t[i : i + q] for q in (2, 3) for i in range(len(t) - q + 1) if q == 3 or len(token) <= 7})


class Reference:
    """The list: its forms as stems with weights, and its acronyms. Entries are (id, canonical, aliases)."""

    def __init__(self, entries: list[tuple[int, str, list[str]]]):
        self.acronyms: dict[str, int] = {}
        self.forms: list[tuple[int, list[str]]] = []
        self.words: set[tuple[str, str]] = set()  # stem, and each spelling of it
        for i, canonical, aliases in entries:
            for name in [canonical, *(aliases or [])]:
                if name and name.isupper() and (a := acronym(name)):
                    self.acronyms[a] = i
                    continue
                words = WORD.findall(spelled(name or ""))
                if words:
                    self.forms.append((i, [stem(w) for w in words]))
                    self.words |= {(stem(w), form) for w in words for form in (stem(w), w.replace("-", ""))}
                    if not name.isascii():
                        latin = [transliterated(w.replace("-", "")) for w in words]
                        self.forms.append((i, latin))
                        self.words |= {(w, w) for w in latin}
        entries_of: dict[str, set[int]] = {}
        for i, form in self.forms:
            for t in form:
                entries_of.setdefault(t, set()).add(i)
        n = len({i for i, _ in self.forms}) or 1
        self.weight = {t: math.log(1 + n / len(s)) for t, s in entries_of.items()}
        self.longest = max((len(form) for _, form in self.forms), default=0)
        self.by_token: dict[str, list[int]] = {}
        for k, (_, form) in enumerate(self.forms):
            for t in set(form):
                self.by_token.setdefault(t, []).append(k)

    def score(self, repairs: list[list[tuple[str, float]]], form: list[str]) -> float:
        """Soft TF-IDF of a value, given as the repairs of its tokens, and a form; 0 unless each token of both is matched."""
        if len(repairs) != len(form):
            return 0.0
        pairs = sorted(((s, i, j) for i, options in enumerate(repairs) for v, s in options for j, f in enumerate(form) if f == v), reverse=True)
        taken: dict[int, tuple[int, float]] = {}
        used: set[int] = set()
        for s, i, j in pairs:
            if i not in taken and j not in used:
                taken[i] = (j, s)
                used.add(j)
        if len(used) != len(form):
            return 0.0
        top = sum(s * self.weight[form[j]] ** 2 for j, s in taken.values())
        return top / sum(self.weight[t] ** 2 for t in form)

    def best(self, value: str, repairs: dict[str, list[tuple[str, float]]], least: float) -> tuple[int, float]:
        """(entry, score) of a value, 0 if no entry reaches ``least``; the smaller id on a tie."""
        if a := acronym(value):
            if a in self.acronyms:
                return self.acronyms[a], 1.0
        words = value_tokens(value)
        if len(words) == 1 and (a := acronym(words[0])) in self.acronyms:
            return self.acronyms[a], 1.0
        best = (0, 0.0)
        if len(words) > self.longest + 1:
            return best
        for variant in [words, *([*words[:k], (words[k] + words[k + 1]), *words[k + 2 :]] for k in range(len(words) - 1))]:
            options = [repairs.get(w, []) for w in variant]
            if not options or not all(options):
                continue
            rarest = min(options, key=lambda o: sum(len(self.by_token.get(v, ())) for v, _ in o))
            for k in sorted({k for v, _ in rarest for k in self.by_token.get(v, ())}):
                entry, form = self.forms[k]
                s = self.score(options, form)
                if s > best[1] + 1e-9 or (abs(s - best[1]) <= 1e-9 and s > 0 and entry < best[0]):
                    best = (entry, s)
        return best if best[1] >= least else (0, best[1])


def value_words(values: DataFrame) -> DataFrame:
    """(value, token): the tokens of every value, also those of two neighbours written as one; token NULL where it has none."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in batch.column(0).to_pylist():
                w = value_tokens(v)
                rows += [(v, t) for t in sorted({*w, *(w[k] + w[k + 1] for k in range(len(w) - 1))})] or [(v, None)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["value", "token"])

    return values.mapInArrow(split, "value string, token string")


def token_repairs(tokens: DataFrame, vocabulary: list[tuple[str, str]], stems: list[str]) -> DataFrame:
    """(token, words array<int>, similarities array<double>): the stems of the vocabulary within the allowed distance of each token.

    tokens has one column, token, distinct; vocabulary has each stem with its spellings, the stem itself among them; words
    are places in ``stems``. The q-grams of the tokens and of their stems are joined with those of the vocabulary, and a
    spelling is tried only where they share one. Abbreviated tokens get the words that begin with them.
    """
    spark = tokens.sparkSession

    def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                forms = {t} if t.endswith(".") else {t, stem(t)}
                rows += [(t, f, g) for f in sorted(forms) for g in (["." + t[:2]] if t.endswith(".") else grams(f))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["token", "form", "gram"])

    place = {s: i for i, s in enumerate(stems)}
    index = [(place[s], w, g) for s, w in vocabulary for g in [*grams(w), "." + w[:2]]]
    index = spark.createDataFrame(index, "stem int, word string, gram string")  # the reference list's own words
    short = F.col("token").endswith(".")
    pairs = tokens.mapInArrow(gram_rows, "token string, form string, gram string").join(index, "gram")
    pairs = pairs.where(short | (F.abs(F.length("form") - F.length("word")) <= 3)).select("token", "form", "stem", "word").distinct()
    pairs = pairs.where(F.when(short, F.col("word").startswith(F.rtrim(F.col("token"), F.lit(".")))).otherwise(F.levenshtein("form", "word", 6) >= 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for t, f, s, w in zip(*(c.to_pylist() for c in batch.columns)):
                if t.endswith("."):
                    kept.append((t, s, 0.9))
                    continue
                limit = min(allowed(len(f)), allowed(len(w)))
                d = distance(f, w, limit)
                if d <= limit:
                    kept.append((t, s, 1 - d / max(len(f), len(w))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], k) for i, k in enumerate((pa.string(), pa.int32(), pa.float64()))], names=["token", "word", "similarity"])

    measured = pairs.mapInArrow(measure, "token string, word int, similarity double").groupBy("token", "word").agg(F.max("similarity").alias("similarity"))
    found = measured.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("word", "similarity"))).alias("o"))  # at most the vocabulary
    return found.select("token", F.col("o.word").alias("words"), F.col("o.similarity").alias("similarities"))


def mapped(values: DataFrame, entries: DataFrame, least: float = 0.72) -> DataFrame:
    """(value, canonical_id, score) for every distinct value; canonical_id 0 where no entry of the list is named.

    values has one string column ``value``; entries has canonical_id, canonical and aliases (an array, may be NULL). NULL
    values give no rows, empty ones and texts without a word are unmatched. The list is taken whole by the driver.
    """
    listed = [(r["canonical_id"], r["canonical"], r["aliases"]) for r in entries.select("canonical_id", "canonical", "aliases").orderBy("canonical_id").collect()]
    reference = Reference(listed)
    stems = sorted({s for s, _ in reference.words})
    split = stored(value_words(values.where("value is not null").distinct()), "words")
    options = token_repairs(split.select("token").where("token is not null").distinct(), sorted(reference.words), stems)
    # values without a word have no token to join by, and would all be one key
    joined = split.where("token is not null").join(options, "token", "left").groupBy("value").agg(F.collect_list(F.struct("token", "words", "similarities")).alias("tokens"))
    none = F.array().cast("array<struct<token:string,words:array<int>,similarities:array<double>>>")
    bare = split.where("token is null").select("value", none.alias("tokens"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                repairs = {t["token"]: [(stems[i], s) for i, s in zip(t["words"], t["similarities"])] for t in tokens if t["words"]}
                out.append((value, *reference.best(value, repairs, least)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.float64()))], names=["value", "canonical_id", "score"])

    return joined.unionByName(bare).mapInArrow(rank, "value string, canonical_id long, score double")


def mapped_facts(facts: DataFrame, entries: DataFrame) -> DataFrame:
    """(fact_id, field, value, canonical_id, score) for the fields material and process of every fact.

    NULL-like values have a NULL canonical_id and exact canonical names their entry; values that were decoded with a wrong
    encoding are left out. A hot value is mapped once, and only its rows are joined back, which skew joins can split.
    """
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("material", "process")])
    rows = facts.select("fact_id", F.explode(fields).alias("v")).select("fact_id", "v.*")
    exact = entries.select(F.col("canonical").alias("value"), F.col("canonical_id").cast("bigint").alias("exact_id"))
    rows = rows.join(exact, "value", "left")
    typed = rows.where(F.col("exact_id").isNull() & ~is_null_like(F.col("value"))).select("value").distinct()
    checked = repaired(typed, ["value"], pair_model(facts, ["material", "process"]))
    sound = checked.where(~F.col("value__garbled")).select("value")
    found = mapped(sound, entries)
    # only typed values are joined; missing and exact ones would be hot keys
    null_like = is_null_like(F.col("value"))
    id_, score = F.col("canonical_id"), F.col("score")
    typed_rows = rows.where(F.col("exact_id").isNull() & ~null_like).join(found, "value")
    known = rows.where(F.col("exact_id").isNotNull()).select("fact_id", "field", "value", F.col("exact_id").alias("canonical_id"), F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    missing = rows.where(F.col("exact_id").isNull() & null_like).select("fact_id", "field", "value", F.lit(None).cast("bigint").alias("canonical_id"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("exact"))
    return typed_rows.select("fact_id", "field", "value", id_, score, F.lit(False).alias("exact")).unionByName(known).unionByName(missing)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = mapped_facts(table(spark, folder, "facts"), table(spark, folder, "synonyms"))
    return rows.where(F.col("canonical_id").isNotNull() & ~F.col("exact")).select("fact_id", "field", "canonical_id")


def p1_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """Every material and process with its entry and score; 0 for unmatched values, NULL for missing ones."""
    return mapped_facts(table(spark, folder, "facts"), table(spark, folder, "synonyms")).drop("exact")


QUERIES = {"p1_found": p1_found, "p1_mapped": p1_mapped}
SQL: dict[str, str] = {}
