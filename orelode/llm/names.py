"""Spellings of one person or organisation linked through canonical rewritings of each name.

Every name is read in all the ways that the rules allow: either part as the surname, a short given name as the full one,
given names as initials, any word of a long name as the own name of an organisation, and the words beside it as the
abbreviation that their initials make. The readings are exploded into rewritings and equi-joined. A rewriting is scored by
its rarity, one over the number of entities that share it: a surname with one initial that two people have links neither.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.functions.nulls import is_null_like
from orelode.llm.reference_list import distance
from orelode.session import stored
from orelode.sources.tables import table

# Given names with their short forms. Other given names are known by their place beside a patronymic or surname.
GIVEN = {
    "александр": "саша шура саня", "алексей": "леша алеша", "анатолий": "толя", "андрей": "андрюша", "антон": "антоша тоша", "артем": "тема",
    "борис": "боря", "вадим": "вадик", "валентин": "валя", "василий": "вася", "виктор": "витя", "виталий": "виталик", "владимир": "вова володя",
    "вячеслав": "слава", "геннадий": "гена", "георгий": "жора", "глеб": "", "григорий": "гриша", "денис": "дениска", "дмитрий": "дима митя",
    "евгений": "женя", "егор": "егорка гоша", "захар": "захарка", "иван": "ваня", "игорь": "игорек", "илья": "илюша", "кирилл": "кира",
    "константин": "костя", "лев": "лева", "леонид": "леня", "максим": "макс", "марк": "", "михаил": "миша", "никита": "", "николай": "коля",
    "олег": "олежка", "павел": "паша", "петр": "петя", "роман": "рома", "ростислав": "ростик", "семен": "сеня", "сергей": "сережа",
    "станислав": "стас", "степан": "степа", "тарас": "тарасик", "тимофей": "тима тимоша", "федор": "федя", "филипп": "филя", "юрий": "юра", "яков": "яша",
    "анна": "аня", "елена": "лена", "екатерина": "катя", "галина": "галя", "ирина": "ира", "людмила": "люда", "мария": "маша", "надежда": "надя", "наталья": "наташа",
    "ольга": "оля", "светлана": "света", "татьяна": "таня", "robert": "bob rob", "william": "bill will", "richard": "dick rick", "james": "jim", "thomas": "tom", "michael": "mike",
}
# Titles before a name.
TITLES = frozenset("проф профессор д-р др доктор акад академик доц доцент инж инженер г-н г-жа prof dr ктн дтн".split())
NAMED_AFTER = ("им", "имени")  # in small letters; in capitals they may be initials
# Transliteration of Cyrillic letters.
LATIN = dict(zip("абвгдезийклмнопрстуфхцчшщъыьэюяжё", "a b v g d e z i j k l m n o p r s t u f kh ts ch sh shch  y  e yu ya zh e".split(" ")))
DIGRAPHS = ("shch", "sh", "ch", "kh", "zh", "ts", "yu", "ya")
PATRONYMIC = re.compile(r"(?:ovich|evich|ich|ovna|evna|ichna|inichna)$")
LAB = re.compile(r"\b(?:лаборатори[яи]|лаб\.?|lab\.?)\s*(?:№|no\.?|n)?\s*(\d+)", re.I)
QUOTED = re.compile(r"[«\"“„]([^«»\"“”„]+)[»\"”“]")
TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
ACRONYM = 5  # letters of the longest word in capitals that is read as an abbreviation
OWN = 4  # letters of the shortest word that may be the own name of an organisation
LONG = 24  # letters from which near names are found by their unchanged pieces instead of by letters left out


def latin(text: str) -> str:
    return "".join(LATIN.get(ch, ch) for ch in text.lower())


SHORT = {latin(s): latin(full) for full, shorts in GIVEN.items() for s in [full, *shorts.split()]}


def initial(token: str) -> str:
    return next((d for d in DIGRAPHS if token.startswith(d)), token[:1])


def given(token: str) -> str | None:
    """The full given name of a token of the list, which may be short or have one slip of the pen; None for others."""
    if token in SHORT:
        return SHORT[token]
    if len(token) >= 5:
        near = {full for s, full in SHORT.items() if len(s) >= 5 and s[0] == token[0] and distance(token.replace("x", "ks"), s, 1) <= 1}
        return near.pop() if len(near) == 1 else None
    return None


class Reading(NamedTuple):
    """One way to read a name. sure: by its form alone; the others need a name that is surely read like that."""

    rule: str
    kind: str  # person, org, word (one word alone) or other
    sure: bool
    core: str  # the surname, or the own name of an organisation, in Latin letters without case
    first: str = ""  # initials
    second: str = ""
    given: str = ""
    extra: str = ""  # the number of a laboratory
    legal: str = ""  # what the words beside an own name are abbreviated to


def is_acronym(word: str, shouted: bool) -> bool:
    """Whether a word is an abbreviation by its capitals; in a name of capitals only short words are."""
    capitals = sum(map(str.isupper, word))
    return capitals >= 2 and (not word.isupper() or len(word) <= (ACRONYM if not shouted else 4))


def abbreviated(words: list[str], shouted: bool) -> str:
    """The initials of a phrase: the capitals of its abbreviations, the first letters of other words and of their parts; no prepositions."""
    out = []
    for w in words:
        for part in w.split("-"):
            if is_acronym(part, shouted):
                out += [latin(ch) for ch in part if ch.isupper()]
            elif len(part) > 2 or part.isupper():
                out.append(initial(latin(part)))
    return "".join(out)


def _person(rule: str, sure: bool, surname: str, names: list[str], second: str = "") -> Reading:
    full = given(names[0]) or names[0]
    return Reading(rule, "person", sure, surname, initial(full), second, full)


def readings(name: str) -> list[Reading]:
    """All readings of a name; the last is always its words in any order."""
    text = re.sub(r"\s+", " ", name.replace("ё", "е").replace("Ё", "Е")).strip()
    lab, shouted = "", text == text.upper()
    if m := LAB.search(text):
        lab = m[1].lstrip("0") or "0"
        text = f"{text[: m.start()]} {text[m.end() :]}"
    every = sorted(latin(w) for w in TOKEN.findall(text))
    plain = Reading("words", "other", False, " ".join(every) or latin(name), extra=lab)
    if quoted := QUOTED.search(text):
        beside = [w for w in TOKEN.findall(QUOTED.sub(" ", text)) if w.lower() not in TITLES and w not in NAMED_AFTER]
        core = "".join(latin(w) for w in re.findall(r"[^\W_]+", quoted[1]))
        return [Reading("quoted", "org", True, core, extra=lab, legal=abbreviated(beside, shouted)), plain] if core else [plain]
    words, initials, spelt = [], [], []
    for m in TOKEN.finditer(text):
        word, dot = m[0], text[m.end() : m.end() + 1] == "."
        if word.lower() in TITLES or word in NAMED_AFTER:
            continue
        words.append(word)
        if len(word) == 1 or len(word) <= 2 and dot:
            initials.append(initial(latin(word)))
        elif len(word) == 2 and word.isupper() and m.end() == len(text):
            initials += [initial(latin(ch)) for ch in word]
        else:
            spelt.append(word)
    full = [latin(w) for w in spelt]
    out: list[Reading] = []
    if not lab and initials and len(full) == 1 and len(initials) <= 2:
        return [Reading("initials", "person", True, full[0], initials[0], initials[1] if len(initials) > 1 else ""), plain]
    if not lab and not initials and len(full) == 1:
        return [Reading("word", "word", False, full[0])]
    if not lab and not initials and len(full) == 3:
        at = [i for i, w in enumerate(full) if i and PATRONYMIC.search(w) and w not in SHORT]
        if at:
            # the given name stands right before the patronymic, in either order
            i = at[-1] if at[-1] == 2 or len(at) == 1 else at[0]
            surname = full[0 if i == 2 else 2]
            return [_person("patronymic", True, surname, [full[i - 1]], initial(full[i])), plain]
    if not lab and not initials and len(full) == 2 and not any(is_acronym(w, shouted) for w in spelt):
        known = [given(w) is not None for w in full]
        if known[0] != known[1]:
            k = known.index(True)
            return [_person("given", True, full[1 - k], [full[k]]), plain]
        out += [_person("order", False, full[1 - k], [full[k]]) for k in (0, 1)]
    # any word but an abbreviation may be the own name of an organisation
    own = [w for w in words if len(w) >= OWN and not is_acronym(w, shouted)]
    sure = len(own) == 1 and (bool(lab) or len(words) > 1 and any(is_acronym(w, shouted) for w in words))
    for w in own:
        rest = list(words)
        rest.remove(w)
        out.append(Reading("own name", "org", sure, latin(w).replace("-", ""), extra=lab, legal=abbreviated(rest, shouted)))
    return [*out, plain]


def left_out(core: str) -> set[str]:
    """core and what is left of it without one letter, and for long ones without two."""
    deep = 2 if len(core) >= 8 else 1 if len(core) >= 5 else 0
    return {"".join(ch for i, ch in enumerate(core) if i not in gone) for k in range(deep + 1) for gone in combinations(range(len(core)), k)}


def near_forms(core: str) -> tuple[set[str], set[str]]:
    """(own, sought): two cores of at most two slips share a form that one owns and the other seeks.

    Short cores own and seek what is left of them without letters. Of the five pieces of a long core, two slips, which may
    each touch two, leave one unchanged, moved by two letters at most; so their number grows no faster than the core.
    """
    if len(core) < LONG:
        forms = left_out(core)
        return forms, forms

    def bounds(n: int) -> list[int]:
        return [n * k // 5 for k in range(6)]

    n = len(core)
    own = {f"{n}|{k}|{core[a:b]}" for k, (a, b) in enumerate(zip(bounds(n), bounds(n)[1:]))}
    sought = {
        f"{size}|{k}|{core[a + s : b + s]}" for size in range(n - 2, n + 3) for k, (a, b) in enumerate(zip(bounds(size), bounds(size)[1:])) for s in range(-2, 3) if a + s >= 0 and b + s <= n
    }
    # lengths around the limit meet cores of the other sort
    return own | (left_out(core) if n < LONG + 2 else set()), sought | (left_out(core) if n < LONG + 2 else set())


def slips(a: str, b: str) -> bool:
    """Whether two cores differ by so few slips of the pen as their length allows: one, from eight letters on two."""
    return distance(a, b, 2) <= (2 if max(len(a), len(b)) >= 8 else 1)


def joined_ends(links: DataFrame, cores: DataFrame) -> DataFrame:
    """(core, label): every core with the surest and commonest of all cores that links (core, main) lead to, in both directions."""
    links = stored(links.unionByName(links.select(F.col("main").alias("core"), F.col("core").alias("main"))).distinct(), "links")
    ends = stored(links.select("core").distinct().join(cores, "core").select("core", F.struct("sure", "n", "core").alias("label")), "ends")
    while True:
        around = links.join(ends.select(F.col("core").alias("main"), "label"), "main").select("core", "label")
        after = stored(around.unionByName(ends).groupBy("core").agg(F.max("label").alias("label")), "ends")
        if after.join(ends.withColumnRenamed("label", "before"), "core").where("label <> before").isEmpty():
            return after
        ends = after


def main_spellings(cores: DataFrame) -> DataFrame:
    """(core, main): for each core with others that are its misspellings, the commonest of all that are linked with it.

    cores has core (a letter for its family, a colon, and the core), n (its rows), sure (whether a name is surely read so)
    and rests, what stands beside the core in its names: the abbreviation and laboratory of an organisation, both initials
    of a person; a rest that ends in ``|`` is partial. Near cores are linked if they share a whole rest. A core is linked to
    another whose rests its partial ones fit, or that nothing contradicts, if the rewriting that they share is rare: all
    near cores that it fits are spellings of one.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c in batch.column(0).to_pylist():
                own, sought = near_forms(c[2:])
                rows += [(c, c[:2] + f, f in own, f in sought) for f in sorted(own | sought)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.bool_()))], names=["core", "form", "own", "sought"])

    forms = stored(cores.select("core").mapInArrow(explode, "core string, form string, own boolean, sought boolean"), "forms")
    other = forms.where("own").select(F.col("core").alias("main"), "form")
    pairs = forms.where("sought").join(other, "form").where("core <> main and abs(length(core) - length(main)) <= 2")
    pairs = pairs.select(F.least("core", "main").alias("core"), F.greatest("core", "main").alias("main")).distinct()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([slips(a[2:], b[2:]) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

    close = pairs.mapInArrow(near, "core string, main string")
    side = lambda name, mark: cores.select(F.col("core").alias(name), F.col("rests").alias(f"{mark}rests"), F.col("sure").alias(f"{mark}sure"))
    close = stored(close.join(side("core", "a_"), "core").join(side("main", "b_"), "main").where("a_sure or b_sure"), "close")
    whole = lambda rests: F.filter(F.col(rests), lambda r: ~r.endswith("|"))
    agree = F.arrays_overlap(whole("a_rests"), whole("b_rests"))
    first = joined_ends(close.where(agree).select("core", "main"), cores)
    # both directions: core is the one that may be a misspelling of main
    fits = F.exists(F.filter("a_rests", lambda r: r.endswith("|")), lambda x: F.exists("b_rests", lambda y: y.startswith(x))) | (F.size("a_rests") == 0)
    back = close.select(F.col("main").alias("core"), F.col("core").alias("main"), F.col("b_rests").alias("a_rests"), F.col("a_rests").alias("b_rests"))
    loose = close.select("core", "main", "a_rests", "b_rests").unionByName(back).where(fits)
    labels = first.select(F.col("core").alias("main"), F.col("label.core").alias("label"))
    loose = loose.join(labels, "main", "left").select("core", "main", F.coalesce("label", "main").alias("label"), (F.size(whole("b_rests")) > 0).alias("whole"))
    loose = stored(loose, "loose")
    shared = loose.groupBy("core").agg(F.countDistinct("label").alias("all"), F.countDistinct(F.when(F.col("whole"), F.col("label"))).alias("wholes"))
    rare = loose.join(shared, "core").where("whole and wholes = 1 or wholes = 0 and all = 1").select("core", "main")
    ends = joined_ends(rare.unionByName(close.where(agree).select("core", "main")), cores)
    return ends.select("core", F.col("label.core").alias("main")).where("core <> main")


FIELDS = "name string, n long, rule string, kind string, sure boolean, core string, first string, second string, given string, extra string, legal string"


def read_names(names: DataFrame) -> DataFrame:
    """The readings of every name, a row each, with the columns of FIELDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), *(pa.string(),) * 6)
        for batch in batches:
            rows = [(name, n, *r) for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in readings(name)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[f.strip().split(" ")[0] for f in FIELDS.split(",")])

    return names.select("name", F.col("n").cast("bigint")).mapInArrow(run, FIELDS)


def chosen(rows: DataFrame) -> DataFrame:
    """One reading a name: the sure one; else as the person whose surname is surely one, in one order only; else as the
    organisation whose own name is surely one, the rarest of them; else its words in any order."""
    family = F.when(F.col("kind") == "word", "org").otherwise(F.col("kind"))
    rows = stored(rows.withColumn("family", family), "readings")
    known = stored(rows.where("sure").groupBy("family", "core").agg(F.count("*").alias("shared")), "known")
    rows = rows.join(known, ["family", "core"], "left")
    people = F.count_if((F.col("kind") == "person") & ~F.col("sure") & F.col("shared").isNotNull()).over(_by_name())
    rank = (
        F.when(F.col("sure"), 0).when((F.col("kind") == "person") & F.col("shared").isNotNull() & (people == 1), 1)
        .when(F.col("kind").isin("org", "word") & F.col("shared").isNotNull(), 2).when(F.col("kind").isin("other", "word"), 3)
    )
    ranked = rows.withColumn("rank", rank).where("rank is not null")
    fields = ["name", "rule", "kind", "core", "first", "second", "given", "extra", "legal"]
    best = F.min(F.struct("rank", F.coalesce("shared", F.lit(0)).alias("shared"), *fields[1:]))
    return ranked.groupBy("name").agg(best.alias("r")).select("name", "r.rank", *[f"r.{c}" for c in fields[1:]])


def _by_name():
    from pyspark.sql import Window

    return Window.partitionBy("name")  # the few readings of one name


def people(rows: DataFrame) -> DataFrame:
    """(name, entity, rule, score) of names read as persons, with core, first, second and given.

    Both initials make an entity; where they are shared by several given names, each is one of its own. A name with one
    initial is linked through the rarest rewriting that it has: its given name, if one entity alone fits it, or else its
    initial. All is counted by entity, so that no task holds the names of one surname.
    """
    pair = ["core", "first", "second"]
    known = rows.where("second <> ''").groupBy(*pair).agg(F.countDistinct(F.nullif("given", F.lit(""))).alias("givens"), F.max("given").alias("known_given"))
    known = stored(known, "people")
    whole = rows.where("second <> ''").join(known, pair)
    label = lambda *parts: F.concat_ws("|", F.lit("person"), *parts)
    split = F.when(F.col("givens") <= 1, label(*pair)).when(F.col("given") != "", label(*pair, "given")).otherwise(F.concat(F.lit("alone|"), "name"))
    out = whole.select("name", split.alias("entity"), F.lit("both initials").alias("rule"), F.lit(1.0).alias("score"))
    # entities by what a name with one initial may say: nothing more, or a given name
    one = known.groupBy("core", "first").agg(
        F.count("*").alias("all"), F.max("second").alias("any"), F.max("givens").alias("most"), F.count_if(F.col("givens") == 0).alias("open"), F.max(F.when(F.col("givens") == 0, F.col("second"))).alias("open_second")
    )
    fit = rows.where("second <> '' and given <> ''").select(*pair, "given").distinct().join(known.select(*pair, "givens"), pair)
    fit = fit.groupBy("core", "first", "given").agg(F.count("*").alias("fits"), F.max("second").alias("fit_second"), F.max("givens").alias("fit_givens"))
    short = rows.where("second = ''").join(one, ["core", "first"], "left").join(fit, ["core", "first", "given"], "left")
    none, at = F.col("all").isNull(), ["core", "first"]
    of = lambda second, givens: F.when(givens > 1, label(*at, second, "given")).otherwise(label(*at, second))
    own = label(*at, F.lit(""), "given")
    named = (
        F.when(F.coalesce("fits", F.lit(0)) + F.coalesce("open", F.lit(0)) == 1, F.when(F.col("fits") == 1, of(F.col("fit_second"), F.col("fit_givens"))).otherwise(label(*at, "open_second")))
        .when(F.col("fits") == 1, of(F.col("fit_second"), F.col("fit_givens"))).otherwise(own)
    )
    bare = F.when(none, own).when((F.col("all") == 1) & (F.col("most") <= 1), label(*at, "any")).otherwise(F.concat(F.lit("alone|"), "name"))
    score = F.when(F.col("given") != "", 1 / F.greatest(F.coalesce("fits", F.lit(0)) + F.coalesce("open", F.lit(0)), F.lit(1))).otherwise(1 / F.coalesce("all", F.lit(1)))
    shorts = short.select("name", F.when(none, own).when(F.col("given") != "", named).otherwise(bare).alias("entity"), F.when(F.col("given") != "", "given name").otherwise("one initial").alias("rule"), score.alias("score"))
    return out.unionByName(shorts)


def organisations(rows: DataFrame) -> DataFrame:
    """(name, entity, rule, score) of names read as organisations: own name and laboratory; score is one over the
    abbreviations that stand beside that own name, none being as good as any."""
    held = rows.groupBy("core").agg(F.countDistinct(F.nullif("legal", F.lit(""))).alias("forms"))
    return rows.join(held, "core").select("name", F.concat_ws("|", F.lit("org"), "core", "extra").alias("entity"), "rule", (1 / F.greatest("forms", F.lit(1))).alias("score"))


def entities(names: DataFrame) -> DataFrame:
    """(name, entity, rule, score): names with the same entity name the same person or organisation.

    names has a string column name and n, the number of its rows. rule is the rewriting that decided, score its rarity. A
    laboratory with a number is an entity of its own. One word alone is an organisation whose own name it is, never a
    person; other texts link to those of the same words. An empty table gives no rows.
    """
    parsed = stored(read_names(names), "readings")
    family = F.when(F.col("kind") == "word", "org").otherwise(F.col("kind"))
    rest = (
        F.when((F.col("kind") == "org") & (F.col("legal") != ""), F.concat_ws(":", "legal", "extra"))
        .when((F.col("kind") == "person") & (F.col("second") != ""), F.concat_ws("|", "first", "second"))
        .when(F.col("kind") == "person", F.concat("first", F.lit("|")))
    )
    key = F.concat(F.substring(family, 1, 1), F.lit(":"), F.col("core"))
    cores = parsed.where("kind in ('org', 'person', 'word')").groupBy(key.alias("core")).agg(F.sum("n").alias("n"), F.collect_set(rest).alias("rests"), F.max("sure").alias("sure"))
    main = main_spellings(stored(cores, "cores")).select(F.col("core").alias("key"), "main")
    rows = parsed.withColumn("key", key).join(main, "key", "left").withColumn("core", F.coalesce(F.expr("substring(main, 3)"), "core")).drop("main", "key")
    best = stored(chosen(rows), "chosen")
    surnames = best.where("kind = 'person'").select("core").distinct()
    orgs = best.where("kind = 'org' or kind = 'word' and rank = 2")
    others = best.where("kind = 'other'").unionByName(best.where("kind = 'word' and rank = 3").join(surnames, "core", "left_anti").select(best.columns))
    others = others.select("name", F.concat_ws("|", F.lit("other"), "core", "extra").alias("entity"), "rule", F.lit(1.0).alias("score"))
    return people(best.where("kind = 'person'")).unionByName(organisations(orgs)).unionByName(others)


def linked(names: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of different names of one entity, name_a before name_b by code points."""
    found = stored(entities(names).select("name", "entity"), "entities")
    a, b = found.select("entity", F.col("name").alias("name_a")), found.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()


def typed_names(df: DataFrame, column: str) -> DataFrame:
    """(name, n) of the values of a column that are one name: not NULL-like, and without a semicolon."""
    value = F.col(column)
    return df.where(~is_null_like(value) & ~value.contains(";")).groupBy(value.alias("name")).agg(F.count("*").alias("n"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return linked(typed_names(table(spark, folder, "facts"), "lab_or_author"))


def p7_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Each name with its entity, and the rule that decided, with the rarity of its rewriting."""
    return entities(typed_names(table(spark, folder, "facts"), "lab_or_author"))


QUERIES = {"p7_found": p7_found, "p7_entities": p7_entities}
SQL: dict[str, str] = {}
