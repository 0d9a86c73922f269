"""Text decoded with a wrong character encoding: found, and restored as far as it can be.

Each blank-separated token of a value is searched best-first over encode, decode and unescape steps; visited states are
kept by hash, and the cost of a state is how implausible its character pairs are under a model counted over the distinct
values, without those that a step between encodings of the same letters makes more plausible.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.session import stored
from orelode.sources.tables import table

# Single-byte encodings that text is wrongly read with, and what the bytes may really be.
WRONG = ("cp1251", "cp1252", "cp866", "koi8-r", "latin-1")
REAL = ("utf-8", "cp1251", "cp866", "koi8-r")
LOST = "�"
# Characters that clean text of this kind is made of; other texts don't count in the model of plausible pairs.
PLAIN = re.compile(r"^[\s\x21-\x7eа-яёА-ЯЁ«»“”„…–—‑№°·±²³×≤≥≈µμ℃Ø\xa0]*$")
LATIN_RUN = re.compile(r"[À-ÿ]{3}|[\x80-\x9f]|Ã|Â|Ð|Ñ")
ESCAPE = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|%[0-9A-F]{2}%[0-9A-F]{2}")
FLOOR = math.log(1e-7)
# Bounds of the search, all of them parameters of Repairer: the states that are expanded for a token (None for all within the
# other two), the steps that a text may have been through, what a state may cost more than the token itself, and the mean cost
# of a pair under which a token of plain characters that no step makes cheaper isn't searched (0: every token is).
EXPANDED, STEPS, DETOUR, USUAL = 60, 4, 12.0, 7.0
PROOF_LETTERS = 5  # letters that prove an exchange of two encodings of the same letters; shorter acronyms are rare pairs anyway
# Encodings of the same letters; a text read with the wrong one of them may still be of plain characters.
CYRILLIC = ("cp1251", "koi8-r", "cp866")
ROUNDS = 2  # times that the model is counted anew without the values that it finds garbled


def folded(text: str) -> str:
    """text in lower case with all digits alike, with a blank at each end."""
    return " " + re.sub(r"\d", "0", re.sub(r"\s", " ", text.lower())) + " "


def _countable(value: str) -> bool:
    """Whether value may be clean by its characters alone."""
    return bool(PLAIN.match(value) or not LATIN_RUN.search(value) and LOST not in value and not re.search(r"[А-яёЁ][^\W\dА-яёЁ_]|[─-▟]|[Ђ-џґ]", value))


def _pairs(values: DataFrame, model: dict[str, float] | None) -> dict[str, float]:
    """Logarithms of the shares of character pairs over values, without those that ``model``, if given, finds exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(model) if model else None
        for batch in batches:
            tokens: Counter = Counter()
            for value in batch.column(0).to_pylist():
                parts = value.split()
                if not (repairer and repairer.exchanged(parts)):
                    tokens.update(parts)
            pairs: Counter = Counter()
            for t, n in tokens.items():
                f = folded(t)
                for i in range(len(f) - 1):
                    pairs[f[i : i + 2]] += n
            yield pa.RecordBatch.from_arrays([pa.array(pairs.keys(), pa.string()), pa.array(pairs.values(), pa.int64())], names=["pair", "n"])

    counted = values.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = {r["pair"]: r["n"] for r in counted.collect()}
    total = sum(found.values()) or 1
    return {k: math.log(n / total) for k, n in found.items()}


def pair_model(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Logarithms of the shares of character pairs over all clean values; at most the square of the alphabet in size.

    Every distinct value counts once, so that no repeated one makes its own pairs usual. Garbled values of plain letters
    are left out by the model of all: the pairs of a garbled text are rarer than those of the original as long as most
    distinct values are clean.
    """

    def countable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(list(map(_countable, batch.column(0).to_pylist())), pa.bool_()))

    values = df.select(F.explode(F.array(*columns)).alias("value")).where("value <> ''").distinct()
    values = stored(values.mapInArrow(countable, "value string"), "values")
    model = _pairs(values, None)
    for _ in range(ROUNDS):
        model = _pairs(values, model)
    return model


class _Table(dict):
    """Characters to bytes (as characters) of a single-byte encoding; others to a character that stands for none."""

    def __init__(self, encoding: str):
        super().__init__()
        for byte in range(256):
            try:
                self[ord(bytes([byte]).decode(encoding))] = byte
            except UnicodeDecodeError:
                self[byte] = byte  # bytes that the encoding leaves undefined pass as control characters
        for control in range(0x80, 0xA0):
            self.setdefault(control, control)
        self[ord(LOST)] = ord("?")

    def __missing__(self, key: int) -> str:
        return "\uffff"


TABLES = {encoding: _Table(encoding) for encoding in WRONG}


def _bytes(text: str, encoding: str) -> bytes | None:
    """text in a single-byte encoding, lost characters as ``?``; None if it holds others than the encoding has."""
    try:
        return text.translate(TABLES[encoding]).encode("latin-1")
    except UnicodeEncodeError:
        return None


def steps(text: str) -> Iterator[tuple[str, str]]:
    """(name, text) of every state that one step leads to."""
    if ESCAPE.search(text):
        yield "unescape", html.unescape(text)
        try:
            yield "unescape", re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1] or m[2], 16)), text)
            yield "unescape", re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8"), text)
        except (ValueError, UnicodeDecodeError):
            pass
    for wrong in WRONG:
        raw = _bytes(text, wrong)
        if raw is None or raw.isascii():
            continue
        for real in REAL:
            if real == wrong:
                continue
            if real == "utf-8":
                decoded = raw.decode("utf-8", "replace")
                # what stays undecodable must be the lost bytes, a small part
                if decoded.count(LOST) * 3 > len(decoded) + 2:
                    continue
            else:
                decoded = raw.decode(real, "replace")
            if decoded != text:
                yield f"{wrong}>{real}", decoded


class Repairer:
    """Searches tokens and values; ``model`` is the result of pair_model."""

    def __init__(self, model: dict[str, float], step_cost: float = 1.0, gain: float = 1.2, expanded: int | None = EXPANDED, steps: int = STEPS, detour: float = DETOUR, usual: float = USUAL):
        self.model, self.step_cost, self.gain = model, step_cost, gain
        self.expanded, self.steps, self.detour, self.usual = expanded, steps, detour, usual
        self.alphabet = {ch for pair in model for ch in pair}
        self.token = lru_cache(maxsize=200_000)(self._token)
        self.gains = lru_cache(maxsize=200_000)(self._gains)
        self.doubtful = lru_cache(maxsize=200_000)(self._doubtful)
        self.clean: set[str] = set()  # tokens that were searched and have no cheaper text
        self.usual_: set[str] = set()  # tokens that no exchange makes cheaper

    def _known(self, found: set[str], token: str) -> None:
        if len(found) >= 1_000_000:
            found.clear()
        found.add(token)

    def cost(self, text: str) -> float:
        """Implausibility: minus the logarithms of the pair shares, summed, over what usual pairs have."""
        f, model = folded(text), self.model
        total = -sum(model.get(f[i : i + 2], FLOOR) for i in range(len(f) - 1)) / 4
        case = sum(a.islower() and b.isupper() for a, b in zip(text, text[1:]))
        shouted = 1.0 if len(text) > 1 and text.isupper() else 0.0
        strange = sum(ch not in self.alphabet for ch in f)
        return total + 4 * text.count(LOST) + case + shouted + 2 * strange

    def _gains(self, token: str) -> tuple[float, ...]:
        """What the token gains by each step between two encodings of the same letters; 0 where it can't be taken."""
        gains, start = [], None
        for wrong in CYRILLIC:
            raw = None if token.isascii() else _bytes(token, wrong)
            for real in CYRILLIC:
                if real != wrong:
                    new = raw.decode(real, "replace") if raw else token
                    if new == token or not PLAIN.match(new):
                        gains.append(0.0)
                    else:
                        start = self.cost(token) if start is None else start
                        gains.append(start - self.cost(new))
        return tuple(gains)

    def _doubtful(self, token: str) -> bool:
        return not token.isascii() and max(self.gains(token)) > 0

    def exchanged(self, tokens: list[str]) -> bool:
        """Whether some step between two encodings of the same letters makes the tokens of a value clearly cheaper."""
        if self.usual_.issuperset(tokens):
            return False
        doubtful = False
        for t in tokens:
            if self.doubtful(t):
                doubtful = True
            else:
                self._known(self.usual_, t)
        if not doubtful:
            return False
        return max(map(sum, zip(*(self.gains(t) for t in tokens)))) >= self.gain * 3 + 1

    def _token(self, token: str) -> tuple[str, str, float]:
        """(cheapest text, the steps to it, the gain) of a token; no steps if nothing is cheaper.

        A state is left as soon as the steps to what follows cost more than the cheapest text found.
        """
        plain = token.isascii()
        if plain and not ESCAPE.search(token):
            return token, "", 0.0
        start = self.cost(token)
        if start * 4 < self.usual * (len(token) + 1) and PLAIN.match(token) and not ESCAPE.search(token) and max(self.gains(token)) <= 0:
            return token, "", 0.0
        best = (start, token, "")
        seen = {hash(token)}
        heap = [(start, 0, token, "")]
        expanded = 0
        while heap and (self.expanded is None or expanded < self.expanded):
            cost, depth, text, path = heapq.heappop(heap)
            if cost < best[0]:
                best = (cost, text, path)
            if depth >= self.steps or cost > start + self.detour or self.step_cost * (depth + 1) >= best[0]:
                continue
            expanded += 1
            for name, new in steps(text):
                if (h := hash(new)) not in seen:
                    seen.add(h)
                    heapq.heappush(heap, (self.cost(new) + self.step_cost * (depth + 1), depth + 1, new, f"{path} {name}".strip()))
        return best[1], best[2], start - best[0]

    def value(self, value: str) -> tuple[str, bool, bool]:
        """(text, garbled, restored) of a value. A token alone must gain clearly; beside such tokens a weak gain does."""
        if value.isascii() and not ESCAPE.search(value):
            return value, False, True
        tokens = value.split(" ")
        if self.clean.issuperset(tokens):
            return value, LOST in value, LOST not in value
        found = [self.token(t) for t in tokens]
        for t, f in zip(tokens, found):
            if not f[1]:
                self._known(self.clean, t)
        # between two encodings of the same letters only enough of them are proof, in one word or in several
        enough = lambda t: sum(map(str.isalpha, t)) >= PROOF_LETTERS or not PLAIN.match(t)
        strong = {p for t, (x, p, g) in zip(tokens, found) if p and g >= self.gain * min(max(len(x), 3), 6) / 2 + 1 and enough(t)}
        together: dict[str, list[tuple[str, float]]] = {}
        for t, (_, p, g) in zip(tokens, found):
            if p and g > 0 and p not in strong and not enough(t):
                together.setdefault(p, []).append((t, g))
        for p, parts in together.items():
            if sum(sum(map(str.isalpha, t)) for t, _ in parts) >= 2 * PROOF_LETTERS and sum(g for _, g in parts) >= self.gain * 3 + 1:
                strong.add(p)
        lost = LOST in value
        if not strong:
            return value, lost, not lost
        out = []
        for t, (x, p, gain) in zip(tokens, found):
            if not t.isascii() and (p not in strong or gain < 0.5):
                x = self._along(t, strong)
            out.append(x)
        text = " ".join(out)
        return text, True, LOST not in text

    def _along(self, token: str, paths: set[str]) -> str:
        """token after the steps that its neighbours took, if every step can be taken strictly; else as it is."""
        for path in sorted(paths):
            text = token
            for name in path.split():
                wrong, _, real = name.partition(">")
                raw = _bytes(text, wrong) if real else None
                try:
                    text = html.unescape(text) if not real else raw.decode(real) if raw else ""
                except UnicodeDecodeError:
                    text = ""
                if not text:
                    break
            if text and self.cost(text) < self.cost(token) - 0.2:
                return text
        return token


def repaired(df: DataFrame, columns: list[str], model: dict[str, float] | None = None, keep: list[str] | None = None, **bounds: float | None) -> DataFrame:
    """Columns ``keep`` of df (all by default) and, for each column c of ``columns``, c__text, c__garbled, c__restored.

    NULL values give NULL, false, true; empty ones stay; texts of any length are searched token by token. A value that
    holds replacement characters is garbled and not restored, as their bytes are gone. ``bounds`` are those of Repairer.
    """
    model = pair_model(df, columns) if model is None else model
    keep = df.columns if keep is None else keep
    plain = df.select(*keep)
    source = df.select(*keep, *[F.col(c).alias(f"__{i}") for i, c in enumerate(columns)])
    fields = ", ".join(f"`{c}__text` string, `{c}__garbled` boolean, `{c}__restored` boolean" for c in columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(model, **bounds)
        memo: dict[str, tuple] = {}
        for batch in batches:
            arrays, names = list(batch.columns[: len(keep)]), list(batch.schema.names[: len(keep)])
            for c, column in zip(columns, batch.columns[len(keep) :]):
                if len(memo) > 100_000:
                    memo.clear()
                rows = []
                for v in column.to_pylist():
                    if v is None:
                        rows.append((None, False, True))
                    else:
                        r = memo.get(v)
                        if r is None:
                            r = memo[v] = repairer.value(v)
                        rows.append(r)
                for part, kind, i in (("text", pa.string(), 0), ("garbled", pa.bool_(), 1), ("restored", pa.bool_(), 2)):
                    arrays.append(pa.array([r[i] for r in rows], kind))
                    names.append(f"{c}__{part}")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = repaired(table(spark, folder, "facts"), ["source_quote", "material"], keep=["fact_id"])
    fields = F.array(*[F.when(F.col(f"{c}__garbled"), F.lit(c)) for c in ("source_quote", "material")])
    return rows.select("fact_id", F.explode(F.array_compact(fields)).alias("field"))


def p5_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled values with the text found for them."""
    rows = repaired(table(spark, folder, "facts").select("fact_id", "source_quote", "material"), ["source_quote", "material"])
    each = [
        F.struct(F.lit(c).alias("field"), F.col(c).alias("before"), F.col(f"{c}__text").alias("after"), F.col(f"{c}__garbled").alias("garbled"), F.col(f"{c}__restored").alias("restored"))
        for c in ("source_quote", "material")
    ]
    return rows.select("fact_id", F.explode(F.array(*each)).alias("v")).select("fact_id", "v.*").where("garbled").drop("garbled")


QUERIES = {"p5_found": p5_found, "p5_restored": p5_restored}
SQL: dict[str, str] = {}
