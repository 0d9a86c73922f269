"""Statistics of a text that tell natural prose from lists, tables and junk, with fixed thresholds and recorded reasons.

All is counted over arrays of code points, a batch of texts at a time: classes of characters through a table, words and
lines by the borders of their runs, words and lines that are equal by a rolling hash. No text is looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.memo import Memo
from orelode.sources.tables import table

# Function words of Russian and English, common in any prose.
COMMON_WORDS = (
    "и в во не на с со по к о об от до из за для при что это как а но или же после перед под над через без также его их "
    "был была было были быть который которая если когда только уже между того этого чем где так то бы мы он она они "
    "the of and in to a was were is are at for with by on from that as an this it be or which after before under over its than not"
).split()
# Published thresholds, with the name of the collection or corpus whose paper states them. Of Gopher's stop words
# two must occur, here of COMMON_WORDS, as the texts are Russian too.
PUBLISHED = {
    "gopher_words": (50, 100_000), "gopher_mean_word_length": (3, 10), "gopher_symbols": 0.1, "gopher_bullets": 0.9, "gopher_ellipsis": 0.3, "gopher_alphabetic": 0.8, "gopher_stop_words": 2,
    "gopher_repeated_lines": 0.3, "fineweb_line_punctuation": 0.12, "fineweb_short_lines": (30, 0.67), "fineweb_repeated_chars": 0.1, "c4_braces": 0,
}
# Thresholds of lines: the longest list entry and unmarked short line, in characters, and the share of the characters of a
# text from which its lines decide.
ENTRY_CHARS, SURE_ENTRY_CHARS, SHORT_CHARS, SHARE = 100, 60, 70, 0.5
BLOB = 30  # characters without a blank that are no word
BROKEN = 0.05  # symbols between two letters for each word, without those that words have, from which words are broken
SENTENCE_WORDS, SENTENCE_COMMON = 15, 0.15  # words from which prose has the end of a sentence, or this share of common words
IN_WORDS = "-‐‑–'’./,()"
BATCH_CHARS = 300_000  # looked at together, so that the arrays stay in the cache
BULLETS, MENU, CLOSERS, STOPS, ELLIPSIS = "-–—•*·▪●○◦", ">»›/", "\"»”)", ".!?…", "…"
LETTER, DIGIT, BLANK, UPPER, LOWER, STOP, CLOSER = (1 << i for i in range(7))
TABLE_SIZE = 0x3000  # code points that are looked up in a table; those above are few different ones
BASE = 0x9E3779B97F4A7C15 | 1

FIELDS = {
    "chars": pa.int64(), "words": pa.int64(), "lines": pa.int64(), "mean_word_length": pa.float64(), "symbol_ratio": pa.float64(), "digit_ratio": pa.float64(),
    "line_end_punctuation": pa.float64(), "bullet_lines": pa.float64(), "common_words": pa.float64(), "distinct_words": pa.int64(), "list_share": pa.float64(),
    "table_share": pa.float64(), "junk_share": pa.float64(), "reasons": pa.list_(pa.string()), "text_class": pa.string(),
}


def _class(ch: str) -> int:
    return LETTER * ch.isalpha() | DIGIT * ("0" <= ch <= "9") | BLANK * ch.isspace() | UPPER * ch.isupper() | LOWER * ch.islower() | STOP * (ch in STOPS) | CLOSER * (ch in CLOSERS)


@Memo
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(classes, lower case) of the code points under TABLE_SIZE."""
    chars = [chr(i) for i in range(TABLE_SIZE)]
    return np.array([_class(ch) for ch in chars], np.uint8), np.array([ord(low) if len(low := ch.lower()) == 1 else ord(ch) for ch in chars], np.uint32)


def classified(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes, lower case) of an array of code points."""
    classes, lower = tables()
    at = np.minimum(codes, TABLE_SIZE - 1)
    kinds, low = classes[at], lower[at]
    above = np.flatnonzero(codes >= TABLE_SIZE)
    if len(above):
        each, which = np.unique(codes[above], return_inverse=True)
        kinds[above] = np.array([_class(chr(c)) for c in each], np.uint8)[which]
        low[above] = codes[above]
    return kinds, low


@Memo
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 ** 64, the first n."""
    with np.errstate(over="ignore"):
        up = np.full(n, BASE, np.uint64)
        down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def _counts(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often a mask holds in each [start, end)."""
    if np.count_nonzero(mask) * 8 < len(mask):
        at = np.flatnonzero(mask)
        return np.searchsorted(at, ends) - np.searchsorted(at, starts)
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)]).astype(np.int64)
    return total[ends] - total[starts]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of a mask."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _is(codes: np.ndarray, chars: str) -> np.ndarray:
    out = codes == ord(chars[0])
    for ch in chars[1:]:
        out |= codes == ord(ch)
    return out


@Memo
def common_hashes() -> np.ndarray:
    up, _ = powers(64)
    with np.errstate(over="ignore"):
        return np.sort(np.array([np.sum((np.array([ord(c) for c in w], np.uint64) + np.uint64(1)) * up[: len(w)]) for w in COMMON_WORDS], np.uint64))


class Batch:
    """The texts of a batch as one array of code points, each text followed by a line end."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        joined = "\n".join(texts) + "\n" * 8
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = codes
        self.kinds, low = classified(codes)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        self.ends = self.starts + self.lengths
        self.is_end = (codes == 10) | (codes == 13)
        up, self.down = powers(1 << int(np.ceil(np.log2(len(codes) + 1))))
        with np.errstate(over="ignore"):
            self.hash_total = np.concatenate([[np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])])

    def has(self, kind: int) -> np.ndarray:
        return (self.kinds & kind) > 0

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the parts of the text in lower case, equal for equal parts."""
        with np.errstate(over="ignore"):
            return (self.hash_total[ends] - self.hash_total[starts]) * self.down[starts]


def _next(positions: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """The first of the sorted positions that isn't before ``at``, end if there is none."""
    return np.concatenate([positions, [end]])[np.searchsorted(positions, at)]


def _lines(b: Batch) -> dict[str, np.ndarray]:
    """Statistics of every line that isn't blank, with the number of its text."""
    codes, n = b.codes, len(b.codes)
    space, letter, digit, stop = b.has(BLANK), b.has(LETTER), b.has(DIGIT), b.has(STOP)
    borders = np.flatnonzero(b.is_end)
    first, last = np.concatenate([[0], borders[:-1] + 1]), borders
    keep = _counts(~space, first, last) > 0
    first, last = first[keep], last[keep]
    doc = np.searchsorted(b.starts, first, "right") - 1
    inside = first < b.ends[doc]
    first, last, doc = first[inside], last[inside], doc[inside]
    size = last - first
    count = lambda mask: _counts(mask, first, last)
    after = np.roll(space, -1)
    prior, following = np.roll(codes, 1), np.roll(codes, -1)
    tab, bar = codes == 9, codes == ord("|")
    gap = (codes == 32) & (following == 32) & (np.roll(codes, -2) == 32) & (prior != 32)
    out = {"doc": doc, "first": first, "last": last, "size": size, "digits": count(digit), "stops": count(stop & after)}
    out["symbols"] = size - count(letter | digit) - count(space)
    out["tabs"], out["bars"] = count(tab), count(bar & (prior == 32) & (following == 32))
    out["cells"] = out["tabs"] + count(bar) + count((codes == ord(";")) & after) + count(gap)
    out["menu"] = count(_is(codes, MENU) & (prior == 32) & (following == 32))
    # the longest part without a blank
    a, e = _runs(~space)
    longest = np.zeros(len(first), np.int64)
    line = np.searchsorted(first, a, "right") - 1
    good = (line >= 0) & (a < last[np.maximum(line, 0)]) if len(first) else np.zeros(len(a), bool)
    np.maximum.at(longest, line[good], (e - a)[good])
    out["blob"] = longest
    # the end of a sentence at the end: the last character that is neither blank nor closes a quotation
    solid = np.flatnonzero(~(space | b.has(CLOSER)))
    tail = solid[np.maximum(np.searchsorted(solid, last) - 1, 0)] if len(solid) else np.zeros(len(first), np.int64)
    out["sentence"] = (tail >= first) & stop[tail]
    out["ellipsis"] = out["sentence"] & ((codes[tail] == ord(ELLIPSIS)) | (codes[tail] == ord(".")) & (codes[tail - 1] == ord(".")) & (codes[tail - 2] == ord(".")))
    # the end of a sentence within: a stop, blanks, and a capital
    dots = np.flatnonzero(stop & after & ~np.roll(b.is_end, -1))
    shown = np.flatnonzero(~space | b.is_end)
    inner = np.zeros(n, bool)
    inner[dots[b.has(UPPER)[_next(shown, dots + 1, n - 1)]]] = True
    out["inner"] = count(inner) > 0
    # a number and a short word with a full stop at the end, as in "5 кг.", and no other stop
    plain = np.flatnonzero(~letter)
    begin = plain[np.maximum(np.searchsorted(plain, tail) - 1, 0)]
    short = tail - begin - 1
    out["counted"] = out["sentence"] & (count(stop) == 1) & (codes[tail] == ord(".")) & (short >= 1) & (short <= 4) & (codes[begin] == 32) & digit[begin - 1]
    # marks before a list entry
    head = _next(np.flatnonzero(~space), first, n - 1)
    free = space & ~b.is_end
    number = np.flatnonzero(~digit)
    opened = head + (codes[head] == ord("("))
    stopped = _next(number, opened, n - 1)
    some = lambda a, z: (z > a) & (z - a <= 4)
    numbered = some(opened, stopped) & _is(codes[stopped], ".)") & free[np.minimum(stopped + 1, n - 1)]
    closed = _next(number, head + 1, n - 1)
    out["reference"] = (codes[head] == ord("[")) & some(head + 1, closed) & (codes[closed] == ord("]")) & free[np.minimum(closed + 1, n - 1)]
    lettered = b.has(LOWER)[head] & (codes[head + 1] == ord(")")) & free[head + 2]
    out["bullet"] = _is(codes[head], BULLETS) & free[head + 1] | numbered | out["reference"] | lettered
    return out


def described_batch(texts: list[str]) -> list[list]:
    """The columns of FIELDS for some texts."""
    b = Batch(texts)
    docs = len(texts)
    codes = b.codes
    letter, digit, space = b.has(LETTER), b.has(DIGIT), b.has(BLANK)
    count = lambda mask: _counts(mask, b.starts, b.ends)
    ws, we = _runs(letter)
    of = np.searchsorted(b.starts, ws, "right") - 1
    word_hash = b.hashes(ws, we)
    known = common_hashes()
    is_common = known[np.minimum(np.searchsorted(known, word_hash), len(known) - 1)] == word_hash
    per = lambda doc, weights=None: np.bincount(doc, weights, docs)[:docs]
    n_words, common = per(of).astype(np.int64), per(of, is_common).astype(np.int64)
    order = np.lexsort((word_hash, of))
    fresh = np.concatenate([[True], (word_hash[order][1:] != word_hash[order][:-1]) | (of[order][1:] != of[order][:-1])])[: len(order)]
    distinct = per(of[order][fresh]).astype(np.int64)
    letters, digits, blanks = count(letter), count(digit), count(space)
    chars = b.lengths
    symbols = np.maximum(chars - letters - digits - blanks, 0)
    ts, te = _runs(~space)
    part_of = np.searchsorted(b.starts, ts, "right") - 1
    parts, lettered = per(part_of), per(part_of, _counts(letter, ts, te) > 0)
    dots = (codes == ord(".")) & (np.roll(codes, -1) == ord(".")) & (np.roll(codes, -2) == ord("."))
    marks = count((codes == ord("#")) | (codes == ord(ELLIPSIS)) | dots & ~np.roll(dots, 1))

    within = ~(letter | digit | space) & np.roll(letter, 1) & np.roll(letter, -1) & ~_is(codes, IN_WORDS)
    broken, stops = count(within), count(b.has(STOP) & np.roll(space, -1))

    x = _lines(b)
    doc, size = x["doc"], x["size"]
    lines = per(doc)
    ends, bullets, inner, ellipsis = (per(doc, x[c]) for c in ("sentence", "bullet", "inner", "ellipsis"))
    total = per(doc, size)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, doc, size)
    # what a line is: the first that fits
    common_total = np.concatenate([[0], np.cumsum(is_common)])
    has_common = common_total[np.searchsorted(ws, x["last"])] > common_total[np.searchsorted(ws, x["first"])]
    junk = (size >= BLOB) & (x["blob"] >= BLOB) & (2 * x["blob"] > size) | (x["menu"] >= 2) & (x["tabs"] == 0) & (x["digits"] == 0) | (2 * x["symbols"] > size)
    rows = (x["tabs"] > 0) | (x["bars"] > 0) | (x["cells"] >= 2) & ~(x["sentence"] & (x["digits"] * 8 < size))
    entry = x["bullet"] & ((size <= ENTRY_CHARS) & ~x["sentence"] | (size <= SURE_ENTRY_CHARS) | x["reference"])
    bare = (size <= SHORT_CHARS) & ((x["stops"] == 0) | x["counted"])
    kind = np.select([junk, rows, entry, bare & has_common, bare], [0, 1, 2, 3, 4], 5)
    junk_chars, row_chars, entry_chars, wrapped, unmarked = (per(doc[kind == k], size[kind == k]) for k in range(5))
    # unmarked short lines are entries of a list where few of them hold a function word and few lines of the text hold the
    # end of a sentence within, else the wrapped lines of prose
    loose = wrapped + unmarked
    listed = entry_chars + np.where((wrapped < 0.35 * loose) & (inner < 0.25 * lines) & (lines >= 3), loose, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = lambda a, c: np.where(c > 0, a / c, np.nan)
        list_share, table_share, junk_share = share(listed, total), share(row_chars, total), share(junk_chars, total)
        mean, line_end, bullet_lines, common_share = share(letters, n_words), share(ends, lines), share(bullets, lines), share(common, n_words)
        symbol_ratio, digit_ratio = share(symbols, chars), share(digits, chars)
        alphabetic, ellipses, mark_share = share(lettered, parts), share(ellipsis, lines), share(marks, n_words)
        short_lines = share(per(doc, size < PUBLISHED["fineweb_short_lines"][0]), lines)
        line_hash = b.hashes(x["first"], x["last"])
        order = np.lexsort((line_hash, doc))
        again = np.concatenate([[False], (line_hash[order][1:] == line_hash[order][:-1]) & (doc[order][1:] == doc[order][:-1])])[: len(order)]
        repeated, repeated_chars = share(per(doc[order][again]), lines), share(per(doc[order][again], size[order][again]), total)
        structured = (total > 0) & (list_share + table_share > SHARE)
        p = PUBLISHED
        failed = {
            "gopher_words": (n_words < p["gopher_words"][0]) | (n_words > p["gopher_words"][1]), "gopher_mean_word_length": ~((mean >= p["gopher_mean_word_length"][0]) & (mean <= p["gopher_mean_word_length"][1])),
            "gopher_symbols": mark_share > p["gopher_symbols"], "gopher_bullets": bullet_lines > p["gopher_bullets"], "gopher_ellipsis": ellipses > p["gopher_ellipsis"], "gopher_alphabetic": ~(alphabetic >= p["gopher_alphabetic"]),
            "gopher_stop_words": common < p["gopher_stop_words"], "gopher_repeated_lines": repeated > p["gopher_repeated_lines"], "fineweb_line_punctuation": ~(line_end > p["fineweb_line_punctuation"]),
            "fineweb_short_lines": short_lines >= p["fineweb_short_lines"][1], "fineweb_repeated_chars": repeated_chars >= p["fineweb_repeated_chars"], "c4_braces": count((codes == ord("{")) | (codes == ord("}"))) > 0,
        }
        nonsense = {
            "empty": total == 0, "junk_lines": junk_share > SHARE, "mostly_symbols": symbols > 0.5 * np.maximum(chars, 1), "mostly_digits": ~structured & (digits > 0.5 * chars) & (chars > 0),
            "few_distinct_words": ~structured & ((n_words >= 10) & (distinct * 5 <= n_words) & (distinct <= 20) | (distinct < 0.04 * n_words)),
            "broken_words": (n_words > 0) & ((broken > BROKEN * n_words) | ~structured & failed["gopher_mean_word_length"]),
            "no_sentence": ~structured & (n_words >= SENTENCE_WORDS) & (stops == 0) & (common < SENTENCE_COMMON * n_words),
            "few_common_words": ~structured & (longest > 100) & (n_words >= 10) & (common < 0.05 * n_words) & (ends < 0.3 * lines),
        }
    is_junk = np.logical_or.reduce(list(nonsense.values()))
    is_table = structured & (table_share >= list_share)
    failed |= nonsense | {"table_rows": is_table, "list_entries": structured & ~is_table}
    names = np.array(list(failed))
    flags = np.stack(list(failed.values()), axis=1)
    reasons = [names[f].tolist() for f in flags]
    text_class = np.select([is_junk, is_table, structured], ["junk", "table", "list"], "prose").tolist()
    clean = lambda v: pa.array(v, pa.float64(), from_pandas=True)
    return [
        pa.array(chars), pa.array(n_words), pa.array(lines.astype(np.int64)), *map(clean, (mean, symbol_ratio, digit_ratio, line_end, bullet_lines, common_share)), pa.array(distinct),
        *map(clean, (list_share, table_share, junk_share)), pa.array(reasons, FIELDS["reasons"]), pa.array(text_class, pa.string()),
    ]


def described(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row a document: its id, statistics, the reasons, one for each rule that failed, and text_class.

    text_class is prose, list, table or junk. The published rules and those that decide the class are all recorded; a text of
    prose may fail published rules, as one under fifty words does. NULL, empty and blank texts are junk for the reason
    ``empty``, with shares that are NULL. Other columns of df aren't kept; repeated rows give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (chars == 0 or chars + len(texts[stop]) <= BATCH_CHARS):
                    chars += len(texts[stop]) + 1
                    stop += 1
                yield pa.RecordBatch.from_arrays([ids.slice(at, stop - at), *described_batch(texts[at:stop])], names=["id", *FIELDS])
                at = stop

    names = {pa.int64(): "long", pa.float64(): "double", pa.string(): "string", pa.list_(pa.string()): "array<string>"}
    schema = "id long, " + ", ".join(f"{c} {names[k]}" for c, k in FIELDS.items())
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column)).mapInArrow(run, schema)
    return rows.withColumnRenamed("id", id_column)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return described(table(spark, folder, "documents"), "doc_id", "text").where("text_class <> 'prose'").select("doc_id", "text_class")


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return described(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics}
SQL: dict[str, str] = {}
