"""Oversized texts cut into pieces at natural boundaries by content-defined chunking.

A rolling hash over the text marks landmarks; each cut is the first landmark past the least size, snapped to the nearest
natural boundary, so that an edit moves only the cuts beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.sources.tables import table

WINDOW = 32
PARAGRAPH = re.compile(r"\n\s*\n")
SENTENCE = re.compile(r"[.!?…][\"»”)\]]*\s+")
LINE = re.compile(r"\n")
WORD = re.compile(r"\s+")
MARK = re.compile(r"[;,|/]")
REACH = ((PARAGRAPH, "paragraph", 600), (SENTENCE, "sentence", 400), (LINE, "line", 200), (WORD, "word", 10**9), (MARK, "mark", 10**9))


def landmarks(text: str, every: int) -> np.ndarray:
    """Positions (code points) after which the hash of the last WINDOW characters is a multiple of ``every``, on average so far apart."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = codes * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    power, span = np.uint32(0x01000193), 1
    while span < WINDOW:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span]
        h = h + power * shifted
        power = np.uint32((int(power) * int(power)) & 0xFFFFFFFF)
        span *= 2
    h ^= h >> np.uint32(13)
    return np.flatnonzero(h % np.uint32(every) == 0) + 1


def snap(text: str, at: int, low: int, high: int) -> tuple[int, str]:
    """The natural boundary nearest to ``at`` in [low, high], the better kinds from farther away; ``at`` itself if there is none."""
    for pattern, kind, reach in REACH:
        a, b = max(low, at - reach), min(high, at + reach)
        start = max(0, a - 60)
        ends = [m.end() + start for m in pattern.finditer(text[start : b + 60])]
        ends = [e for e in ends if a <= e <= b]
        if ends:
            return min(ends, key=lambda e: (abs(e - at), e)), kind
    return min(max(at, low), high), "none"


def cuts(text: str, limit: int = 3000, overlap: int = 300, least: int = 1000, every: int = 512) -> list[tuple[int, str]]:
    """(position, kind) of the cuts of a text longer than limit, without its ends.

    Between two cuts are ``least`` characters at least and ``limit - overlap`` at most, so that a piece with its overlap
    stays within the limit; the rest after the last cut may be shorter.
    """
    if not 0 <= overlap < limit - least or least < 1:
        raise ValueError("the overlap and the least size must leave room for cuts under the limit")
    marks, n, room = landmarks(text, every), len(text), limit - overlap
    found, last = [], 0
    while n - last > room:
        low, high = last + least, last + room
        i = int(np.searchsorted(marks, low))
        at = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        cut, kind = snap(text, at, low, high)
        found.append((cut, kind))
        last = cut
    return found


def long_paragraphs(text: str, limit: int) -> list[int]:
    """Numbers from 1, among the paragraphs that aren't empty, of those that are longer than limit without outer white space."""
    if len(text) <= limit:
        return []
    found, number = [], 0
    for part in PARAGRAPH.split(text):
        if part := part.strip():
            number += 1
            if len(part) > limit:
                found.append(number)
    return found


def pieces(df: DataFrame, id_column: str, text_column: str, limit: int = 3000, overlap: int = 300) -> DataFrame:
    """The pieces of every text of df.

    Columns: id, piece_no from 1, start, stop (code points, with the overlap), cut (kind of boundary at its end: paragraph,
    sentence, line, word, mark, none, or end for the last), n_chars of the text, long_paragraphs (numbers of the paragraphs that
    alone exceed the limit), piece. A text within the limit is one piece; a NULL or empty text gives none. Each piece but
    the first begins exactly ``overlap`` characters before the cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string())
        names = ["id", "piece_no", "start", "stop", "cut", "n_chars", "long_paragraphs", "piece"]
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part, rows = batch.slice(k, 200), []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not text:
                        continue
                    n, paragraphs = len(text), long_paragraphs(text, limit)
                    ends = [*(cuts(text, limit, overlap) if n > limit else ()), (n, "end")]
                    before = 0
                    for no, (stop, kind) in enumerate(ends, 1):
                        start = max(0, before - overlap) if no > 1 else 0
                        rows.append((i, no, start, stop, kind, n, paragraphs, text[start:stop]))
                        before = stop
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    schema = "id long, piece_no int, start long, stop long, cut string, n_chars long, long_paragraphs array<long>, piece string"
    return df.select(F.col(id_column).cast("bigint"), F.col(text_column)).mapInArrow(run, schema)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts over the limit (para_no 0) and their paragraphs over it, from the first piece of each text."""
    first = pieces(table(spark, folder, "extracted"), "text_id", "text").where("piece_no = 1 and n_chars > 3000")
    return first.select(F.col("id").alias("text_id"), F.explode(F.concat(F.array(F.lit(0).cast("bigint")), "long_paragraphs")).alias("para_no"))


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces(table(spark, folder, "extracted"), "text_id", "text").select(F.col("id").alias("text_id"), "piece_no", "start", "stop", "cut", "piece")


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces}
SQL = {
    "p6_found": r"""
WITH big AS (SELECT text_id, text FROM extracted WHERE length(text) > 3000),
parts AS (
  SELECT text_id, list_filter(
    list_transform(regexp_split_to_array(text, '\n[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]*\n'),
      lambda x: regexp_replace(x, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+$', '', 'g')),
    lambda x: x <> '') AS p FROM big),
numbered AS (SELECT text_id, unnest(p) AS para, unnest(range(1, len(p) + 1)) AS para_no FROM parts)
SELECT text_id, CAST(0 AS BIGINT) AS para_no FROM big
UNION ALL
SELECT text_id, CAST(para_no AS BIGINT) FROM numbered WHERE length(para) > 3000
"""
}
