"""Greedy chunks of paragraphs with an overlap, as texts are cut for extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import WS, doc_clean, paragraphs

BLANK_LINE = "\n\n"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def windows(paragraph: Column, size: int, overlap: int) -> Column:
    """ARRAY of the windows of ``size`` over a paragraph, stripped, the last the first that reaches its end; without empty ones."""
    stride = max(1, size - overlap)
    last = F.ceil((F.length(paragraph) - size) / F.lit(stride)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: stripped(F.substring(paragraph, i * stride + 1, F.lit(size))))
    return F.filter(cut, lambda w: w != "")


def greedy_chunks(text: Column, size: int = 3000, overlap: int = 300) -> Column:
    """ARRAY of the chunks of a text: its paragraphs, after cleaning, joined by blank lines as long as they fit in ``size``.

    A paragraph that doesn't fit begins a new chunk behind the stripped last ``overlap`` characters of the chunk before and a
    blank line, so that such a chunk may exceed the size. A paragraph longer than the size is cut into windows, which carry
    nothing over on either side. NULL gives NULL, a text without a paragraph an empty array.
    """
    some = lambda x: F.when(x != "", F.array(x)).otherwise(F.array().cast("array<string>"))
    state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))

    def take(s: Column, p: Column) -> Column:
        joined = F.concat(s["open"], F.lit(BLANK_LINE), p)
        tail = stripped(F.right(s["open"], F.lit(overlap))) if overlap else F.lit("")
        carried = F.when(tail != "", F.concat(tail, F.lit(BLANK_LINE), p)).otherwise(p)
        return (
            F.when(F.length(p) > size, state(F.concat(s["done"], some(s["open"]), windows(p, size, overlap)), F.lit("")))
            .when(s["open"] == "", state(s["done"], p))
            .when(F.length(joined) <= size, state(s["done"], joined))
            .otherwise(state(F.concat(s["done"], F.array(s["open"])), carried))
        )

    start = state(F.array().cast("array<string>"), F.lit(""))
    return F.aggregate(paragraphs(doc_clean(text)), start, take, lambda s: F.concat(s["done"], some(s["open"])))


def chunked(df: DataFrame, id_column: str, text_column: str, size: int = 3000, overlap: int = 300) -> DataFrame:
    """(id, chunk_id from 1, chunk) of every text; NULL, empty and blank texts give none."""
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.posexplode(greedy_chunks(F.col(text_column), size, overlap)).alias("i", "chunk"))
    return rows.select("id", (F.col("i") + 1).cast("bigint").alias("chunk_id"), "chunk")
