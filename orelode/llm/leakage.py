"""Evaluation passages inside a corpus, found through a positional inverted index.

The index holds every term of every document: a row for each term and segment, a segment being some neighbouring
documents, with the places at which the term stands. It is built once, whatever the items are. The rarest terms of the
items are joined to it by term; their lists, shifted by the place of the term in the item, are intersected, and where
enough of them agree the document is opened and all of its words are aligned with the item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.memo import Memo
from orelode.session import stored
from orelode.sources.tables import table

TOKEN = re.compile(r"\d+(?:[.,]\d+)?|[^\W\d_]+")
INDEX = "segment long, term string, n int, places array<int>, docs array<long>, bounds array<int>"
GAP = 100_000  # positions between two documents of a segment; no stretch goes over it
SEGMENT_CHARS = 2_000_000
SHARE, LEAST = 0.4, 12  # what of an item must stand in a document: the share of its words, and their least number
DENSITY = 0.84  # least share of matching words in the span of a stretch, so that few are altered, added or dropped
SHORTEST = 5  # words of the shorter of two stretches
CARRIED = 1_000_000  # words of all items up to which every task holds the items; beyond, they are joined to the documents
GROUP = 512  # items beside one copy of a text, at most
ANCHORS = 3  # rare words that must agree in one stretch


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def needed(n: int, share: float = SHARE, least: int = LEAST) -> int:
    """Words of an item of n words that must stand in a document."""
    return max(least, int(np.ceil(share * n)))


def slack(n: int, density: float = DENSITY) -> int:
    """Words that may be altered, added or dropped in a stretch of n matching words."""
    return int(n / density + 1e-9) - n


@Memo
def least_runs(n: int, need: int, density: float = DENSITY, shortest: int = SHORTEST) -> int:
    """The least number of three words in a row that an item of n words shares with a document that holds ``need`` of them.

    A stretch of m words with k altered ones falls into k + 1 parts at most, and a part of m words has m - 2 such runs.
    """
    runs = {m: max(1, m - 2 * (slack(m, density) + 1)) for m in range(shortest, n + 1)}
    two = (runs[a] + runs[b] for a in runs for b in range(max(shortest, need - a), n - a + 1))
    return min([runs[m] for m in range(max(need, shortest), n + 1)] + list(two), default=1)


class Document:
    """The words of a text with their places, and its runs of three words."""

    def __init__(self, text: str):
        words = tokens(text)
        self.runs = set(zip(words, words[1:], words[2:]))
        self.at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            self.at.setdefault(w, []).append(i)


def positional_index(corpus: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The positional index of corpus, with the columns of INDEX.

    A row with a term has its places in one segment, in order, and their number n; the row of a segment without a term has
    the ids of its documents and the place where each begins. NULL and empty texts have no places, and documents without an
    id take no part. A segment holds about
    SEGMENT_CHARS characters, and at least one document, so that a frequent term is spread over many rows.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        bounds: list[int] = []
        words: list[str] = []
        places: list[np.ndarray] = []
        place = chars = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal place, chars, segment
            found = pa.array(words, pa.string()).dictionary_encode()
            code = found.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            at = np.concatenate([*places, np.empty(0, np.int32)])[order]
            n = np.bincount(code, minlength=len(found.dictionary)).astype(np.int32)
            starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            rows = len(n)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(at))
            batch = pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, segment)), found.dictionary, pa.array(n), lists, pa.nulls(rows, pa.list_(pa.int64())), pa.nulls(rows, pa.list_(pa.int32()))], names=names
            )
            yield batch.take(pc.sort_indices(found.dictionary))
            last = [pa.array([segment]), pa.nulls(1, pa.string()), pa.array([0], pa.int32()), pa.nulls(1, pa.list_(pa.int32())), pa.array([ids], pa.list_(pa.int64())), pa.array([bounds], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(last, names=names)
            ids.clear(), bounds.clear(), words.clear(), places.clear()
            place = chars = 0
            segment += 1

        names = ["segment", "term", "n", "places", "docs", "bounds"]
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = tokens(text) if text else []
                ids.append(doc)
                bounds.append(place)
                words += found
                places.append(np.arange(place, place + len(found), dtype=np.int32))
                place += len(found) + GAP
                chars += len(text or "")
                if chars >= SEGMENT_CHARS or place > 2**31 - 2**28:
                    yield from flush()
        if ids:
            yield from flush()

    return corpus.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column)).where("id is not null").mapInArrow(build, INDEX)


def query_terms(items: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(item_id, words, need) of the items that have ``least`` words or more; one row for each distinct id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, w, needed(len(w), share, least)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if len(w := tokens(t or "")) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.list_(pa.string()), pa.int32()))], names=["item_id", "words", "need"])

    return items.select(F.col("item_id").cast("bigint"), "text").where("text is not null").distinct().mapInArrow(run, "item_id long, words array<string>, need int")


def rare_places(query: DataFrame, index: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(item, term, offset, size): the places of each item that are looked up, its rarest words by the counts of the index.

    A document that lacks at most len - need of the words of an item holds at least k of any len - need + k; of
    2 * anchors - 1 of them, standing in one or two stretches, at least ``anchors`` stand in the same stretch.
    """
    each = query.select("item", "need", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term"))
    terms = stored(each.select("term").distinct(), "terms")
    counts = index.where("term is not null").select("term", "n").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    ranked = each.join(counts, "term", "left").groupBy("item", "need", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("w"))  # the words of one item
    taken = ranked.select("item", "size", F.explode(F.slice("w", F.lit(1), F.col("size") - F.col("need") + (2 * anchors - 1))).alias("w"))
    return taken.select("item", "w.term", "w.offset", "size")


def dense_anchors(hit: np.ndarray, rare: np.ndarray, anchors: int = ANCHORS, density: float = DENSITY) -> bool:
    """Whether some part of an item with ``anchors`` hits lacks so few of its rare words that it can be a stretch.

    hit and rare are masks over the words of the item; words that aren't rare count as present, as they weren't looked up.
    """
    held = np.cumsum(hit)
    if held[-1] < anchors:
        return False
    total = np.concatenate([[0.0], np.cumsum(np.where(rare & ~hit, -density, 1 - density))])
    least = np.minimum.accumulate(total)
    ends = np.flatnonzero(held >= anchors)
    latest = np.flatnonzero(hit)[held[ends] - anchors]  # the part begins at this hit or before it
    return bool((least[latest] <= total[ends + 1] + 1e-9).any())


def candidates(index: DataFrame, query: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, item): the documents in which ``anchors`` rare words of an item agree in their places as in a stretch.

    The lists of the rare words of an item meet segment by segment. The places are written in one array, each list behind
    the negative number of its word.
    """
    rare = stored(rare_places(query, index, anchors), "rare")
    places_of = rare.groupBy("item", "size").agg(F.collect_list("offset").alias("rare"))
    hits = index.where("term is not null").select("segment", "term", "places").join(rare.drop("size"), "term")
    hits = hits.select("item", "segment", F.concat(F.array(-F.col("offset") - 1), "places").alias("list"))
    grouped = hits.groupBy("item", "segment").agg(F.flatten(F.collect_list("list")).alias("lists"), F.count("*").alias("n")).where(F.col("n") >= anchors)
    rows = grouped.join(places_of, "item").join(stored(index.where("term is null").select("segment", "docs", "bounds"), "segments"), "segment")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for item, size, rare_, lists, docs, bounds in zip(*batch.columns):
                n, v = size.as_py(), lists.values.to_numpy()
                head = v < 0
                offset = (-v[head] - 1)[np.cumsum(head) - 1][~head]
                place = v[~head]
                doc = np.searchsorted(bounds.values.to_numpy(), place, "right") - 1
                shifted = place - offset
                order = np.lexsort((shifted, doc))
                doc, shifted, offset = doc[order], shifted[order], offset[order]
                last = len(doc) - anchors + 1
                if last <= 0:
                    continue
                near = (doc[anchors - 1 :] == doc[:last]) & (shifted[anchors - 1 :] - shifted[:last] <= slack(n))
                starts = np.flatnonzero(near)
                if not len(starts):
                    continue
                mask = np.zeros(n, bool)
                mask[rare_.values.to_numpy()] = True
                # starts that follow each other closely are looked at as one
                groups = np.split(starts, np.flatnonzero(np.diff(starts) >= anchors) + 1)
                for g in groups:
                    a, b = g[0], g[-1] + anchors - 1
                    if doc[a] != doc[b]:
                        parts = np.split(np.arange(a, b + 1), np.flatnonzero(np.diff(doc[a : b + 1])) + 1)
                    else:
                        parts = [slice(a, b + 1)]
                    for part in parts:
                        hit = np.zeros(n, bool)
                        hit[offset[part]] = True
                        if dense_anchors(hit, mask, anchors):
                            found.add((docs.values[int(doc[part][0])].as_py(), item.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["doc_id", "item"])

    return rows.select("item", "size", "rare", "lists", "docs", "bounds").mapInArrow(agree, "doc_id long, item long").distinct()


def _chains(g: list[int], p: list[int], skip: int) -> list[list[int]]:
    """Chains of matching pairs in the order of both texts, with at most ``skip`` words between; a word between costs a match."""
    n = len(g)
    score, before, follows = [1.0] * n, [-1] * n, [False] * n
    for j in range(n):
        for i in range(j - 1, -1, -1):
            dg = g[j] - g[i]
            if dg > skip + 1:
                break
            dp = p[j] - p[i]
            if dg <= 0 or dp <= 0 or dp > skip + 1:
                continue
            s = score[i] + 2 - max(dg, dp)
            if s > score[j]:
                score[j], before[j] = s, i
        if before[j] >= 0:
            follows[before[j]] = True
    chains = []
    for j in range(n):
        if not follows[j]:
            chain = [j]
            while before[chain[-1]] >= 0:
                chain.append(before[chain[-1]])
            chains.append(chain[::-1])
    return chains


def stretches(places: np.ndarray, offsets: np.ndarray, size: int, density: float = DENSITY, shortest: int = SHORTEST) -> list[tuple[int, int, int, int, int]]:
    """(matched, first and last offset in the item, first and last place) of every dense stretch of matching pairs.

    places and offsets are all pairs of equal words of a document and an item of ``size`` words. A stretch has ``shortest``
    words at least, and at least ``density`` of its span, in either text, matches. A chain that isn't dense as a whole is
    cut at its gaps, so that its dense parts count. The longest come first.
    """
    skip = max(5, slack(size, density))
    # a dense stretch holds three words in a row in both texts; pairs far from such a run can't belong to one
    key = (places - offsets) * np.int64(1 << 32) + offsets
    key.sort()
    run = key[:-2][key[2:] - key[:-2] == 2] if len(key) > 2 else key[:0]
    if not len(run):
        return []
    seeds = np.unique((run >> 32) + (run & 0xFFFFFFFF))
    i = np.searchsorted(seeds, places)
    nearest = np.minimum(np.abs(places - seeds[np.maximum(i - 1, 0)]), np.abs(places - seeds[np.minimum(i, len(seeds) - 1)]))
    keep = nearest <= size + skip + 3
    places, offsets = places[keep], offsets[keep]
    order = np.lexsort((offsets, places))
    g, p = places[order].tolist(), offsets[order].tolist()
    found = set()
    for chain in _chains(g, p, skip):
        m = len(chain)
        if m < shortest:
            continue
        heads = [k for k in range(m) if not k or g[chain[k]] - g[chain[k - 1]] != 1 or p[chain[k]] - p[chain[k - 1]] != 1]
        ends = [*(k - 1 for k in heads[1:]), m - 1]
        for a, i in enumerate(heads):
            for j in ends[a:]:
                matched = j - i + 1
                x, y = chain[i], chain[j]
                if matched >= shortest and matched >= density * (max(p[y] - p[x], g[y] - g[x]) + 1):
                    found.add((matched, p[x], p[y], g[x], g[y]))
    return sorted(found, key=lambda s: (-s[0], s[3], s[1]))


def passage(words: list[str], document: Document, need: int, density: float = DENSITY, shortest: int = SHORTEST) -> tuple[int, int, bool] | None:
    """(matched, stretches, exact) of an item in a document, None if it doesn't hold enough of it."""
    if sum(r in document.runs for r in zip(words, words[1:], words[2:])) < least_runs(len(words), need, density, shortest):
        return None
    lists = [document.at.get(w, ()) for w in words]
    places = np.array([g for x in lists for g in x], np.int64)
    offsets = np.repeat(np.arange(len(words), dtype=np.int64), [len(x) for x in lists])
    found = stretches(places, offsets, len(words), density, shortest)
    if not found:
        return None
    if found[0][0] >= need:
        m, a, b, c, d = found[0]
        return m, 1, m == len(words) == d - c + 1
    for i, s in enumerate(found):
        for t in found[i + 1 :]:
            if s[0] + t[0] < need:
                break
            if (t[1] > s[2] or t[2] < s[1]) and (t[3] > s[4] or t[4] < s[3]):
                return s[0] + t[0], 2, False
    return None


def leaked(corpus: DataFrame, items: DataFrame, index: DataFrame | None = None, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, matched, words, stretches, exact) for every document of corpus (doc_id, text) with enough of an item (item_id, text).

    The best one or two stretches must have ``share`` of the words of the item, and ``least`` of them; exact: the whole item
    in one stretch without a gap. ``index`` is a stored positional index of corpus, built here if it isn't given; it serves
    any number of items, which are joined to it by term. NULL or empty texts on either side, NULL ids of documents and items
    with fewer words than ``least`` match nothing; repeated texts match each on its own; other columns are left out.
    """
    index = stored(positional_index(corpus, "doc_id", "text"), "postings") if index is None else index
    query = stored(query_terms(items, share, least).withColumn("item", F.monotonically_increasing_id()), "items")
    # a text travels once for each GROUP items at most, not once for each item
    slots = F.expr(f"item div {GROUP}").alias("slot")
    opened, held = candidates(index, query), None
    if (query.agg(F.sum(F.size("words"))).first()[0] or 0) <= CARRIED:
        held = {r["item"]: (r["item_id"], r["words"], r["need"]) for r in query.collect()}
        opened = opened.groupBy("doc_id", slots).agg(F.collect_list("item").alias("items"))
    else:
        opened = opened.join(query, "item").groupBy("doc_id", slots).agg(F.collect_list(F.struct("item_id", "words", "need")).alias("items"))
    opened = stored(opened.drop("slot"), "opened")
    texts = corpus.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(stored(opened.select("doc_id").distinct(), "ids"), "doc_id", "left_semi")
    rows = texts.join(opened, "doc_id").select("doc_id", "text", "items")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int32()), ("words", pa.int32()), ("stretches", pa.int32()), ("exact", pa.bool_())])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, text, opened_items in zip(*batch.columns):
                document = Document(text.as_py() or "")
                for item in opened_items.as_py():
                    item_id, words, need = held[item] if held is not None else (item["item_id"], item["words"], item["need"])
                    if r := passage(words, document, need):
                        found.append((doc.as_py(), item_id, r[0], len(words), r[1], r[2]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(schema.types)], schema=schema)

    return rows.mapInArrow(align, "doc_id long, item_id long, matched int, words int, stretches int, exact boolean")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p9_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the number of words that matched and whether the passage is exact."""
    return leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


QUERIES = {"p9_found": p9_found, "p9_passages": p9_passages}
SQL: dict[str, str] = {}
