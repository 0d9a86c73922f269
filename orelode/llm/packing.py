"""Texts packed into containers of fixed capacity in tokens.

Dynamic programming over the global histogram of lengths chooses the bounds of length buckets that minimise padding; the
containers are then planned over the buckets in bulk, and the texts take the planned places by their rank in the bucket.
A batch inside one bucket alone can't fill a container of 2,048 tokens well, as most texts are longer than a tenth of
it; so the room that items of one bucket leave is given to the largest buckets that still fit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.session import stored
from orelode.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_sizes(df: DataFrame, id_column: str, text_column: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens, part): tokens of each text by the rank file ``tokenizer``, read once by the driver; NULL texts have none."""
    with open(tokenizer, "rb") as f:
        ranks = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table_, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([part] * len(n), pa.int32())], names=["id", "n_tokens", "part"])

    return df.select(F.col(id_column).cast("bigint").alias("id"), text_column).mapInArrow(run, "id long, n_tokens long, part int")


def bucket_bounds(histogram: dict[int, int], capacity: int, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least sum of (bound - length) over the histogram."""
    lengths = np.array(sorted(histogram), np.int64)
    if len(lengths) <= buckets:
        return lengths.tolist()
    n = np.array([histogram[x] for x in lengths.tolist()], float)
    count, weight = np.cumsum(n), np.cumsum(n * lengths)
    c0, w0 = np.concatenate([[0], count]), np.concatenate([[0], weight])
    size = len(lengths)
    # padding[i, j]: items i..j in one bucket bounded by lengths[j]
    padding = lengths[None, :] * (c0[None, 1:] - c0[:size, None]) - (w0[None, 1:] - w0[:size, None])
    padding[np.tril_indices(size, -1)] = np.inf
    best, choice = padding[0].copy(), [np.zeros(size, int)]
    for _ in range(1, buckets):
        total = padding.copy()
        total[1:] += best[:-1, None]
        pick = total.argmin(axis=0)
        best = total[pick, np.arange(size)]
        choice.append(pick)
    bounds, j = [], size - 1
    for pick in reversed(choice):
        bounds.append(int(lengths[j]))
        j = int(pick[j]) - 1
        if j < 0:
            break
    return bounds[::-1]


def plan(bounds: list[int], counts: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Places for the items of every bucket: rows (bucket, first rank, first container, containers), and the number of containers.

    Item r of a bucket in a row with first rank f, first container c and m containers goes to container c + (r - f) % m.
    The largest bucket left begins a container, which is filled with the largest that fit, and is repeated as often as the
    counts allow; so there are at most a few rows for each bucket, however many items there are.
    """
    left, used = list(counts), [0] * len(counts)
    rows, container = [], 0
    top = len(bounds) - 1
    while top >= 0:
        if not left[top]:
            top -= 1
            continue
        room, uses = capacity, {}
        for b in range(top, -1, -1):
            take = min(left[b], room // bounds[b])
            if take:
                uses[b] = take
                room -= take * bounds[b]
        m = min(left[b] // k for b, k in uses.items())
        for b, k in uses.items():
            rows.append((b, used[b], container, m))
            used[b] += k * m
            left[b] -= k * m
        container += m
    return rows, container


def packed(df: DataFrame, id_column: str, text_column: str, capacity: int = 2048, tokenizer: str = TOKENIZER, buckets: int = 96) -> DataFrame:
    """(container_id, id, piece, first_token, n_tokens): every text in a container of at most ``capacity`` tokens.

    A text within the capacity is whole, in one container. A longer one is cut into full containers, and its rest is packed
    with others. NULL and empty texts have no tokens and stand beside others; an empty table gives no rows.
    """
    sizes = stored(token_sizes(df, id_column, text_column, tokenizer), "sizes")
    sizes = sizes.withColumn("full", F.floor((F.col("n_tokens") - 1) / capacity)).withColumn("full", F.greatest("full", F.lit(0)))
    sizes = sizes.withColumn("rest", F.greatest(F.col("n_tokens") - F.col("full") * capacity, F.lit(1)))
    histogram = {r["rest"]: r["count"] for r in sizes.groupBy("rest").count().collect()}  # at most ``capacity`` rows
    bounds = bucket_bounds(histogram, capacity, buckets)
    at = np.searchsorted(bounds, sorted(histogram))
    counts = [0] * len(bounds)
    for b, length in zip(at.tolist(), sorted(histogram)):
        counts[b] += histogram[length]
    rows, containers = plan(bounds, counts, capacity)
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col("rest"))) if bounds else F.lit(0)
    items = sizes.withColumn("bucket", bucket)
    # ranks: the rank inside a part plus what the parts before hold, over a table of parts and buckets only
    held = items.groupBy("part", "bucket").agg(F.count("*").alias("n"))
    held = held.withColumn("before", F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")).drop("n")
    wide = items.groupBy("part").agg(F.sum("full").alias("f"))
    wide = wide.withColumn("full_before", F.sum("f").over(Window.orderBy("part")) - F.col("f")).drop("f")
    items = items.withColumn("rank", F.row_number().over(Window.partitionBy("part", "bucket").orderBy("id")) - 1)
    items = items.withColumn("full_rank", F.sum("full").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("full"))
    items = items.join(held, ["part", "bucket"]).join(wide, ["part"])
    items = items.withColumn("rank", F.col("rank") + F.col("before")).withColumn("full_rank", F.col("full_rank") + F.col("full_before"))
    starts = {b: sorted((f, c, m) for x, f, c, m in rows if x == b) for b in range(len(bounds))}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = {b: np.array(v, np.int64) for b, v in starts.items() if v}
        for batch in batches:
            b, r = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("bucket", "rank"))
            out = np.zeros(len(b), np.int64)
            for k in np.unique(b):
                rows_ = arrays[int(k)]
                mine = b == k
                i = np.searchsorted(rows_[:, 0], r[mine], "right") - 1
                out[mine] = rows_[i, 1] + (r[mine] - rows_[i, 0]) % rows_[i, 2]
            names = [c for c in batch.schema.names if c in ("id", "n_tokens", "full", "full_rank")]
            yield pa.RecordBatch.from_arrays([pa.array(out), *(batch.column(batch.schema.get_field_index(c)) for c in names)], names=["container_id", *names])

    placed = items.select("id", "n_tokens", "full", "full_rank", "bucket", F.col("rank").cast("bigint").alias("rank"))
    placed = placed.mapInArrow(place, "container_id long, id long, n_tokens long, full long, full_rank long")
    rest = F.struct(F.col("container_id"), F.col("full").alias("piece"), (F.col("full") * capacity).alias("first_token"), (F.col("n_tokens") - F.col("full") * capacity).alias("n_tokens"))
    whole = F.transform(
        F.when(F.col("full") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.struct((F.lit(containers) + F.col("full_rank") + i).alias("container_id"), i.alias("piece"), (i * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n_tokens")),
    )
    return placed.select("id", F.explode(F.concat(whole, F.array(rest))).alias("p")).select("p.container_id", "id", "p.piece", "p.first_token", "p.n_tokens")


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The documents in containers of 2,048 tokens; ``tokenizer`` names the public rank file that they are counted by."""
    rows = packed(table(spark, folder, "documents"), "doc_id", "text")
    return rows.withColumnRenamed("id", "doc_id").withColumn("tokenizer", F.lit(TOKENIZER.rsplit("/", 1)[-1]))


QUERIES = {"p8_packing": p8_packing}
SQL: dict[str, str] = {}
