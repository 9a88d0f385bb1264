"""Operator 7: packing into length buckets whose limits minimise padding over the global histogram."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docledger.llm.common import prefix_offsets

#: Buckets at most, and tokens in a batch, padding included.
MAX_BUCKETS, TOKEN_BUDGET = 16, 65536
#: Documents that one task numbers, about; a bucket has MIN_SHARDS shards at least.
SHARD_ROWS, MIN_SHARDS = 200_000, 16
ADDED = ("bucket", "bucket_limit", "batch", "slot")


def bucket_limits(values: np.ndarray, counts: np.ndarray, buckets: int = MAX_BUCKETS) -> list[int]:
    """Limits of at most ``buckets`` buckets with the least sum of limit times documents.

    values: ascending lengths; counts: documents of each. best[j] is the least sum for the first j values;
    a further bucket (i, j] costs values[j-1] for each document in it.
    """
    n, seen = len(values), np.concatenate(([0.0], np.cumsum(counts, dtype=float)))
    best = np.concatenate(([0.0], values * seen[1:]))
    cuts = []
    for _ in range(min(buckets, n) - 1):
        best, cut = _one_more(best, values, seen)
        cuts.append(cut)
    limits, j = [], n
    for cut in reversed(cuts):
        limits.append(int(values[j - 1]))
        j = int(cut[j])
        if j == 0:
            return limits[::-1]
    limits.append(int(values[j - 1]))
    return limits[::-1]


def _one_more(best: np.ndarray, values: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least sums with one more bucket, and the last bucket's start in each.

    The best start never moves back as the end moves on, so the middle end of a span halves the starts left to try for
    the ends on either side. All spans of one depth are tried together: n starts a depth, log n depths.
    """
    n = len(values)
    nxt, cut = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
    lo, hi, first, last = (np.array([x], dtype=np.int64) for x in (1, n, 0, n - 1))
    while len(lo):
        mid = (lo + hi) // 2
        width = np.minimum(last, mid - 1) - first + 1
        starts = np.cumsum(width) - width
        span = np.repeat(np.arange(len(lo)), width)
        i = np.arange(width.sum()) - starts[span] + first[span]
        cost = best[i] + values[mid - 1][span] * (seen[mid][span] - seen[i])
        least = np.minimum.reduceat(cost, starts)
        at = np.nonzero(cost == least[span])[0]
        chosen = i[at[np.unique(span[at], return_index=True)[1]]]
        nxt[mid], cut[mid] = least, chosen
        left, right = lo < mid, mid < hi
        lo, hi, first, last = (
            np.concatenate(x)
            for x in (
                (lo[left], mid[right] + 1),
                (mid[left] - 1, hi[right]),
                (first[left], chosen[right]),
                (chosen[left], last[right]),
            )
        )
    return nxt, cut


def pack(rows: DataFrame, buckets: int = MAX_BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """rows: doc_id, length (long, 1 at least) and any other columns. Adds bucket, bucket_limit, batch and slot.

    Dynamic programming over the histogram of all lengths chooses the limits; the last one is the longest length.
    Inside a bucket, documents are numbered by shard and id; each run of budget div limit documents is a batch, so only
    a bucket's last batch has room left. A document longer than the budget is a batch by itself. Null lengths count as
    1. Equal rows get slots of their own; rows without an id go by their length. Columns of rows that are named like
    an added one are replaced. An empty table gives an empty result. The driver sees one number for each length that
    occurs, never the rows.
    """
    length = F.greatest(F.coalesce(F.col("length"), F.lit(1)), F.lit(1)).cast("long")
    others = [F.col(c) for c in rows.columns if c not in ("doc_id", "length", *ADDED)]
    wrapped = [F.struct(*others).alias("_others")] if others else []
    rows = rows.select("doc_id", length.alias("length"), *wrapped)
    seen = rows.groupBy(F.col("length").alias("v")).count().orderBy("v").toPandas()
    values, counts = seen["v"].to_numpy(dtype=np.int64), seen["count"].to_numpy(dtype=np.int64)
    limits = bucket_limits(values, counts, buckets) if len(values) else [1]
    held = np.add.reduceat(counts, np.concatenate(([0], np.searchsorted(values, limits[:-1], side="right")))) if len(values) else [0]
    shards = [max(MIN_SHARDS, -(-int(n) // SHARD_ROWS)) for n in held]

    def pick(per_bucket: list[int]) -> Column:
        return F.get(F.array(*map(F.lit, per_bucket)), F.col("bucket")).cast("long")

    bucket = sum((F.when(F.col("length") > v, 1).otherwise(0) for v in limits[:-1]), F.lit(0))
    placed = (
        rows.withColumn("bucket", bucket)
        .withColumn("bucket_limit", pick(limits))
        .withColumn("_shard", F.pmod(F.xxhash64("doc_id", "length"), pick(shards)).cast("int"))
    )
    offsets = prefix_offsets(placed, ["bucket"], "_shard", F.lit(1).cast("long"), "_before")
    inside = Window.partitionBy("bucket", "_shard").orderBy("doc_id", "length")
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket_limit")), F.lit(1))
    number = F.col("_before") + F.row_number().over(inside) - 1
    return (
        placed.join(offsets, ["bucket", "_shard"])
        .withColumn("_number", number)
        .withColumn("batch", F.floor(F.col("_number") / room).cast("long"))
        .withColumn("slot", F.pmod(F.col("_number"), room).cast("long"))
        .select("doc_id", "length", *(["_others.*"] if others else []), *ADDED)
    )
