"""Packing documents into padded batches with optimal length buckets.

A global histogram of lengths (one aggregation, at most ``max_len`` rows) feeds a dynamic programme that
chooses the bucket boundaries with the least padding. Documents are then numbered inside their bucket and
cut into batches of at most ``token_budget`` padded tokens. Documents longer than ``max_len`` lie in a last
bucket in which each is a batch of its own, without padding; nothing is dropped or cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeflow.llm.base import SPACES, hash128


@dataclass(frozen=True)
class PackingParams:
    buckets: int = 16
    token_budget: int = 16384  # padded tokens of a batch
    max_len: int = 16384  # longer documents are batches of their own; bounds the histogram


def n_words(text: Column) -> Column:
    """Length of a text in words; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds (ascending, the last is the largest length) of at most ``buckets`` buckets with the least
    padding; of equal solutions the one with fewer buckets.

    ``cost[j]`` is the least padding of the first j lengths. The cost of one bucket over (i, j] is
    ``length[j] * rows - tokens``; best splits move forward with j, so each layer is filled by divide and
    conquer in n log n steps.
    """
    n = len(lengths)
    if n == 0:
        return []
    rows = np.concatenate(([0], np.cumsum(counts.astype(np.int64))))
    tokens = np.concatenate(([0], np.cumsum(counts.astype(np.int64) * lengths.astype(np.int64))))
    top = lengths.astype(np.int64)
    cost = np.full(n + 1, np.iinfo(np.int64).max // 4)
    cost[0] = 0
    splits: list[np.ndarray] = []
    for _ in range(min(buckets, n)):
        nxt, split = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            c = cost[i] + top[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
            k = int(np.argmin(c))
            nxt[j], split[j] = c[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        splits.append(split)
        done = nxt[n] == cost[n]
        cost = nxt
        if done:
            splits.pop()
            break
        if nxt[n] == 0:
            break
    bounds, j = [], n
    for split in reversed(splits):
        bounds.append(int(top[j - 1]))
        j = int(split[j])
    return bounds[::-1]


def pack(rows: DataFrame, length: Column | None = None, params: PackingParams = PackingParams(), text: str = "text") -> DataFrame:
    """All columns of ``rows`` with ``n_tokens``, ``bucket``, ``bucket_len``, ``batch`` and ``slot`` appended.

    ``length`` (default: words of the text) counts tokens; null counts as 0. ``batch`` numbers the batches
    of a bucket from 0 and ``slot`` the rows of a batch; all batches of a bucket but its last are full. A
    bucket holds its rows in the order of a hash of the row, so repeated and tied rows need no tie-break
    beyond it. Empty documents share the bucket of the smallest boundary. Columns of the new names are
    replaced. An empty table gives an empty result. Which of two fully equal rows takes which slot is open.
    """
    new = ("n_tokens", "bucket", "bucket_len", "batch", "slot")
    kept = rows.select(*[c for c in rows.columns if c not in new])
    size = F.greatest(F.coalesce(n_words(F.col(text)) if length is None else length, F.lit(0)).cast("long"), F.lit(0))
    hashed = [c for c in ("doc_id", text) if c in rows.columns] or rows.columns
    measured = kept.withColumn("n_tokens", size)
    capped = F.when(F.col("n_tokens") <= params.max_len, F.col("n_tokens"))
    histogram = {r["n"]: r["count"] for r in measured.groupBy(capped.alias("n")).count().collect()}
    beyond = histogram.pop(None, 0)
    known = sorted(histogram)
    bounds = optimal_boundaries(np.array(known, np.int64), np.array([histogram[x] for x in known], np.int64), params.buckets)
    held = [sum(histogram[x] for x in known if a < x <= b) for a, b in zip([-1, *bounds[:-1]], bounds)] + [beyond]

    # each bucket is numbered in about sqrt(rows) slices of about sqrt(rows) rows
    bucket = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        bucket = F.when(F.col("n_tokens") <= bounds[k], F.lit(k)).otherwise(bucket)
    per = F.array(*[F.lit(max(1, int(b and params.token_budget // b) or (params.token_budget if b == 0 else 1))) for b in bounds], F.lit(1))
    slices = F.array(*[F.lit(max(1, int(n**0.5))) for n in held])
    bound = F.array(*[F.lit(b).cast("long") for b in bounds], F.lit(None).cast("long"))
    k1, k2 = hash128(*hashed)
    placed = measured.select("*", bucket.alias("bucket"), k1.alias("_k1"), k2.alias("_k2"))
    placed = placed.withColumn("_slice", F.pmod(F.col("_k1"), slices[F.col("bucket")]))
    sizes = placed.groupBy("bucket", "_slice").count()
    before = Window.partitionBy("bucket").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("bucket").alias("_b"), F.col("_slice").alias("_s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("bucket", "_slice").orderBy("_k1", "_k2")
    # null-safe, so that no check for nulls measures the texts again below the join
    numbered = (placed.withColumn("_n", F.row_number().over(inside) - 1)
                .join(offsets, F.col("bucket").eqNullSafe(F.col("_b")) & F.col("_slice").eqNullSafe(F.col("_s"))))
    rank = F.col("_n") + F.col("_offset")
    width = per[F.col("bucket")]
    return numbered.select(*kept.columns, "n_tokens", "bucket", F.coalesce(bound[F.col("bucket")], F.col("n_tokens")).alias("bucket_len"),
                           F.floor(rank / width).cast("long").alias("batch"), (rank % width).cast("int").alias("slot"))
