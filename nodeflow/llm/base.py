"""What the operators share: words, keys of rows, packed hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeflow.session import cut

SPACES = " \\t\\n\\x0B\\f\\r"  # fixed values: 0x20 and 0x09-0x0D, as in a Java pattern
NO_ID = -(2**63)  # stands for a null doc_id in packed arrays; sorts before every id


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hash128(*columns: Column | str) -> list[Column]:
    """Two independent 64-bit hashes of the columns; a null is a value of its own."""
    known = [c for x in columns for c in (F.col(x).isNull() if isinstance(x, str) else x.isNull(), x)]
    return [F.xxhash64(F.lit(1), *known).alias("k1"), F.xxhash64(F.lit(2), *known).alias("k2")]


def look_up(rows: DataFrame, table: DataFrame, key: str, weight: str, spread: Column, hot: int = 1000) -> DataFrame:
    """``rows`` with the row of ``table`` (one per key) under ``found``; null where the key is unknown.

    The ``hot`` keys with the largest ``weight`` (rows they meet) are broadcast. Each other key meets less than
    1 / hot of all rows, so the rest is joined by key, and rows that are served already are dealt by ``spread``.
    """
    found = [F.col(c) for c in table.columns if c not in (key, weight)]
    most = table.orderBy(F.desc(weight), key).limit(hot).select(F.col(key).alias("_hot_key"), F.struct(*found).alias("_hot"))
    most = rows.join(F.broadcast(most), F.col(key) == F.col("_hot_key"), "left")
    served = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    # one string column, so the deal survives the optimiser: a served row meets no key
    place = F.when(served, F.concat(F.lit("-"), F.pmod(F.xxhash64(spread), F.lit(100_000)).cast("string"))).otherwise(F.concat(F.lit("="), F.col(key).cast("string")))
    dealt = most.withColumn("_place", place)
    rest = table.select(F.concat(F.lit("="), F.col(key).cast("string")).alias("_cold_key"), F.struct(*found).alias("_cold"))
    both = dealt.join(rest, F.col("_place") == F.col("_cold_key"), "left")
    return both.select(*rows.columns, F.coalesce("_hot", "_cold").alias("found"))


def sized(df: DataFrame, row_bytes: Column, limit: int = 64_000_000) -> DataFrame:
    """``df``, written once and measured, with a hint: broadcast up to ``limit`` bytes, never beyond."""
    df = cut(df)
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= limit else df.hint("merge")


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` values (uint64), one per start."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, factor = np.zeros(n, np.uint64), 1
    for k in range(width):
        total += values[k : k + n] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % 2**64
    return mixed(total)


def runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie in a window of ``width`` from one of ``starts``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0
