"""Row numbers and ordered folds per key that stay spread when one key, or one value, holds most rows.

Rows are range-partitioned by key, order and ties together, so rows of one key are numbered in
many slices at once; a slice's offset comes from the counts of the slices before it.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeflow.session import cut


def sliced(df: DataFrame, order: str, slices: int | None = None) -> DataFrame:
    """Add ``_slice``, non-decreasing in ``order`` (a number or a timestamp)."""
    n = slices or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    is_time = df.schema[order].dataType.typeName().startswith("timestamp")
    value = F.unix_micros(F.col(order).cast("timestamp")) if is_time else F.col(order)
    cuts = df.agg(F.percentile_approx(value.cast("double"), [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    inner = sorted({c for c in cuts if math.isfinite(c)})  # the outer slices hold infinite values, NaN comes last
    splits = [float("-inf"), *inner, float("inf")]
    if len(splits) < 3:
        return df.withColumn("_slice", F.lit(0))
    made = Bucketizer(splits=splits, inputCol="_slice_by", outputCol="_slice", handleInvalid="keep").transform(
        df.withColumn("_slice_by", value.cast("double")))
    return made.drop("_slice_by").withColumn("_slice", F.col("_slice").cast("int"))


def ranged(df: DataFrame, columns: list[str], slices: int | None = None) -> DataFrame:
    """``df`` in ranges of the columns (nulls first), numbered by ``_slice``; written once, so the numbers stay."""
    spread = df.repartitionByRange(slices, *columns) if slices else df.repartitionByRange(*columns)
    return cut(spread.withColumn("_slice", F.spark_partition_id()))


def keyed_rank(df: DataFrame, keys: list[str], order: str, *ties: str, slices: int | None = None) -> DataFrame:
    """Add ``rank`` (from 1, by order then ties, null order values first) and ``n`` (rows of the key).

    Every row stays: null keys form a group of their own.
    """
    parts = ranged(df, [*keys, order, *ties], slices)
    local = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(order, *ties))
    counts = parts.groupBy(*keys, "_slice").agg(F.count("*").alias("_c"))
    per_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = F.sum("_c").over(per_key.orderBy("_slice")) - F.col("_c")
    on = [*keys, "_slice"]
    offsets = counts.select(*[F.col(c).alias(f"_on_{c}") for c in on], before.alias("_before"), F.sum("_c").over(per_key).alias("n"))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return parts.withColumn("_local", local).join(offsets, same).withColumn(
        "rank", F.col("_before") + F.col("_local")).drop("_slice", "_local", "_before", *[f"_on_{c}" for c in on])


def clamped_sum(df: DataFrame, keys: list[str], step: Column, order: str, *ties: str,
                slices: int | None = None) -> DataFrame:
    """What a run of ``x = max(x + step, 0)`` in order does per key: (keys, total, lowest).

    From a start x0 the end is max(x0 + total, total - lowest), ``lowest`` being the smallest
    running sum. Both parts combine over slices, so the fold needs no whole group.
    """
    parts = ranged(df.withColumn("_step", step), [*keys, order, *ties], slices)
    running = F.sum("_step").over(W.partitionBy(*keys, "_slice").orderBy(order, *ties).rowsBetween(
        W.unboundedPreceding, W.currentRow))
    per_slice = parts.withColumn("_run", running).groupBy(*keys, "_slice").agg(
        F.sum("_step").alias("_sum"), F.min("_run").alias("_low"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0.0))
    return per_slice.withColumn("_low", before + F.col("_low")).groupBy(*keys).agg(
        F.sum("_sum").alias("total"), F.min("_low").alias("lowest"))
