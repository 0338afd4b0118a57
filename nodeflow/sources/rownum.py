"""Row numbers in file order without sending rows through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered(scan: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of a file scan from 0 by (file, position).

    Rows of one split are consecutive in a task, so only the splits are put in order, one
    small row for each. ``scan`` must be the bare scan: no shuffle, no filter.
    """
    marked = scan.select("*", F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    splits = marked.groupBy("_file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_file", "_at")) - F.col("_n")
    offsets = splits.select("_file", "_at", "_first", before.alias("_before"))
    return marked.join(offsets, ["_file", "_at"]).withColumn(
        name, F.col("_before") + F.col("_id") - F.col("_first")).drop("_file", "_at", "_id", "_first", "_before")
