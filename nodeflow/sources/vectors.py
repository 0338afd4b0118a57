"""Readers of vectors: wide CSV, NPY / NPZ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeflow.params import Params
from nodeflow.sources.matrices import RANGE_BYTES, Matrices
from nodeflow.sources.rownum import numbered


def read_wide_csv(spark: SparkSession, path: str, params: Params, header: bool = True) -> DataFrame:
    """One vector per line, one number per column -> (row_id, embedding, valid).

    A cell that is no number makes the row invalid, and so do cells beyond or short of the
    dimension; rows keep their number either way.
    """
    schema = T.StructType([*[T.StructField(f"c{i}", T.StringType()) for i in range(params.dim)],
                           T.StructField("_other_width", T.StringType())])
    scan = spark.read.schema(schema).option("header", header).option("enforceSchema", True).option(
        "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_other_width").csv(path)
    cells = F.array(*[F.expr(f"try_cast(c{i} AS FLOAT)") for i in range(params.dim)])
    vectors = numbered(scan).select("row_id", cells.alias("embedding"), F.col("_other_width").isNull().alias("_width"))
    gaps = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return vectors.select("row_id", "embedding", (F.col("_width") & ~gaps).alias("valid"))


def read_numpy(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Matrix files -> (file, row_idx, embedding).

    A file is read in ranges of rows of about ``range_bytes`` by as many tasks. Only a compressed member of
    an NPZ is read by one task. Of an NPZ the member ``embeddings`` counts, else the first.
    """
    spark.dataSource.register(Matrices)
    return spark.read.format(Matrices.name()).option("range_bytes", range_bytes).load(path)


def refusal(embedding: Column, dim: int) -> Column:
    """Why a vector is refused: MISSING, WRONG_SIZE or GAP (a null or NaN element); null if it is not."""
    gap = F.exists(embedding, lambda x: x.isNull() | F.isnan(x))
    return F.when(embedding.isNull(), "MISSING").when(F.size(embedding) != dim, "WRONG_SIZE").when(gap, "GAP")


def validated(vectors: DataFrame, params: Params, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of the right size without gaps, rows that are not); strict fails on the first bad row."""
    bad = refusal(F.col("embedding"), params.dim)
    if strict:
        checked = F.when(bad.isNull(), F.col("embedding")).otherwise(F.raise_error(F.lit("vector of wrong size or with gaps")))
        return vectors.withColumn("embedding", checked), vectors.where(F.lit(False))
    return vectors.where(bad.isNull()), vectors.where(bad.isNotNull())


def write_numpy(vectors: DataFrame, path: str, rows_per_file: int = 100_000, name: str | None = None, order: str | None = None) -> None:
    """Sink: matrix files in NPY format from (embedding), at most ``rows_per_file`` rows each.

    With the column ``name`` each of its values is a file, its rows sorted by ``order``; a value with more
    rows goes on in ``name-1.npy`` and so on. Without it a task writes files of its own.
    """
    vectors.sparkSession.dataSource.register(Matrices)
    rows = vectors.select(F.col(name).cast("string") if name else F.concat(F.lit("part-"), F.lpad(F.spark_partition_id().cast("string"), 6, "0")).alias("name"),
                          F.col("embedding").cast("array<float>"), *([F.col(order).alias("_order")] if order else []))
    if name:
        rows = rows.toDF("name", *rows.columns[1:]).repartition("name").sortWithinPartitions("name", *(["_order"] if order else []))
    rows.select("name", "embedding").write.format(Matrices.name()).option("rows_per_file", rows_per_file).mode("append").save(path)
