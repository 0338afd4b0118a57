"""A training corpus from raw documents: language, boilerplate lines, near copies, benchmark passages, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeflow.llm import decontaminate, langid, linededup, packing, simhash
from nodeflow.session import scratch_path

ORACLE_SQL = None  # language model, fingerprints and dynamic programme have no SQL form


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from the labels the documents carry."""
    model = langid.fit(docs)
    judged = langid.predict(docs.select(F.struct("*").alias("row"), "text"), model)
    return judged.where(~F.col("rejected")).select("row.*")


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; n_chars follows the text."""
    cleaned = linededup.drop_boilerplate(docs)
    return cleaned.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id. Null, empty and blank texts
    are one group; of repeated rows one stays; an empty table stays empty."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows all stay or all go;
    without items every document stays."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the documents with their place in a padded batch."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_boilerplate),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
