"""Readers of text datasets: CSV, JSON, JSON lines, folders. All give (source_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeflow.functions import texts as X
from nodeflow.sources.records import csv_records, header_of, json_list_elements
from nodeflow.sources.rownum import numbered


def read_csv_texts(spark: SparkSession, path: str) -> DataFrame:
    """All-string CSV with a header; broken lines are left out, the text column goes by name.

    A file is read by as many tasks as it has splits, also where values hold line ends. All files need the
    same header: one with other or reordered columns raises, as its fields would be taken for others.
    """
    options = {"quote": '"', "escape": '"'}
    columns = spark.read.options(header=True, multiLine=True, **options).csv(path).columns  # reads the header only
    schema = ", ".join(f"c{k} string" for k in range(len(columns))) + ", _bad string"
    text = f"r.c{columns.index(X.csv_text_field(columns))}"

    def kept(records: DataFrame) -> DataFrame:
        wrong = F.raise_error(F.concat(F.lit("another CSV header in "), F.col("file"))).cast("boolean")
        is_row = F.when(F.col("first"), F.when(header_of(F.col("record"), columns, options), F.lit(False)).otherwise(wrong)).otherwise(True)
        parsed = F.from_csv("record", schema, {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        return records.where(is_row).select("file", "at", parsed.alias("r")).where("r._bad IS NULL").select("file", "at", F.col(text).alias("text"))

    return normalised(csv_records(spark, path, kept, "source_id"), "source_id", "text")


def normalised(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Strip texts and leave out the empty ones; ids as strings."""
    return rows.select(F.col(key).cast("string").alias("source_id"), X.clean(F.col(text)).alias("text")).where(
        F.col("text").isNotNull())


def extract_records(records: DataFrame, record: str = "record", index: str = "idx") -> DataFrame:
    """Records (JSON text or variant) -> (source_id, text, other columns); those without a text are left out."""
    parsed = records
    if records.schema[record].dataType.typeName() == "string":
        parsed = records.withColumn(record, F.try_parse_json(record))  # parsed once, read by path
    rest = [c for c in records.columns if c not in (record, index)]
    return parsed.select(X.json_id(F.col(record), F.col(index)).alias("source_id"),
                         X.json_text(F.col(record)).alias("text"), *rest).where(F.col("text").isNotNull())


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object per line; lines that are no object are left out but counted."""
    lines = numbered(spark.read.text(path), "idx").select(F.try_parse_json("value").alias("record"), "idx")
    return extract_records(lines.where(F.coalesce(X.kind_of(F.col("record")).startswith("OBJECT"), F.lit(False))))


def records_of(documents: DataFrame, document: str = "document") -> DataFrame:
    """JSON documents as text -> (document columns, idx, record variant): a list, or the list an object wraps."""
    doc = F.col(document)
    wrapped = F.coalesce(*[
        F.when(X.kind_of(F.try_variant_get(doc, f"$.{w}", "variant")).startswith("ARRAY"),
               F.try_variant_get(doc, f"$.{w}", "array<variant>")) for w in X.JSON_WRAPPER_FIELDS])
    records = F.when(X.kind_of(doc).startswith("ARRAY"), F.try_variant_get(doc, "$", "array<variant>")).otherwise(
        F.coalesce(wrapped, F.array(doc)))
    rest = [c for c in documents.columns if c != document]
    return documents.withColumn(document, F.try_parse_json(document)).select(*rest, F.posexplode(records).alias("idx", "record"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one per file. A list is read by as many tasks as its file has splits; a document with an
    object around its list, or of a single record, by one task.

    A record without an id is named by its file and its place there, so ids of several files differ. Of a
    list that breaks off, the records before the break are read.
    """
    elements, others = json_list_elements(spark, path)
    place = F.concat_ws(":", F.url_decode(F.replace(F.substring_index("file", "/", -1), F.lit("+"), F.lit("%2B"))), F.col("idx").cast("string"))
    listed = extract_records(elements.select("record", place.alias("idx")))
    rest = [r["file"] for r in others.collect()]  # names only, as the reader needs them
    if not rest:
        return listed
    files = spark.read.text(rest, wholetext=True).select(F.col("value").alias("document"), F.col("_metadata.file_name").alias("file"))
    named = records_of(files).withColumn("idx", F.concat_ws(":", "file", "idx"))
    return listed.unionByName(extract_records(named.drop("file")))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every *.txt below a folder; the id is the path relative to it."""
    root = path.rstrip("/") + "/"
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    where = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    relative = F.substring_index(where, root, -1)
    return normalised(files.select(relative.alias("id"), "value"), "id", "value")
