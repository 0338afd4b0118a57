"""Readers, sinks and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodeflow.functions import texts as X
from nodeflow.operators import evaluation, provenance, reports, state
from nodeflow.queries.base import (
    P, PARTS, POINTERS, node_name, parts, pointers, query, r6, sql, table,
)
from nodeflow.session import scratch_path
from nodeflow.sources import texts as S
from nodeflow.sources import vectors as SV
from nodeflow.sources.rownum import numbered

WHITE_SQL = "'" + X.WHITE + "'"
CLEAN = f"trim(text, {WHITE_SQL})"


def _spread(df, key):
    """Lay rows out in key order over several files, as many as a shuffle has parts."""
    files = max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(files, key).sortWithinPartitions(key)


@query("src_wide_vectors", """
SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, true AS valid, CAST(len(embedding) AS INTEGER) AS n,
       round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total, round(CAST(embedding[1] AS DOUBLE), 6) AS first
FROM embeddings""")
def src_wide_vectors(spark, sf):
    path = scratch_path(spark, "wide")
    wide = _spread(table(spark, sf, "embeddings"), "vec_id").select(
        *[F.get("embedding", F.lit(i)).alias(f"embedding_{i}") for i in range(P.dim)])
    wide.write.option("header", True).csv(path)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return SV.read_wide_csv(spark, path, P).select(
        "row_id", "valid", F.size("embedding").alias("n"), F.round(total, 5).alias("total"),
        r6(F.get("embedding", F.lit(0)).cast("double")).alias("first"))


@query("src_numpy_matrix", """
SELECT 'm' || vec_id // 200 || '.npy' AS file, row_number() OVER (PARTITION BY vec_id // 200 ORDER BY vec_id) - 1 AS row_idx,
       round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last,
       round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total
FROM embeddings""")
def src_numpy_matrix(spark, sf):
    """Files of 200 rows, each read in ranges of 64 rows."""
    path = scratch_path(spark, "numpy")
    named = table(spark, sf, "embeddings").withColumn("name", F.concat(F.lit("m"), F.floor(F.col("vec_id") / 200)))
    SV.write_numpy(named, path, name="name", order="vec_id")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return SV.read_numpy(spark, path, range_bytes=64 * 64 * 4).select(
        F.substring_index("file", "/", -1).alias("file"), "row_idx", r6(F.get("embedding", F.lit(0)).cast("double")).alias("first"),
        r6(F.get("embedding", F.lit(63)).cast("double")).alias("last"), F.round(total, 5).alias("total"))


@query("src_text_normalize", f"""
SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS source_id, {CLEAN} AS text
FROM documents QUALIFY {CLEAN} <> ''""")
def src_text_normalize(spark, sf):
    path = scratch_path(spark, "texts")
    _spread(table(spark, sf, "documents"), "doc_id").select("lang", "text", "source").write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return S.read_csv_texts(spark, path)


@query("src_json_records", f"""
SELECT CAST(doc_id AS VARCHAR) AS source_id, {CLEAN} AS text, 'lines' AS layout FROM documents WHERE {CLEAN} <> ''
UNION ALL
SELECT 'a' || doc_id, {CLEAN}, 'list' FROM documents WHERE {CLEAN} <> ''
UNION ALL
SELECT 'w' || doc_id, {CLEAN}, 'wrapped' FROM documents WHERE {CLEAN} <> ''""")
def src_json_records(spark, sf):
    """JSON lines written and read back, and files of 500 records: lists, or objects around a list."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    path = scratch_path(spark, "json")
    docs.withColumnRenamed("doc_id", "paper_id").write.json(path)
    lines = S.read_jsonl(spark, path).withColumn("layout", F.lit("lines"))

    # both layouts from one grouping: texts are shuffled once
    grouped = docs.groupBy(F.floor(F.col("doc_id") / 500).alias("file")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("id"), "text"))).alias("records"))

    def records(letter, field):
        return F.transform("records", lambda r: F.struct(F.concat(F.lit(letter), r["id"]).alias("id"), r["text"].alias(field)))

    folder = scratch_path(spark, "documents")
    layouts = F.array(F.to_json(records("a", "abstract")), F.to_json(F.struct(records("w", "content").alias("papers"))))
    grouped.select(F.explode(layouts).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    whole = S.read_json(spark, folder)
    return lines.unionByName(whole.withColumn("layout", F.when(F.col("source_id").startswith("a"), "list").otherwise("wrapped")))


@query("json_text_extract", f"""
SELECT CASE WHEN doc_id % 3 = 0 THEN 'p' || doc_id WHEN doc_id % 3 = 1 THEN CAST(doc_id AS VARCHAR)
            ELSE CAST(-doc_id AS VARCHAR) END AS source_id,
       CASE doc_id % 5 WHEN 0 THEN {CLEAN} WHEN 1 THEN {CLEAN} || ' ' || lang
            WHEN 2 THEN {CLEAN} WHEN 3 THEN source ELSE {CLEAN} END AS text
FROM documents WHERE {CLEAN} <> ''""")
def json_text_extract(spark, sf):
    """Text as string, list, nested object, behind empty fields, and under the last field name."""
    kind, text = F.col("doc_id") % 5, X.clean(F.col("text"))
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("p"), "doc_id"))
    number = F.when(F.col("doc_id") % 3 == 1, F.col("doc_id"))
    body = (
        F.when(kind == 0, F.to_json(F.struct(name.alias("paper_id"), number.alias("doc_id"), F.col("text").alias("abstract"))))
        .when(kind == 1, F.to_json(F.struct(name.alias("paper_id"), number.alias("doc_id"),
                                            F.array(text, F.lit(""), F.col("lang")).alias("summary"))))
        .when(kind == 2, F.to_json(F.struct(name.alias("paper_id"), number.alias("doc_id"),
                                            F.struct(F.lit("x").alias("note"), F.col("text").alias("content")).alias("text"))))
        .when(kind == 3, F.to_json(F.struct(name.alias("paper_id"), number.alias("doc_id"), F.lit("  ").alias("abstract"),
                                            F.array().cast("array<string>").alias("summary"), F.col("source").alias("title"))))
        .otherwise(F.to_json(F.struct(name.alias("paper_id"), number.alias("doc_id"), F.lit("").alias("title"),
                                      F.col("text").alias("body"))))
    )
    records = table(spark, sf, "documents").where(text.isNotNull()).select(body.alias("record"), (-F.col("doc_id")).alias("idx"))
    return S.extract_records(records)


@query("src_folder_texts", f"""
SELECT 'shelf=' || (item_id % 5) AS folder, {CLEAN} AS text FROM benchmark WHERE {CLEAN} <> ''""")
def src_folder_texts(spark, sf):
    path = scratch_path(spark, "folder")
    shelf = F.col("item_id") % 5
    table(spark, sf, "benchmark").select(F.col("text").alias("value"), shelf.alias("shelf")).write.option(
        "maxRecordsPerFile", 1).partitionBy("shelf").text(path)
    return S.read_folder(spark, path).select(F.substring_index("source_id", "/", 1).alias("folder"), "text")


@query("text_concat_filter", f"""
SELECT doc_id, CAST(length(concat_ws(' ', lang, source, text)) AS INTEGER) AS n_joined, length({CLEAN}) >= 3 AS kept
FROM documents""")
def text_concat_filter(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.length(X.joined_text(F.col("lang"), F.col("source"), F.col("text"))).alias("n_joined"),
        (F.length(X.strip(F.col("text"))) >= 3).alias("kept"))


@query("source_id_assign", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'run1:' || doc_id ELSE source || ':' || doc_id END AS source_id
FROM documents""")
def source_id_assign(spark, sf):
    dataset = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    return table(spark, sf, "documents").select(
        "doc_id", X.source_id(dataset, F.col("doc_id"), F.lit("run1")).alias("source_id"))


@query("state_upsert", sql("""
SELECT node_id, mass + 1 AS mass FROM parts UNION ALL SELECT 'new_' || node_id, mass FROM parts
UNION ALL SELECT 'old_' || node_id, mass FROM parts""", PARTS))
def state_upsert(spark, sf):
    """Written as version 1, changed, written as version 2 and read back."""
    p = parts(spark, sf).select("node_id", "mass")

    def named(prefix):
        return p.withColumn("node_id", F.concat(F.lit(prefix), "node_id"))

    store = state.StateStore(spark, scratch_path(spark, "state"))
    store.write(1, {"nodes": p.unionByName(named("old_"))})
    changed = p.withColumn("mass", F.col("mass") + 1).unionByName(named("new_"))
    store.write(2, {"nodes": state.upsert(store.read("nodes"), changed, "node_id")})
    return store.read("nodes")


@query("pointer_insert", sql("""
SELECT DISTINCT node_id, source_id FROM (
  SELECT node_id, source_id FROM pointers
  UNION ALL
  SELECT 'kn_' || lpad(CAST(o_custkey AS VARCHAR), 12, '0'), CAST(o_orderkey AS VARCHAR) FROM orders
  WHERE o_custkey IN (SELECT p_partkey FROM part))""", POINTERS))
def pointer_insert(spark, sf):
    new = table(spark, sf, "orders").select(node_name(F.col("o_custkey")).alias("node_id"),
                                            F.col("o_orderkey").cast("string").alias("source_id"))
    nodes = table(spark, sf, "part").select(node_name(F.col("p_partkey")).alias("node_id"))
    return provenance.pointer_insert(pointers(spark, sf), new, nodes)


@query("session_replace", """
SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS dataset_name, props AS dataset_path, ts AS created_timestamp
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) = 1""")
def session_replace(spark, sf):
    sessions = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("dataset_name"),
        F.col("props").alias("dataset_path"), F.col("ts").alias("created_timestamp"))
    return provenance.session_replace(sessions)


@query("metrics_melt", sql("""
SELECT node_id, name AS metric_name, value AS metric_value, TIMESTAMP '2024-01-31 00:00:00' AS evaluation_timestamp,
       '{"num_texts":' || mass || '}' AS metadata
FROM (SELECT node_id, mass, 'perplexity' AS name, mass / 10.0 AS value FROM parts WHERE key % 3 <> 0
      UNION ALL SELECT node_id, mass, 'validation_loss', variance FROM parts WHERE key % 3 <> 0
      UNION ALL SELECT node_id, mass, 'thematic_coherence', parent_similarity FROM parts WHERE key % 3 <> 0)
WHERE value IS NOT NULL""", PARTS))
def metrics_melt(spark, sf):
    wide = parts(spark, sf).select(
        "node_id", F.when(F.col("key") % 3 != 0, "success").otherwise("skipped").alias("status"),
        F.col("mass").alias("n_texts"), F.lit("2024-01-31").cast("timestamp_ntz").alias("at"),
        (F.col("mass") / 10.0).alias("perplexity"), F.col("variance").alias("validation_loss"),
        F.col("parent_similarity").alias("thematic_coherence"))
    return evaluation.metrics_melt(wide)


@query("dataset_stats", f"""
SELECT source AS dataset, CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) FILTER ({CLEAN} <> '') AS BIGINT) AS valid_texts
FROM documents GROUP BY source""")
def dataset_stats(spark, sf):
    return reports.dataset_stats(table(spark, sf, "documents").select(F.col("source").alias("dataset"), "text"))


# ---- pointers of documents in the four shapes a source id can have ------------------------------

def doc_pointers(spark, sf):
    k = F.col("doc_id")
    shape = (
        F.when(k % 4 == 0, F.concat("source", F.lit(":"), "doc_id"))
        .when(k % 4 == 1, F.concat(F.lit("run"), F.substring("source", 4, 9), F.lit(":"), "doc_id"))
        .when(k % 4 == 2, F.concat(F.lit("item-"), F.upper("source"), F.lit(":"), "doc_id"))
        .otherwise(F.col("doc_id").cast("string")))
    return table(spark, sf, "documents").select(
        node_name(F.floor(k / 10)).alias("node_id"), shape.alias("source_id"), "doc_id")


def doc_datasets(spark, sf):
    docs = table(spark, sf, "documents")
    datasets = docs.groupBy(F.col("source").alias("dataset_name")).agg(
        F.min(F.substring("source", 4, 9).cast("int")).alias("dataset_order"))
    sessions = datasets.select(F.concat(F.lit("run"), "dataset_order").alias("session_id"), "dataset_name")
    return datasets, sessions


DOC_POINTERS = """ptr AS (
  SELECT 'kn_' || lpad(CAST(doc_id // 10 AS VARCHAR), 12, '0') AS node_id, doc_id,
         CASE doc_id % 4 WHEN 0 THEN source || ':' || doc_id WHEN 1 THEN 'run' || substr(source, 4) || ':' || doc_id
              WHEN 2 THEN 'item-' || upper(source) || ':' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS source_id
  FROM documents), ds AS (
  SELECT source AS dataset_name, CAST(substr(source, 4) AS INTEGER) AS o FROM documents GROUP BY source), resolved AS (
  SELECT p.*, coalesce(d.dataset_name, s.dataset_name,
     (SELECT dataset_name FROM ds WHERE contains(lower(p.source_id), lower(ds.dataset_name)) ORDER BY o LIMIT 1)) AS dataset
  FROM ptr p
  LEFT JOIN ds d ON contains(source_id, ':') AND split_part(source_id, ':', 1) = d.dataset_name
  LEFT JOIN ds s ON contains(source_id, ':') AND split_part(source_id, ':', 1) = 'run' || s.o)"""


def resolved(spark, sf):
    datasets, sessions = doc_datasets(spark, sf)
    return provenance.resolve_dataset(doc_pointers(spark, sf), datasets, sessions)


@query("resolve_dataset", sql("SELECT source_id, dataset FROM resolved", DOC_POINTERS))
def resolve_dataset(spark, sf):
    return resolved(spark, sf).select("source_id", "dataset")


@query("resolve_texts", sql(f""", txt AS (
  SELECT r.node_id, r.dataset, t.text FROM resolved r
  LEFT JOIN documents t ON t.source = r.dataset
    AND CAST(t.doc_id AS VARCHAR) = regexp_replace(r.source_id, '^[^:]*:', ''))
SELECT node_id, CAST(count(*) AS BIGINT) AS n_pointers, CAST(count(*) FILTER (coalesce(text, '') <> '') AS BIGINT) AS n_texts,
       CAST(count(*) FILTER (coalesce(text, '') = '') AS BIGINT) AS n_failed
FROM txt GROUP BY node_id""", DOC_POINTERS))
def resolve_texts(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("source").alias("dataset"),
                                                 F.col("doc_id").cast("string").alias("source_key"), "text")
    return provenance.resolution_counts(provenance.resolve_texts(resolved(spark, sf), texts))


@query("provenance_counts", sql("""
SELECT node_id, dataset, CAST(count(*) AS BIGINT) AS n_sources,
       round(count(*) / sum(count(*)) OVER (PARTITION BY node_id), 6) AS share
FROM resolved GROUP BY node_id, dataset""", DOC_POINTERS))
def provenance_counts(spark, sf):
    return provenance.provenance_counts(resolved(spark, sf)).withColumn("share", r6("share"))


@query("label_update", sql("""
SELECT node_id, CASE WHEN key % 6 = 1 THEN 'new ' || key ELSE label END AS label FROM parts""", PARTS))
def label_update(spark, sf):
    p = parts(spark, sf)
    new = p.select("node_id", F.when(F.col("key") % 6 == 1, F.concat(F.lit("new "), "key")).alias("new_label"))
    return provenance.label_update(p, new).select("node_id", "label")


@query("unlabeled_top", sql("""
SELECT node_id, mass FROM parts WHERE coalesce(label, '') = '' AND (is_trained OR mass > 5)
ORDER BY mass DESC, node_id LIMIT 100""", PARTS))
def unlabeled_top(spark, sf):
    return reports.unlabeled_top(parts(spark, sf), 100)


@query("node_status_view", sql("""
SELECT a.node_id, p.node_id IS NOT NULL AS known, coalesce(mass, 0) AS mass, coalesce(variance, 0) AS variance, training_status,
       coalesce(is_trained, false) AS is_trained, coalesce(last_training_mass, 0) AS last_training_mass, coalesce(estimated_epochs, -1) AS estimated_epochs,
       coalesce(has_weights, false) AS has_weights
FROM (SELECT DISTINCT 'kn_' || lpad(CAST(o_custkey * 2 AS VARCHAR), 12, '0') AS node_id FROM orders) a
LEFT JOIN parts p ON p.node_id = a.node_id""", PARTS))
def node_status_view(spark, sf):
    asked = table(spark, sf, "orders").select(node_name(F.col("o_custkey") * 2).alias("node_id"))
    return reports.node_status_view(parts(spark, sf), asked).withColumn(
        "estimated_epochs", F.coalesce("estimated_epochs", F.lit(-1)))


@query("batch_numbers", """
SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 64 AS batch_no FROM orders""")
def batch_numbers(spark, sf):
    from nodeflow.operators.ranking import keyed_rank
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return keyed_rank(rows, [], "o_orderdate", "o_orderkey").select(
        "o_orderkey", F.floor((F.col("rank") - 1) / P.batch_rows).alias("batch_no"))


@query("file_row_numbers", """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id FROM documents""")
def file_row_numbers(spark, sf):
    """Arrival numbers of rows that lie in several files."""
    path = scratch_path(spark, "rows")
    _spread(table(spark, sf, "documents").select("doc_id"), "doc_id").write.parquet(path)
    return numbered(spark.read.parquet(path)).select("row_id", "doc_id")
