"""Shared inputs of the registered queries, once for Spark and once as SQL text.

Nodes are made from the ``embeddings`` table: one node per label and batch of 64 arrivals, so
their number grows with the table. Their training attributes are fixed functions of the node
key. Rule operators use ``part`` rows as nodes and ``lineitem`` as their pointers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeflow.operators import nodestats
from nodeflow.params import Params

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Test vectors are nearly orthogonal, so thresholds are lower than the defaults.
P = Params(dim=64, s_min=0.40, fusion_similarity=0.15, fusion_max_mass=10, fusion_max_variance=1.1,
           fusion_variance_increase=-0.04, micro_max_mass=5,
           micro_similarity=0.10, titan_min_mass=8, titan_max_variance=1.1, titan_similarity=0.10,
           adoption_similarity=0.15, late_binding_similarity=0.12, re_evaluation_similarity=0.11)
LEADER = replace(P, s_min=0.25)
AS_OF = "2024-01-31 00:00:00"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def node_name(key: Column) -> Column:
    return F.concat(F.lit("kn_"), F.lpad(key.cast("string"), 12, "0"))


def members(spark, sf) -> DataFrame:
    key = F.floor(F.col("vec_id") / 64) * 10 + F.col("label")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), key.alias("key"), node_name(key).alias("node_id"), "embedding")


def key_of(node_id: Column) -> Column:
    return F.substring(node_id, 4, 12).cast("bigint")


def attributed(nodes: DataFrame) -> DataFrame:
    """Training attributes as fixed functions of the node key."""
    k = F.col("key")
    trained = k % 3 != 0
    parent = F.when((k % 5 == 2) & (k >= 10), node_name(k - 10))
    return nodes.withColumn("key", key_of(F.col("node_id"))).select(
        *nodes.columns, "key",
        F.when(k % 17 == 0, "SEED").otherwise("ORGANIC").alias("origin_type"), trained.alias("is_trained"),
        F.when(k % 11 == 0, "FAILED").when(k % 7 == 3, "TRAINING").when(trained, "COMPLETED").alias("training_status"),
        (k % 4 != 0).alias("needs_training"), parent.alias("parent_node_id"),
        F.when(parent.isNotNull(), 0.5 + (k % 50) / 100.0).alias("parent_similarity"),
        F.when(parent.isNotNull(), "HERITAGE").otherwise("ROOT").alias("inheritance_type"))


def nodes(spark, sf) -> DataFrame:
    return attributed(nodestats.node_signatures(members(spark, sf), P))


MEMBERS = """members AS (
  SELECT vec_id AS row_id, (vec_id // 64) * 10 + label AS key,
         'kn_' || lpad(CAST((vec_id // 64) * 10 + label AS VARCHAR), 12, '0') AS node_id,
         CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings)"""

STATS = MEMBERS + """, comp AS (
  SELECT node_id, key, pos, avg(v) AS c, var_pop(v) AS vp, count(*) AS n
  FROM (SELECT node_id, key, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM members)
  GROUP BY node_id, key, pos), stats AS (
  SELECT node_id, key, max(n) AS mass, list(c ORDER BY pos) AS centroid,
         CASE WHEN max(n) > 1 THEN sum(vp) * max(n) / (max(n) - 1) ELSE 0 END AS variance
  FROM comp GROUP BY node_id, key)"""

NODES = STATS + """, nodes AS (
  SELECT node_id, key, mass, centroid, variance,
         CASE WHEN key % 17 = 0 THEN 'SEED' ELSE 'ORGANIC' END AS origin_type,
         key % 3 <> 0 AS is_trained,
         CASE WHEN key % 11 = 0 THEN 'FAILED' WHEN key % 7 = 3 THEN 'TRAINING'
              WHEN key % 3 <> 0 THEN 'COMPLETED' END AS training_status,
         key % 4 <> 0 AS needs_training,
         CASE WHEN key % 5 = 2 AND key >= 10 THEN 'kn_' || lpad(CAST(key - 10 AS VARCHAR), 12, '0') END AS parent_node_id,
         CASE WHEN key % 5 = 2 AND key >= 10 THEN 0.5 + (key % 50) / 100.0 END AS parent_similarity,
         CASE WHEN key % 5 = 2 AND key >= 10 THEN 'HERITAGE' ELSE 'ROOT' END AS inheritance_type
  FROM stats)"""

PAIRS = NODES + """, pairs AS (
  SELECT a.node_id AS node_id_1, b.node_id AS node_id_2,
         round(list_cosine_similarity(a.centroid, b.centroid), 9) AS sim
  FROM nodes a JOIN nodes b ON a.node_id < b.node_id)"""


def sql(text: str, base: str = NODES) -> str:
    return f"WITH {base}{text if text.startswith(',') else ' ' + text}"


# ---- rule nodes from part, pointers from lineitem ---------------------------------------------

def parts(spark, sf) -> DataFrame:
    """part rows as nodes: mass 5..250, variance 0..2 or null, every state and a parent for a part of them."""
    k = F.col("p_partkey")
    trained = k % 3 != 0
    parent = F.when(k % 5 == 2, node_name(F.when(k % 25 == 2, k).otherwise(F.floor(k / 2))))
    exit_at = as_of() - F.make_dt_interval(hours=(k % 300).cast("int"))
    return table(spark, sf, "part").select(
        node_name(k).alias("node_id"), k.alias("key"),
        (F.col("p_size") * 5).cast("bigint").alias("mass"),
        F.when(k % 13 != 0, (k % 1000) / 500.0).alias("variance"),
        F.when(k % 17 == 0, "SEED").otherwise("ORGANIC").alias("origin_type"), trained.alias("is_trained"),
        F.when(k % 11 == 0, "FAILED").when(k % 7 == 3, "TRAINING").when(trained, "COMPLETED").alias("training_status"),
        (k % 4 != 0).alias("needs_training"), parent.alias("parent_node_id"),
        F.when(parent.isNotNull(), (k % 101) / 100.0).alias("parent_similarity"),
        F.when(parent.isNull(), "ROOT").when(k % 2 == 0, "HERITAGE").otherwise("FALLBACK").alias("inheritance_type"),
        F.when(k % 6 != 0, (k % 40).cast("bigint")).alias("last_training_mass"),
        F.when(k % 8 != 0, (k % 7 + 1).cast("int")).alias("estimated_epochs"),
        (k % 3 == 1).alias("has_weights"),
        F.when(k % 9 == 0, F.lit("")).when(k % 9 < 5, F.col("p_name")).alias("label"),
        (k % 13 == 6).alias("forced_root"), (k % 4 - 1).cast("int").alias("quarantine_count"),
        F.when(k % 3 != 2, exit_at).alias("last_quarantine_exit"), (k % 5).cast("bigint").alias("total_failures"),
        F.lit(None).cast("timestamp_ntz").alias("last_failure_time"))


PARTS = f"""parts AS (
  SELECT 'kn_' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS node_id, p_partkey AS key,
         CAST(p_size * 5 AS BIGINT) AS mass,
         CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 1000) / 500.0 END AS variance,
         CASE WHEN p_partkey % 17 = 0 THEN 'SEED' ELSE 'ORGANIC' END AS origin_type,
         p_partkey % 3 <> 0 AS is_trained,
         CASE WHEN p_partkey % 11 = 0 THEN 'FAILED' WHEN p_partkey % 7 = 3 THEN 'TRAINING'
              WHEN p_partkey % 3 <> 0 THEN 'COMPLETED' END AS training_status,
         p_partkey % 4 <> 0 AS needs_training,
         CASE WHEN p_partkey % 5 = 2 THEN 'kn_' || lpad(CAST(
              CASE WHEN p_partkey % 25 = 2 THEN p_partkey ELSE p_partkey // 2 END AS VARCHAR), 12, '0') END AS parent_node_id,
         CASE WHEN p_partkey % 5 = 2 THEN (p_partkey % 101) / 100.0 END AS parent_similarity,
         CASE WHEN p_partkey % 5 <> 2 THEN 'ROOT' WHEN p_partkey % 2 = 0 THEN 'HERITAGE' ELSE 'FALLBACK' END AS inheritance_type,
         CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 40 END AS last_training_mass,
         CASE WHEN p_partkey % 8 <> 0 THEN CAST(p_partkey % 7 + 1 AS INTEGER) END AS estimated_epochs,
         p_partkey % 3 = 1 AS has_weights,
         CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 9 < 5 THEN p_name END AS label,
         p_partkey % 13 = 6 AS forced_root, CAST(p_partkey % 4 - 1 AS INTEGER) AS quarantine_count,
         CASE WHEN p_partkey % 3 <> 2 THEN TIMESTAMP '{AS_OF}' - to_hours(p_partkey % 300) END AS last_quarantine_exit,
         p_partkey % 5 AS total_failures
  FROM part)"""


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def pointers(spark, sf) -> DataFrame:
    """lineitem rows as pointers from a part to the order it appears in."""
    return table(spark, sf, "lineitem").select(
        node_name(F.col("l_partkey")).alias("node_id"), F.col("l_orderkey").cast("string").alias("source_id")).distinct()


POINTERS = """pointers AS (
  SELECT DISTINCT 'kn_' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS node_id, CAST(l_orderkey AS VARCHAR) AS source_id
  FROM lineitem)"""
