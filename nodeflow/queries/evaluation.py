"""Evaluation operators over events, documents and nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodeflow.operators import evaluation as E
from nodeflow.operators import nodestats, reports
from nodeflow.queries.base import (
    NODES, P, PARTS, POINTERS, key_of, node_name, nodes, parts, pointers, query, r6, sql, table,
)


def losses(spark, sf):
    return table(spark, sf, "events").select(node_name(F.col("user_id")).alias("node_id"), "ts", "event_id",
                                             (F.col("value") / 97).alias("loss"))


ROLLUP = f"""numbered AS (
  SELECT 'kn_' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS node_id, value / 97 AS loss,
         (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // {P.eval_batch_size} AS batch FROM events), per_batch AS (
  SELECT node_id, batch, avg(loss) AS loss FROM numbered GROUP BY node_id, batch), rollup_ AS (
  SELECT node_id, avg(loss) AS validation_loss, exp(avg(loss)) AS perplexity, count(*) AS n_batches FROM per_batch GROUP BY node_id)"""


@query("perplexity_rollup", sql("""
SELECT node_id, round(validation_loss, 6) AS validation_loss, round(perplexity, 6) AS perplexity, CAST(n_batches AS BIGINT) AS n_batches
FROM rollup_""", ROLLUP))
def perplexity_rollup(spark, sf):
    out = E.perplexity_rollup(losses(spark, sf), P, "node_id", "ts", "event_id")
    return out.withColumns({c: r6(c) for c in ("validation_loss", "perplexity")})


@query("perplexity_asked", sql("""
SELECT DISTINCT 'kn_' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS node_id,
       coalesce(round(validation_loss, 6), CAST('inf' AS DOUBLE)) AS validation_loss,
       coalesce(round(perplexity, 6), CAST('inf' AS DOUBLE)) AS perplexity, CAST(coalesce(n_batches, 0) AS BIGINT) AS n_batches
FROM customer LEFT JOIN rollup_ ON node_id = 'kn_' || lpad(CAST(c_custkey AS VARCHAR), 12, '0')""", ROLLUP))
def perplexity_asked(spark, sf):
    """Customers are the nodes asked for; those without events have no batches."""
    asked = table(spark, sf, "customer").select(node_name(F.col("c_custkey")).alias("node_id"))
    out = E.perplexity_rollup(losses(spark, sf), P, "node_id", "ts", "event_id", asked=asked)
    return out.withColumns({c: F.when(F.col(c) < float("inf"), r6(c)).otherwise(F.col(c)) for c in ("validation_loss", "perplexity")})


@query("top_adapters", sql("""
SELECT node_id, round(perplexity, 6) AS perplexity FROM rollup_ ORDER BY perplexity, node_id LIMIT 5""", ROLLUP))
def top_adapters(spark, sf):
    out = E.top_adapters(E.perplexity_rollup(losses(spark, sf), P, "node_id", "ts", "event_id"))
    return out.select("node_id", r6("perplexity").alias("perplexity"))


@query("validation_split", f"""
SELECT doc_id, source AS node_id FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM documents) WHERE n <= {P.eval_min_texts} OR i >= floor(n * (1 - {P.validation_split}))""")
def validation_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("node_id"))
    return E.validation_split(docs, P, "node_id", "doc_id")


def metrics(spark, sf):
    return table(spark, sf, "events").select(
        node_name(F.col("user_id")).alias("node_id"), F.col("event_type").alias("metric_name"),
        F.col("value").alias("metric_value"), F.col("ts").alias("evaluation_timestamp"))


@query("latest_metrics", """
SELECT 'kn_' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS node_id, event_type AS metric_name, value AS metric_value,
       ts AS evaluation_timestamp
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) = 1""")
def latest_metrics(spark, sf):
    return E.latest_metrics(metrics(spark, sf))


@query("eval_summary", """
SELECT event_type AS metric_name, CAST(count(*) AS BIGINT) AS n, min(value) AS min_value, max(value) AS max_value,
       round(avg(value), 6) AS avg_value, list_sort(list(value))[count(*) // 2 + 1] AS median_value
FROM events GROUP BY event_type""")
def eval_summary(spark, sf):
    return E.eval_summary(metrics(spark, sf)).withColumn("avg_value", r6("avg_value"))


@query("eval_outcomes", sql(f"""
, t AS (SELECT p.*, n FROM parts p LEFT JOIN (SELECT node_id, count(*) AS n FROM pointers GROUP BY node_id) USING (node_id)), s AS (
  SELECT NOT is_trained AS u, coalesce(n, 0) < {P.eval_min_texts} AS f, training_status = 'FAILED' AS e FROM t)
SELECT CAST(count(*) AS BIGINT) AS total_nodes, CAST(count(*) FILTER (NOT u AND NOT f AND NOT coalesce(e, false)) AS BIGINT) AS evaluated,
       CAST(count(*) FILTER (NOT u AND NOT f AND coalesce(e, false)) AS BIGINT) AS failed, CAST(count(*) FILTER (u OR f) AS BIGINT) AS skipped,
       CAST(count(*) FILTER (u) AS BIGINT) AS skipped_untrained, CAST(count(*) FILTER (NOT u AND f) AS BIGINT) AS skipped_few_texts FROM s""",
    f"{PARTS}, {POINTERS}"))
def eval_outcomes(spark, sf):
    counts = pointers(spark, sf).groupBy("node_id").agg(F.count("*").alias("n_texts"))
    rows = parts(spark, sf).join(counts, "node_id", "left").withColumn(
        "error", F.when(F.col("training_status") == "FAILED", "failed"))
    return E.eval_outcomes(rows, P)


@query("forgetting_drift", """
WITH b AS (SELECT user_id, exp(avg(value / 97)) AS p FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id),
     a AS (SELECT user_id, exp(avg(value / 97)) AS p FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id)
SELECT CAST(count(*) AS BIGINT) AS n_nodes, round(avg(b.p), 6) AS avg_before, round(avg(a.p), 6) AS avg_after,
       round(avg(a.p - b.p), 6) AS avg_drift FROM a JOIN b USING (user_id)""")
def forgetting_drift(spark, sf):
    cut = F.lit("2024-01-16").cast("timestamp_ntz")

    def snapshot(rows):
        return rows.groupBy("node_id").agg(F.exp(F.avg("loss")).alias("perplexity"))

    rows = losses(spark, sf)
    out = E.forgetting_drift(snapshot(rows.where(F.col("ts") < cut)), snapshot(rows.where(F.col("ts") >= cut)))
    return out.withColumns({c: r6(c) for c in ("avg_before", "avg_after", "avg_drift")})


@query("consolidation_metrics", sql(""", fcomp AS (
  SELECT label % 2 AS domain, label, vec_id // 128 AS b, pos, var_pop(v) AS vp, count(*) AS n
  FROM (SELECT label, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY ALL), fnl AS (
  SELECT domain, label, b, max(n) AS mass, CASE WHEN max(n) > 1 THEN sum(vp) * max(n) / (max(n) - 1) ELSE 0 END AS variance
  FROM fcomp GROUP BY domain, label, b), f AS (
  SELECT domain, count(*) AS final_nodes, max(mass) AS max_mass, avg(mass) AS avg_mass, avg(variance) AS avg_variance FROM fnl GROUP BY domain), i AS (
  SELECT key % 10 % 2 AS domain, count(*) AS initial_nodes FROM nodes GROUP BY ALL)
SELECT CAST(i.domain AS BIGINT) AS domain, CAST(initial_nodes AS BIGINT) AS initial_nodes, CAST(final_nodes AS BIGINT) AS final_nodes,
       round((initial_nodes - final_nodes) / initial_nodes, 6) AS consolidation, CAST(max_mass AS BIGINT) AS max_mass,
       round(max_mass / avg_mass, 6) AS hub_ratio, round(avg_variance, 6) AS avg_variance,
       round(avg_variance / (SELECT arg_min(avg_variance, domain) FROM f) - 1, 6) + 0.0 AS variance_change
FROM i JOIN f ON i.domain = f.domain"""))
def consolidation_metrics(spark, sf):
    """Two neighbouring batches of a label folded into one node; even and odd labels are two domains."""
    before = nodes(spark, sf).withColumn("domain", F.col("key") % 10 % 2)
    group = F.floor(F.col("key") / 20) * 10 + F.col("key") % 10
    merged = nodestats.merge_signatures(before.withColumn("node_id", node_name(group)), P)
    after = merged.withColumn("domain", key_of(F.col("node_id")) % 10 % 2)
    out = reports.consolidation_metrics(before, after)
    return out.withColumns({c: r6(c) for c in ("consolidation", "hub_ratio", "avg_variance", "variance_change")})
