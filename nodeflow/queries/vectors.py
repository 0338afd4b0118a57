"""Vector primitives, node statistics and routing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeflow.functions import vectors as V
from nodeflow.operators import buffers, evaluation, nodestats, reports, routing
from nodeflow.queries.base import (
    LEADER, MEMBERS, NODES, P, STATS, key_of, members, nodes, query, r6, sql, table,
)

THRESHOLD = f"{P.s_min} - {P.threshold_decay} / greatest(ln(1 + mass), {P.threshold_min_log})"

SIMS = NODES + """, sims AS (
  SELECT m.row_id, n.node_id, n.mass, n.variance,
         round(list_cosine_similarity(m.embedding, n.centroid), 9) AS sim
  FROM members m CROSS JOIN nodes n)"""


@query("vec_cosine", sql("""
SELECT row_id, m.node_id, round(list_cosine_similarity(embedding, centroid), 6) AS sim
FROM members m JOIN nodes n ON m.node_id = n.node_id"""))
def vec_cosine(spark, sf):
    pairs = members(spark, sf).select("row_id", "node_id", "embedding").join(
        nodes(spark, sf).select("node_id", "centroid"), "node_id")
    return routing.pair_cosine(pairs).withColumn("sim", r6("sim"))


@query("vec_topk", sql(""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, node_id) AS rn FROM sims)
SELECT row_id, node_id, round(sim, 6) AS sim FROM ranked WHERE rn <= 3""", SIMS))
def vec_topk(spark, sf):
    return routing.topk(members(spark, sf), nodes(spark, sf), 3, P).withColumn("sim", r6("sim"))


def _long(df):
    return df.select("node_id", F.posexplode("centroid").alias("pos", "c")).select("node_id", "pos", r6("c").alias("c"))


@query("node_centroid", sql("SELECT node_id, CAST(pos - 1 AS INTEGER) AS pos, round(c, 6) + 0 AS c FROM comp", STATS))
def node_centroid(spark, sf):
    return _long(nodestats.node_signatures(members(spark, sf), P))


@query("vec_sq_dist", sql("""
SELECT row_id, m.node_id, round(list_distance(embedding, centroid) ** 2, 6) AS sq_dist
FROM members m JOIN nodes n ON m.node_id = n.node_id"""))
def vec_sq_dist(spark, sf):
    joined = members(spark, sf).join(nodes(spark, sf).select("node_id", "centroid"), "node_id")
    return joined.select("row_id", "node_id", r6(V.sq_dist(F.col("embedding"), F.col("centroid"))).alias("sq_dist"))


@query("vector_validate", """
SELECT label, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) FILTER (len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0) AS BIGINT) AS n_valid
FROM embeddings GROUP BY label""")
def vector_validate(spark, sf):
    from nodeflow.sources.vectors import validated
    good, bad = validated(table(spark, sf, "embeddings"), P)
    both = good.select("label", F.lit(1).alias("ok")).unionByName(bad.select("label", F.lit(0).alias("ok")))
    return both.groupBy("label").agg(F.count("*").alias("n_rows"), F.sum("ok").alias("n_valid"))


@query("dynamic_threshold", sql(f"SELECT node_id, mass, round({THRESHOLD}, 6) AS threshold FROM nodes"))
def dynamic_threshold(spark, sf):
    # only the mass is asked for, so the vectors are never read
    mass = members(spark, sf).groupBy("node_id").agg(F.count("*").alias("mass"))
    return mass.select("node_id", "mass", r6(routing.dynamic_threshold(F.col("mass"), P)).alias("threshold"))


@query("local_filter", sql(f"""
SELECT row_id, m.node_id, round(list_cosine_similarity(embedding, centroid), 9) >= {P.s_min} AS accepted
FROM members m JOIN nodes n ON m.node_id = n.node_id"""))
def local_filter(spark, sf):
    joined = members(spark, sf).join(nodes(spark, sf).select("node_id", "centroid"), "node_id")
    sim = V.cosine(F.col("embedding"), F.col("centroid"))
    return joined.select("row_id", "node_id", routing.local_filter(sim, F.col("centroid"), P).alias("accepted"))


ROUTED = SIMS + f""", routed AS (
  SELECT row_id, node_id, sim, round({THRESHOLD}, 9) AS threshold, sim + {P.mass_weight} * ln(1 + mass) AS score,
         row_number() OVER (PARTITION BY row_id ORDER BY sim + {P.mass_weight} * ln(1 + mass) DESC, node_id) AS rn
  FROM sims WHERE sim >= round({THRESHOLD}, 9))"""


@query("route_batch", sql("""
SELECT m.row_id, coalesce(r.node_id, 'NEW_BUFFER') AS node_id, round(coalesce(r.score, 0), 6) AS score,
       round(r.sim, 6) AS sim, round(r.threshold, 6) AS threshold
FROM members m LEFT JOIN routed r ON m.row_id = r.row_id AND r.rn = 1""", ROUTED))
def route_batch(spark, sf):
    out = routing.route(members(spark, sf), nodes(spark, sf), P)
    return out.withColumns({c: r6(c) for c in ("score", "sim", "threshold")})


@query("route_miss_gap", sql(f""", best AS (
  SELECT *, {THRESHOLD} AS threshold, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, node_id) AS rn
  FROM sims WHERE row_id NOT IN (SELECT row_id FROM routed))
SELECT row_id, node_id, round(sim, 6) AS sim, round(threshold, 6) AS threshold, round(threshold - sim, 6) AS gap
FROM best WHERE rn = 1""", ROUTED))
def route_miss_gap(spark, sf):
    out = routing.route_miss_gap(members(spark, sf), nodes(spark, sf), P)
    return out.withColumns({c: r6(c) for c in ("sim", "threshold", "gap")})


@query("affinity_topk", sql(""", ranked AS (
  SELECT *, mass * sim / (variance + 1e-6) AS affinity,
         row_number() OVER (PARTITION BY row_id ORDER BY mass * sim / (variance + 1e-6) DESC, node_id) AS rn FROM sims)
SELECT row_id, node_id, round(sim, 6) AS sim, round(affinity, 4) AS affinity FROM ranked WHERE rn <= 3""", SIMS))
def affinity_topk(spark, sf):
    out = routing.affinity_topk(members(spark, sf), nodes(spark, sf), 3, P)
    return out.select("row_id", "node_id", r6("sim").alias("sim"), F.round("affinity", 4).alias("affinity"))


@query("node_stats", sql("""
SELECT node_id, CAST(mass AS BIGINT) AS mass, round(CASE WHEN mass > 1 THEN variance * (mass - 1) ELSE 0 END, 6) AS m2,
       round(list_dot_product(centroid, centroid), 6) AS centroid_sq
FROM stats""", STATS))
def node_stats(spark, sf):
    out = nodestats.node_stats(members(spark, sf), P)
    return out.select("node_id", "mass", r6("m2").alias("m2"),
                      r6(V.dot(F.col("centroid"), F.col("centroid"))).alias("centroid_sq"))


@query("node_signature", sql("SELECT node_id, CAST(mass AS BIGINT) AS mass, round(variance, 6) AS variance FROM stats", STATS))
def node_signature(spark, sf):
    return nodestats.node_signatures(members(spark, sf), P).select("node_id", "mass", r6("variance").alias("variance"))


LABEL_STATS = """one AS (
  SELECT label, pos, avg(v) AS c, var_pop(v) AS vp, count(*) AS n
  FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY label, pos)"""


@query("merge_signatures", sql("""
SELECT 'label_' || label AS node_id, CAST(max(n) AS BIGINT) AS mass, round(sum(vp) * max(n) / (max(n) - 1), 6) AS variance,
       round(sum(c * c), 6) AS centroid_sq
FROM one GROUP BY label""", LABEL_STATS))
def merge_signatures(spark, sf):
    """Signatures of the small nodes folded per label equal the statistics of the label's rows."""
    parts = nodestats.node_signatures(members(spark, sf), P).withColumn(
        "node_id", F.concat(F.lit("label_"), (key_of(F.col("node_id")) % 10).cast("string")))
    merged = nodestats.merge_signatures(parts, P)
    return merged.select("node_id", "mass", r6("variance").alias("variance"),
                         r6(V.dot(F.col("centroid"), F.col("centroid"))).alias("centroid_sq"))


@query("buffer_centroid", sql("""
SELECT node_id AS buffer_id, CAST(pos - 1 AS INTEGER) AS pos, CAST(n AS BIGINT) AS size, round(c, 6) + 0 AS c FROM comp""", STATS))
def buffer_centroid(spark, sf):
    rows = members(spark, sf).select(F.col("node_id").alias("buffer_id"), "embedding")
    out = buffers.buffer_centroids(rows, P)
    return out.select("buffer_id", "size", F.posexplode("centroid").alias("pos", "c")).withColumn("c", r6("c"))


@query("nearest_buffer", sql(f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, node_id) AS rn FROM sims WHERE sim >= {P.s_min})
SELECT row_id, node_id AS buffer_id, round(sim, 6) AS sim FROM ranked WHERE rn = 1""", SIMS))
def nearest_buffer(spark, sf):
    m = members(spark, sf)
    b = buffers.buffer_centroids(m.select(F.col("node_id").alias("buffer_id"), "embedding"), P)
    return routing.nearest_buffer(m, b, P).withColumn("sim", r6("sim"))


@query("node_members", f"""WITH {MEMBERS}
SELECT node_id, CAST(count(*) * 2 AS BIGINT) AS n_members, min(row_id) AS first_row, max(row_id) + 1000000000 AS last_row
FROM members GROUP BY node_id""")
def node_members(spark, sf):
    """Memory keeps what it has and takes every new member once, repeats included."""
    from nodeflow.operators.state import node_members as append
    m = members(spark, sf).select("node_id", "row_id", "embedding")
    again = m.withColumn("row_id", F.explode(F.array("row_id", F.col("row_id") + 1_000_000_000)))
    both = append(m, again)
    return both.groupBy("node_id").agg(F.count("*").alias("n_members"), F.min("row_id").alias("first_row"),
                                       F.max("row_id").alias("last_row"))


@query("node_update", sql(f""", acc AS (
  SELECT m.*, round(list_cosine_similarity(m.embedding, n.centroid), 9) >= {P.s_min} AS ok
  FROM members m JOIN nodes n ON m.node_id = n.node_id), rows AS (
  SELECT node_id, embedding FROM members UNION ALL SELECT node_id, embedding FROM acc WHERE ok), c2 AS (
  SELECT node_id, pos, var_pop(v) AS vp, avg(v) AS c, count(*) AS n
  FROM (SELECT node_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM rows) GROUP BY node_id, pos)
SELECT node_id, CAST(max(n) AS BIGINT) AS mass,
       round(CASE WHEN max(n) > 1 THEN sum(vp) * max(n) / (max(n) - 1) ELSE 0 END, 6) AS variance,
       round(sum(c * c), 6) AS centroid_sq
FROM c2 GROUP BY node_id"""))
def node_update(spark, sf):
    """Nodes take in again every row that their own filter accepts."""
    n, m = nodes(spark, sf), members(spark, sf)
    sim = V.cosine(F.col("embedding"), F.col("centroid"))
    accepted = m.join(n.select("node_id", "centroid"), "node_id").where(
        routing.local_filter(sim, F.col("centroid"), P)).select("node_id", "embedding")
    out = nodestats.node_update(n, accepted, P)
    return out.select("node_id", "mass", r6("variance").alias("variance"),
                      r6(V.dot(F.col("centroid"), F.col("centroid"))).alias("centroid_sq"))


@query("thematic_coherence", sql("""
SELECT m.node_id, round(avg(list_cosine_similarity(embedding, centroid)), 6) AS coherence
FROM members m JOIN nodes n ON m.node_id = n.node_id GROUP BY m.node_id"""))
def thematic_coherence(spark, sf):
    return nodestats.thematic_coherence(members(spark, sf), nodes(spark, sf)).withColumn("coherence", r6("coherence"))


@query("leader_cluster", f"""WITH RECURSIVE {MEMBERS}, near AS (
  SELECT a.row_id AS row_id, b.row_id AS other, round(list_cosine_similarity(a.embedding, b.embedding), 9) AS sim
  FROM members a JOIN members b ON b.row_id < a.row_id
  WHERE round(list_cosine_similarity(a.embedding, b.embedding), 9) >= {LEADER.s_min}),
  adj AS (
  SELECT m.row_id, row_number() OVER (ORDER BY m.row_id) AS i,
         coalesce((SELECT list(other) FROM near WHERE near.row_id = m.row_id), []) AS nb
  FROM members m), walk(i, leaders) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT adj.i, CASE WHEN list_has_any(walk.leaders, adj.nb) THEN walk.leaders
                     ELSE list_append(walk.leaders, adj.row_id) END
  FROM walk JOIN adj ON adj.i = walk.i + 1), fin AS (
  SELECT unnest(leaders) AS leader FROM walk WHERE i = (SELECT max(i) FROM adj)), follow AS (
  SELECT row_id, other, sim, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, other) AS rn
  FROM near WHERE other IN (SELECT leader FROM fin) AND row_id NOT IN (SELECT leader FROM fin))
SELECT row_id, other AS buffer_row, round(sim, 6) AS sim FROM follow WHERE rn = 1
UNION ALL SELECT leader, leader, 1.0 FROM fin""")
def leader_cluster(spark, sf):
    rows = members(spark, sf).select("row_id", F.col("row_id").alias("rank"), "embedding")
    return buffers.leader_cluster(rows, LEADER).withColumn("sim", r6("sim"))


@query("run_summary", sql("""
SELECT CAST(count(*) AS BIGINT) AS total_nodes, CAST(sum(mass) AS BIGINT) AS total_mass, round(avg(mass), 6) AS avg_mass,
       round(avg(variance), 6) AS avg_variance, CAST(count(*) FILTER (is_trained) AS BIGINT) AS trained_nodes,
       CAST(count(*) FILTER (mass > 5) AS BIGINT) AS candidate_nodes FROM nodes"""))
def run_summary(spark, sf):
    return reports.run_summary(nodes(spark, sf)).withColumns({c: r6(c) for c in ("avg_mass", "avg_variance")})


@query("top_nodes", sql("""
SELECT node_id, CAST(mass AS BIGINT) AS mass, round(variance, 6) AS variance FROM nodes ORDER BY mass DESC, node_id LIMIT 10"""))
def top_nodes(spark, sf):
    return reports.top_nodes(nodes(spark, sf)).withColumn("variance", r6("variance"))


@query("confidence_mean", sql(""", steps AS (
  SELECT row_id, g AS step, embedding[g * 16 + 1 : g * 16 + 16] AS scores FROM members, range(4) t(g)), tops AS (
  SELECT row_id, 1 / list_sum(list_transform(scores, lambda x: exp(x - list_max(scores)))) AS top FROM steps)
SELECT row_id, round(avg(top), 6) AS confidence FROM tops GROUP BY row_id""", MEMBERS))
def confidence_mean(spark, sf):
    """Vectors read as four generation steps of 16 scores each."""
    scores = F.col("embedding").cast("array<double>")
    steps = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda g: F.slice(scores, g * 16 + 1, 16))
    return members(spark, sf).select("row_id", r6(evaluation.confidence(steps)).alias("confidence"))
