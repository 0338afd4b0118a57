"""Adjacency, fusion, parents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from nodeflow.functions import vectors as V
from nodeflow.operators import buffers, fusion, parents, routing
from nodeflow.operators.provenance import cascade_delete
from nodeflow.operators import quarantine as Q
from nodeflow.queries.base import (
    NODES, P, PAIRS, as_of, key_of, members, nodes, query, r6, sql,
)

LEVELS = (0.10, 0.15, 0.20, 0.25, 0.30)
SMALL = f"mass <= {P.fusion_max_mass}"
STABLE = f"variance <= {P.fusion_max_variance}"


@query("small_stable", sql(f"""
SELECT node_id, CAST(mass AS BIGINT) AS mass, round(variance, 6) AS variance FROM nodes
WHERE {SMALL} AND {STABLE} AND origin_type <> 'SEED'"""))
def small_stable(spark, sf):
    return fusion.small_stable(nodes(spark, sf), P).select("node_id", "mass", r6("variance").alias("variance"))


@query("node_adjacency", sql("SELECT node_id_1, node_id_2, round(sim, 6) AS sim FROM pairs WHERE sim >= 0.10", PAIRS))
def node_adjacency(spark, sf):
    return fusion.adjacency(nodes(spark, sf), 0.10, P).withColumn("sim", r6("sim"))


@query("similarity_histogram", sql(f"""
SELECT CAST(t AS DOUBLE) AS threshold, CAST(count(*) FILTER (sim >= t) AS BIGINT) AS n_pairs
FROM pairs CROSS JOIN (SELECT unnest({list(LEVELS)}) AS t) GROUP BY t""", PAIRS))
def similarity_histogram(spark, sf):
    return fusion.similarity_histogram(nodes(spark, sf), LEVELS, P)


CANDIDATES = PAIRS + f""", cand AS (
  SELECT node_id_1, node_id_2, sim FROM pairs
  JOIN nodes a ON a.node_id = node_id_1 JOIN nodes b ON b.node_id = node_id_2
  WHERE sim >= {P.fusion_similarity} AND a.{SMALL} AND b.{SMALL} AND a.{STABLE} AND b.{STABLE}
    AND a.origin_type <> 'SEED' AND b.origin_type <> 'SEED'
    AND round(CASE WHEN a.mass + b.mass <= 1 THEN 0 ELSE greatest(0, ((a.mass - 1) * a.variance + (b.mass - 1) * b.variance
        + a.mass * b.mass * list_distance(a.centroid, b.centroid) ** 2 / (a.mass + b.mass)) / (a.mass + b.mass - 1)) END
        - greatest(a.variance, b.variance), 9) <= {P.fusion_variance_increase})"""


@query("fusion_candidates", sql("SELECT node_id_1, node_id_2, round(sim, 6) AS sim FROM cand", CANDIDATES))
def fusion_candidates(spark, sf):
    return fusion.fusion_candidates(nodes(spark, sf), P).withColumn("sim", r6("sim"))


MATCHING = CANDIDATES + """, ordered AS (
  SELECT *, row_number() OVER (ORDER BY sim DESC, node_id_1, node_id_2) AS i FROM cand), walk(i, used, hit) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false
  UNION ALL
  SELECT o.i, CASE WHEN list_has_any(used, [node_id_1, node_id_2]) THEN used
                   ELSE list_concat(used, [node_id_1, node_id_2]) END,
         NOT list_has_any(used, [node_id_1, node_id_2])
  FROM walk JOIN ordered o ON o.i = walk.i + 1), matching AS (
  SELECT node_id_1, node_id_2, sim FROM ordered JOIN walk USING (i) WHERE hit)"""


@query("fusion_matching", "WITH RECURSIVE " + MATCHING + """
SELECT node_id_1, node_id_2, round(sim, 6) AS sim FROM matching""")
def fusion_matching(spark, sf):
    return fusion.fusion_matching(nodes(spark, sf), P).withColumn("sim", r6("sim"))


@query("fusion_apply", "WITH RECURSIVE " + MATCHING + f""", map AS (
  SELECT node_id_1 AS old_id, 'kn_' || sha256(node_id_1 || '|' || node_id_2) AS new_id FROM matching
  UNION ALL SELECT node_id_2, 'kn_' || sha256(node_id_1 || '|' || node_id_2) FROM matching), mcomp AS (
  SELECT new_id AS node_id, pos, avg(v) AS c, var_pop(v) AS vp, count(*) AS n
  FROM (SELECT new_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos
        FROM members JOIN map ON node_id = old_id) GROUP BY new_id, pos), fresh AS (
  SELECT node_id, max(n) AS mass, sum(vp) * max(n) / (max(n) - 1) AS variance FROM mcomp GROUP BY node_id), flags AS (
  SELECT new_id AS node_id, bool_or(needs_training OR is_trained) AS carry
  FROM nodes JOIN map ON node_id = old_id GROUP BY new_id)
SELECT f.node_id, CAST(mass AS BIGINT) AS mass, round(variance, 6) AS variance, false AS is_trained,
       carry OR mass >= {P.training_threshold} AS needs_training, CAST(NULL AS VARCHAR) AS parent_node_id,
       'ROOT' AS inheritance_type
FROM fresh f JOIN flags USING (node_id)
UNION ALL
SELECT n.node_id, CAST(mass AS BIGINT), round(variance, 6), is_trained, needs_training,
       coalesce(m.new_id, parent_node_id), inheritance_type
FROM nodes n LEFT JOIN map m ON m.old_id = parent_node_id
WHERE n.node_id NOT IN (SELECT old_id FROM map)""")
def fusion_apply(spark, sf):
    n = nodes(spark, sf)
    mapping = fusion.merge_map(fusion.fusion_matching(n, P))
    return fusion.apply_merges(n, mapping, P).select(
        "node_id", "mass", r6("variance").alias("variance"), "is_trained", "needs_training", "parent_node_id",
        "inheritance_type")


@query("pointer_reassign", "WITH RECURSIVE " + MATCHING + """, map AS (
  SELECT node_id_1 AS old_id, 'kn_' || sha256(node_id_1 || '|' || node_id_2) AS new_id FROM matching
  UNION ALL SELECT node_id_2, 'kn_' || sha256(node_id_1 || '|' || node_id_2) FROM matching)
SELECT DISTINCT coalesce(new_id, node_id) AS node_id, CAST(row_id // 3 AS VARCHAR) AS source_id
FROM members LEFT JOIN map ON node_id = old_id""")
def pointer_reassign(spark, sf):
    pointers = members(spark, sf).select("node_id", F.floor(F.col("row_id") / 3).cast("string").alias("source_id"))
    mapping = fusion.merge_map(fusion.fusion_matching(nodes(spark, sf), P))
    return fusion.reassign_pointers(pointers, mapping)


@query("cascade_delete", "WITH RECURSIVE " + MATCHING + """, gone AS (
  SELECT node_id_1 AS node_id FROM matching UNION ALL SELECT node_id_2 FROM matching)
SELECT 'members' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM members WHERE node_id NOT IN (SELECT node_id FROM gone)
UNION ALL
SELECT 'nodes', CAST(count(*) AS BIGINT) FROM nodes WHERE node_id NOT IN (SELECT node_id FROM gone)""")
def cascade(spark, sf):
    n = nodes(spark, sf)
    gone = fusion.merge_map(fusion.fusion_matching(n, P)).select(F.col("old_id").alias("node_id"))
    left = cascade_delete({"members": members(spark, sf), "nodes": n}, gone)
    return left["members"].select(F.lit("members").alias("table_name")).unionByName(
        left["nodes"].select(F.lit("nodes").alias("table_name"))).groupBy("table_name").agg(F.count("*").alias("n_rows"))


POPULATION = f"""
       CAST(count(*) AS BIGINT) AS total_nodes, round(avg(mass), 6) AS avg_mass, CAST(min(mass) AS BIGINT) AS min_mass,
       CAST(max(mass) AS BIGINT) AS max_mass, round(avg(variance), 6) AS avg_variance, round(min(variance), 6) AS min_variance,
       round(max(variance), 6) AS max_variance, CAST(count(*) FILTER ({SMALL}) AS BIGINT) AS small_nodes,
       CAST(count(*) FILTER ({STABLE}) AS BIGINT) AS stable_nodes,
       CAST(count(*) FILTER ({SMALL} AND {STABLE}) AS BIGINT) AS small_stable_nodes"""
_ROUND = ("avg_mass", "avg_variance", "min_variance", "max_variance")


@query("node_population", sql(f"SELECT {POPULATION} FROM nodes"))
def node_population(spark, sf):
    return fusion.population(nodes(spark, sf), P).withColumns({c: r6(c) for c in _ROUND})


STRICT = replace(P, fusion_similarity=0.60, fusion_max_mass=2, fusion_max_variance=0.4)


@query("fusion_diagnose", sql(f""", levels AS (
  SELECT t, count(*) FILTER (sim >= t) AS n FROM pairs CROSS JOIN (SELECT unnest({[*LEVELS, 0.60]}) AS t) GROUP BY t), c AS (
  SELECT sum(n) FILTER (t = 0.60) AS hits, min(t) FILTER (n > 0) AS low FROM levels), pop AS (
  SELECT {POPULATION.replace(SMALL, 'mass <= 2').replace(STABLE, 'variance <= 0.4')} FROM nodes)
SELECT pop.*, CAST(hits AS BIGINT) AS pairs_at_threshold, CAST(low AS DOUBLE) AS lowest_with_pairs,
       concat_ws(',', CASE WHEN small_stable_nodes < 2 THEN 'FEW_CANDIDATES' END,
         CASE WHEN hits = 0 AND low IS NOT NULL THEN printf('LOWER_SIMILARITY:%.2f', CAST(low AS DOUBLE)) END,
         CASE WHEN avg_mass > 4 THEN 'RAISE_MAX_MASS' END,
         CASE WHEN avg_variance > 0.8 THEN 'RAISE_MAX_VARIANCE' END) AS advice
FROM pop, c""", PAIRS))
def fusion_diagnose(spark, sf):
    return fusion.diagnose(nodes(spark, sf), LEVELS, STRICT).withColumns({c: r6(c) for c in _ROUND})


TITAN = (f"mass >= {P.titan_min_mass} AND (variance IS NULL OR variance <= {P.titan_max_variance}) AND is_trained "
         "AND (training_status IS NULL OR training_status <> 'FAILED')")


@query("titans", sql(f"SELECT node_id, CAST(mass AS BIGINT) AS mass, round(variance, 6) AS variance FROM nodes WHERE {TITAN}"))
def titans(spark, sf):
    return parents.titans(nodes(spark, sf), P).select("node_id", "mass", r6("variance").alias("variance"))


TITAN_SIMS = NODES + f""", tsims AS (
  SELECT c.node_id, c.needs_training, c.parent_node_id AS old_parent, c.training_status AS child_status, c.key,
         t.node_id AS parent_node_id, t.mass, t.variance,
         round(list_cosine_similarity(c.centroid, t.centroid), 9) AS sim
  FROM nodes c JOIN (SELECT * FROM nodes WHERE {TITAN}) t ON c.node_id <> t.node_id)"""


@query("best_parent", sql(f""", ranked AS (
  SELECT *, mass * sim / (1 + variance) AS affinity,
         row_number() OVER (PARTITION BY node_id ORDER BY mass * sim / (1 + variance) DESC, parent_node_id) AS rn
  FROM tsims WHERE sim >= {P.titan_similarity})
SELECT node_id, parent_node_id, round(sim, 6) AS sim, round(affinity, 6) AS affinity FROM ranked WHERE rn = 1""", TITAN_SIMS))
def best_parent(spark, sf):
    n = nodes(spark, sf)
    out = parents.best_parent(n, parents.titans(n, P), P)
    return out.withColumns({"sim": r6("sim"), "affinity": r6("affinity")})


@query("late_binding", sql(f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY sim DESC, parent_node_id) AS rn
  FROM tsims WHERE sim >= {P.late_binding_similarity} AND needs_training AND old_parent IS NULL)
SELECT node_id, parent_node_id, round(sim, 6) AS sim FROM ranked WHERE rn = 1""", TITAN_SIMS))
def late_binding(spark, sf):
    return parents.late_binding(nodes(spark, sf), P).withColumn("sim", r6("sim"))


@query("re_evaluate", sql(f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY sim DESC, parent_node_id) AS rn
  FROM tsims WHERE sim >= {P.re_evaluation_similarity} AND (child_status IS NULL OR child_status <> 'TRAINING')
    AND NOT (key % 4 = 1) AND old_parent IS NOT NULL)
SELECT node_id, parent_node_id, round(sim, 6) AS sim FROM ranked WHERE rn = 1""", TITAN_SIMS))
def re_evaluate(spark, sf):
    """All children are queued; nodes with key % 4 = 1 sit in quarantine."""
    n = nodes(spark, sf).withColumns({
        "forced_root": F.lit(False), "quarantine_count": F.when(F.col("key") % 4 == 1, 1).otherwise(0),
        "last_quarantine_exit": F.lit(None).cast("timestamp_ntz")})
    n = Q.with_status(n, as_of(), P)
    return parents.re_evaluate(n.where("parent_node_id is not null"), n, P).withColumn("sim", r6("sim"))


@query("progressive_adoption", f"""WITH RECURSIVE {NODES}, roots AS (
  SELECT *, row_number() OVER (ORDER BY tier, CASE WHEN tier = 1 THEN mass ELSE -mass END, node_id) AS i
  FROM (SELECT *, CASE WHEN mass >= {P.titan_min_mass} AND (variance IS NULL OR variance <= {P.titan_max_variance}) THEN 1 ELSE 2 END AS tier FROM nodes)
  WHERE parent_node_id IS NULL AND needs_training), near AS (
  SELECT a.i AS i, b.i AS other, round(list_cosine_similarity(a.centroid, b.centroid), 9) AS sim
  FROM roots a JOIN roots b ON b.i < a.i
  WHERE round(list_cosine_similarity(a.centroid, b.centroid), 9) >= {P.adoption_similarity}), adj AS (
  SELECT i, node_id, is_trained AND (training_status IS NULL OR training_status <> 'FAILED') AS adopts,
         coalesce((SELECT list(other) FROM near WHERE near.i = roots.i), []) AS nb FROM roots), walk(i, leaders) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT adj.i, CASE WHEN NOT adopts OR list_has_any(walk.leaders, adj.nb) THEN walk.leaders
                     ELSE list_append(walk.leaders, adj.i) END
  FROM walk JOIN adj ON adj.i = walk.i + 1), fin AS (
  SELECT unnest(leaders) AS leader FROM walk WHERE i = (SELECT max(i) FROM adj)), ranked AS (
  SELECT i, other, sim, row_number() OVER (PARTITION BY i ORDER BY other) AS rn FROM near
  WHERE other IN (SELECT leader FROM fin))
SELECT c.node_id, p.node_id AS parent_node_id, round(sim, 6) AS sim
FROM ranked JOIN roots c ON c.i = ranked.i JOIN roots p ON p.i = ranked.other WHERE rn = 1""")
def progressive_adoption(spark, sf):
    """Along the training order of the pending nodes."""
    from nodeflow.operators.training import training_ranks
    return parents.progressive_adoption(training_ranks(nodes(spark, sf), P), P).withColumn("sim", r6("sim"))


BUFFERS = NODES + """, bcomp AS (
  SELECT buffer_id, pos, avg(v) AS c FROM (
    SELECT 'buf_' || lpad(CAST(vec_id // 4 AS VARCHAR), 12, '0') AS buffer_id, unnest(CAST(embedding AS DOUBLE[])) AS v,
           generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY buffer_id, pos), bufs AS (
  SELECT buffer_id, list(c ORDER BY pos) AS centroid FROM bcomp GROUP BY buffer_id)"""


@query("orphan_buffers", sql(f""", bs AS (
  SELECT buffer_id, node_id, round(list_cosine_similarity(b.centroid, n.centroid), 9) AS sim FROM bufs b CROSS JOIN nodes n), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY buffer_id ORDER BY sim DESC, node_id) AS rn FROM bs WHERE sim >= {P.s_min})
SELECT buffer_id, node_id, round(sim, 6) AS sim FROM ranked WHERE rn = 1""", BUFFERS))
def orphan_buffers(spark, sf):
    name = F.concat(F.lit("buf_"), F.lpad(F.floor(F.col("row_id") / 4).cast("string"), 12, "0"))
    b = buffers.buffer_centroids(members(spark, sf).select(name.alias("buffer_id"), "embedding"), P)
    return routing.orphan_buffers(b, nodes(spark, sf), P).withColumn("sim", r6("sim"))


@query("micro_consolidate")
def micro_consolidate(spark, sf):
    """Checked by its properties in the tests: rounds move centroids, so no order-free SQL gives the result."""
    out, _ = fusion.micro_consolidate(nodes(spark, sf), P)
    return out.select("node_id", "mass", r6("variance").alias("variance"),
                      r6(V.norm(F.col("centroid"))).alias("centroid_norm"))
