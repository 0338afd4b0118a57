"""Feedback, training plan, quarantine and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodeflow.functions import rules as R
from nodeflow.functions.texts import WHITE
from nodeflow.operators import feedback, lineage, quarantine, training
from nodeflow.queries.base import (
    AS_OF, P, PARTS, POINTERS, as_of, node_name, parts, pointers, query, r6, sql, table,
)

WHITE_SQL = "'" + WHITE + "'"
EPOCHS = """CAST(CASE WHEN mass <= 0 THEN 2 WHEN mass > 200 THEN greatest(1, floor(e * 0.7)) ELSE e END AS INTEGER)"""


def epochs_sql(source: str) -> str:
    """source(node_id, mass, variance, n_texts or null, parent_similarity) -> + e."""
    return f"""work AS (
  SELECT *, ln(1 + mass) * (1 + coalesce(variance, 0))
    * CASE WHEN coalesce(variance, 0) = 0 THEN 0.8 WHEN variance > 1.5 THEN 1.2 ELSE 1 END
    * CASE WHEN mass < 5 THEN 1.3 ELSE 1 END
    * CASE WHEN n_texts < 20 THEN 1.2 WHEN n_texts > 100 THEN 0.8 ELSE 1 END
    * CASE WHEN parent_similarity > 0 THEN greatest(0.5, least(1.0, 1 - parent_similarity * 0.5)) ELSE 1 END AS w
  FROM {source}), ep AS (SELECT *, floor(greatest(1, least(7, w * 0.5))) AS e FROM work)"""


def confidences(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", "user_id", node_name(F.col("user_id")).alias("node_id"),
                    ((F.col("event_id") * 37 % 100) / 100.0).alias("confidence"))


CONF = f"""conf AS (
  SELECT event_id, ts, user_id, 'kn_' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS node_id,
         (event_id * 37 % 100) / 100.0 AS confidence FROM events), fb AS (
  SELECT *, CASE WHEN confidence < {P.feedback_low} THEN 'NEW_BUFFER' ELSE 'OK' END AS status,
         CASE WHEN confidence < {P.feedback_low} THEN 0 WHEN confidence >= {P.feedback_high} THEN 1 ELSE 0.5 END AS delta_mass,
         CASE WHEN confidence < {P.feedback_low} THEN 0 WHEN confidence >= {P.feedback_high} THEN -{P.feedback_eta} * confidence
              ELSE {P.feedback_eta} * (1 - confidence) END AS delta_variance FROM conf)"""


@query("feedback_delta", sql("""
SELECT event_id, status, CAST(delta_mass AS DOUBLE) AS delta_mass, round(CAST(delta_variance AS DOUBLE), 6) AS delta_variance
FROM fb""", CONF))
def feedback_delta(spark, sf):
    out = feedback.feedback_delta(confidences(spark, sf), P)
    return out.select("event_id", "status", "delta_mass", r6("delta_variance").alias("delta_variance"))


@query("feedback_apply", sql(""", ok AS (
  SELECT *, sum(CAST(delta_variance AS DOUBLE)) OVER (PARTITION BY node_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run
  FROM fb WHERE status = 'OK'), fold AS (
  SELECT node_id, sum(floor(delta_mass)) AS dm, sum(CAST(delta_variance AS DOUBLE)) AS total, min(run) AS low FROM ok GROUP BY node_id)
SELECT p.node_id, CAST(CASE WHEN dm IS NULL THEN mass ELSE greatest(mass + dm, 0) END AS BIGINT) AS mass,
       round(CASE WHEN total IS NULL THEN variance ELSE greatest(coalesce(variance, 0) + total, total - low) END, 6) + 0 AS variance
FROM parts p LEFT JOIN fold f ON p.node_id = f.node_id""", f"{PARTS}, {CONF}"))
def feedback_apply(spark, sf):
    out = feedback.apply_feedback(parts(spark, sf), confidences(spark, sf), P, "ts", "event_id")
    return out.select("node_id", "mass", r6("variance").alias("variance"))


@query("feedback_single", sql(""", one AS (
  SELECT * FROM fb QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT p.node_id, CAST(greatest(trunc(mass + delta_mass), 0) AS BIGINT) AS mass,
       round(greatest(coalesce(variance, 0) + CAST(delta_variance AS DOUBLE), 0), 6) AS variance
FROM parts p JOIN one USING (node_id)""", f"{PARTS}, {CONF}"))
def feedback_single(spark, sf):
    """The newest event of each node, applied by the plain rule."""
    from nodeflow.operators.provenance import latest_by
    one = latest_by(confidences(spark, sf), ["node_id"], [F.col("ts"), F.col("event_id")])
    one = feedback.feedback_delta(one, P).select("node_id", "delta_mass", "delta_variance")
    new = R.apply_feedback(F.col("mass"), F.col("variance"), F.col("delta_mass"), F.col("delta_variance"))
    return parts(spark, sf).join(one, "node_id").select("node_id", new.alias("n")).select(
        "node_id", "n.mass", r6("n.variance").alias("variance"))


@query("training_marks", sql(f"""
SELECT node_id, CASE WHEN NOT is_trained AND mass >= {P.training_threshold} THEN 'FIRST'
       WHEN is_trained AND coalesce(last_training_mass, 0) > 0 AND mass >= coalesce(last_training_mass, 0) * {P.training_delta}
       THEN 'RETRAIN' END AS mark,
       needs_training OR (NOT is_trained AND mass >= {P.training_threshold})
       OR (is_trained AND coalesce(last_training_mass, 0) > 0 AND mass >= coalesce(last_training_mass, 0) * {P.training_delta}) AS needs_training
FROM parts""", PARTS))
def training_marks(spark, sf):
    return training.training_marks(parts(spark, sf), P).select("node_id", "mark", "needs_training")


@query("training_epochs", sql(f"SELECT node_id, {EPOCHS} AS epochs FROM ep",
                              f"{PARTS}, src AS (SELECT *, key % 150 AS n_texts FROM parts), {epochs_sql('src')}"))
def training_epochs(spark, sf):
    return parts(spark, sf).select("node_id", R.training_epochs(
        F.col("mass"), F.col("variance"), F.col("key") % 150, F.col("parent_similarity")).alias("epochs"))


@query("training_priority", sql("SELECT node_id, round(mass / (1 + coalesce(variance, 0)), 6) AS priority FROM parts", PARTS))
def training_priority(spark, sf):
    return parts(spark, sf).select("node_id", r6(R.training_priority(F.col("mass"), F.col("variance"))).alias("priority"))


WAITING = f"""{PARTS}, {POINTERS}, src0 AS (
  SELECT p.node_id, p.mass, p.variance, p.parent_similarity, count(source_id) AS n
  FROM parts p LEFT JOIN pointers USING (node_id)
  WHERE needs_training AND mass > 0 AND variance IS NOT NULL GROUP BY ALL)"""


@query("training_text_counts", sql("""
SELECT node_id, mass, variance, CAST(n AS BIGINT) AS n_texts FROM src0""", WAITING))
def training_text_counts(spark, sf):
    return training.training_text_counts(parts(spark, sf), pointers(spark, sf)).select("node_id", "mass", "variance", "n_texts")


META = f"{WAITING}, src AS (SELECT *, CASE WHEN n > 0 THEN n END AS n_texts FROM src0), {epochs_sql('src')}"


@query("training_metadata", sql(f"""
SELECT node_id, CAST(n AS BIGINT) AS n_texts, {EPOCHS} AS estimated_epochs,
       round(mass / (1 + variance), 6) AS training_priority FROM ep""", META))
def training_metadata(spark, sf):
    out = training.training_metadata(parts(spark, sf), pointers(spark, sf))
    return out.withColumn("training_priority", r6("training_priority"))


@query("training_metadata_totals", sql(f"""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(x) AS BIGINT) AS updated, round(coalesce(avg(x), 0), 6) AS avg_epochs,
       coalesce(min(x), 0) AS min_epochs, coalesce(max(x), 0) AS max_epochs FROM (SELECT {EPOCHS} AS x FROM ep)""", META))
def training_metadata_totals(spark, sf):
    out = training.training_metadata_totals(training.training_metadata(parts(spark, sf), pointers(spark, sf)))
    return out.withColumn("avg_epochs", r6("avg_epochs"))


@query("pending_queue", sql("SELECT node_id, mass FROM parts WHERE needs_training ORDER BY mass DESC, node_id", PARTS))
def pending_queue(spark, sf):
    return training.pending_queue(parts(spark, sf)).select("node_id", "mass")


@query("training_order", sql(f""", tiers AS (
  SELECT p.node_id, p.mass, CASE WHEN p.parent_node_id IS NOT NULL THEN CASE WHEN q.node_id IS NOT NULL THEN 3 ELSE 4 END
         WHEN p.mass >= {P.titan_min_mass} AND (p.variance IS NULL OR p.variance <= {P.titan_max_variance}) THEN 1 ELSE 2 END AS tier
  FROM parts p LEFT JOIN parts q ON q.node_id = p.parent_node_id AND q.is_trained WHERE p.needs_training)
SELECT node_id, tier, CASE WHEN tier = 1 THEN mass ELSE -mass END AS tier_key FROM tiers""", PARTS))
def training_order(spark, sf):
    return training.training_order(parts(spark, sf), P).select("node_id", "tier", "tier_key")


@query("batch_plan", f"""
SELECT 'kn_' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS node_id, CAST(least(count(*) * 5, {P.max_training_texts}) AS BIGINT) AS n_used,
       CAST(greatest(1, ceil(least(count(*) * 5, {P.max_training_texts}) / {P.training_batch_size})) AS INTEGER) AS n_batches
FROM orders GROUP BY o_custkey""")
def batch_plan(spark, sf):
    """Every order of a customer stands for five texts of the customer's node."""
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg((F.count("*") * 5).alias("n_texts"))
    return training.batch_plan(counts.select(node_name(F.col("o_custkey")).alias("node_id"), "n_texts"), P)


@query("training_texts", f"""
WITH last AS (
  SELECT source, doc_id, text FROM documents
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR) DESC) <= {P.max_training_texts}), ok AS (
  SELECT *, count(*) OVER (PARTITION BY source) AS n FROM last WHERE trim(text, {WHITE_SQL}) <> '')
SELECT source AS node_id, doc_id, CAST(n AS BIGINT) AS n_valid FROM ok WHERE n >= {P.min_training_texts}""")
def training_texts(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("node_id"), F.col("doc_id").cast("string").alias("source_id"),
        F.col("n_chars").alias("created"), "text", "doc_id")
    return training.training_texts(docs, P).select("node_id", "doc_id", "n_valid")


READY = f"""{PARTS}, ready AS (
  SELECT c.node_id, c.key, coalesce(q.is_trained AND q.has_weights AND c.parent_node_id <> c.node_id, false) AS inherits,
         c.parent_node_id, c.parent_similarity
  FROM parts c LEFT JOIN parts q ON q.node_id = c.parent_node_id)"""


@query("inheritance_ready", sql("""
SELECT node_id, inherits, CASE WHEN inherits THEN parent_node_id END AS effective_parent,
       CASE WHEN inherits THEN parent_similarity END AS effective_similarity FROM ready""", READY))
def inheritance_ready(spark, sf):
    return lineage.inheritance_ready(parts(spark, sf))


@query("training_params", sql(f"""
SELECT node_id,
       round(CASE WHEN inherits AND parent_similarity > 0 THEN {P.inheritance_l2_base} * (1 + parent_similarity)
             * CASE WHEN parent_similarity < {P.strict_similarity} THEN {P.inheritance_l2_boost} ELSE 1 END ELSE 0 END, 9) AS l2_lambda,
       round({P.learning_rate_base} * sqrt((key % 8 + 1) * 4.0 / {P.lr_reference_batch})
             * CASE WHEN inherits THEN {P.inheritance_lr_multiplier} ELSE 1 END, 9) AS learning_rate,
       coalesce(inherits AND parent_similarity < {P.strict_similarity}, false) AS strict_abort
FROM ready""", READY))
def training_params(spark, sf):
    p = parts(spark, sf)
    ready = lineage.inheritance_ready(p).join(p.select("node_id", ((F.col("key") % 8 + 1) * 4).alias("batch_size")), "node_id")
    out = training.training_params(ready, P)
    return out.withColumns({c: F.round(c, 9) for c in ("l2_lambda", "learning_rate")})


@query("loss_abort", f"""
SELECT 'kn_' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS node_id,
       coalesce(min(CASE WHEN l_quantity > CASE WHEN l_orderkey % 2 = 0 AND l_linenumber = 1 THEN 10 + l_orderkey % 10
                ELSE (10 + l_orderkey % 10) * {P.life_insurance} END THEN l_linenumber - 1 END), -1) AS abort_step,
       CAST(count(*) AS BIGINT) AS n_steps
FROM lineitem GROUP BY l_orderkey""")
def loss_abort(spark, sf):
    """Quantities of an order's lines read as the losses of one training."""
    k = F.col("l_orderkey")
    losses = table(spark, sf, "lineitem").select(
        node_name(k).alias("node_id"), (F.col("l_linenumber") - 1).alias("step"), F.col("l_quantity").alias("loss"),
        (10 + k % 10).alias("baseline"), (k % 2 == 0).alias("strict"))
    return training.loss_abort(losses, P).withColumn("abort_step", F.coalesce("abort_step", F.lit(-1)))


def outcomes(spark, sf):
    kind = (F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "SUCCESS")
            .when(F.col("event_type") == "signup", "FALLBACK"))
    return table(spark, sf, "events").select(node_name(F.col("user_id")).alias("node_id"), kind.alias("outcome"),
                                             F.col("ts").alias("at")).where("outcome is not null")


@query("training_outcomes", sql(""", o AS (
  SELECT 'kn_' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS node_id, ts,
         CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCESS' ELSE 'FALLBACK' END AS outcome
  FROM events WHERE event_type IN ('error', 'purchase', 'signup')), f AS (
  SELECT node_id, last(outcome ORDER BY ts, outcome) AS outcome, count(*) FILTER (outcome <> 'SUCCESS') AS failures,
         max(ts) FILTER (outcome <> 'SUCCESS') AS failed_at FROM o GROUP BY node_id)
SELECT p.node_id, CASE WHEN outcome = 'SUCCESS' THEN 'COMPLETED' WHEN outcome IS NOT NULL THEN 'FAILED' ELSE training_status END AS training_status,
       CASE WHEN outcome = 'SUCCESS' THEN true WHEN outcome IS NOT NULL THEN false ELSE is_trained END AS is_trained,
       CASE WHEN outcome IS NOT NULL THEN false ELSE needs_training END AS needs_training,
       coalesce(CASE WHEN outcome = 'SUCCESS' THEN mass ELSE last_training_mass END, -1) AS last_training_mass,
       CASE WHEN outcome = 'FALLBACK' THEN 'FALLBACK' ELSE inheritance_type END AS inheritance_type,
       total_failures + coalesce(failures, 0) AS total_failures, failed_at AS last_failure_time
FROM parts p LEFT JOIN f USING (node_id)""", PARTS))
def training_outcomes(spark, sf):
    out = training.training_outcomes(parts(spark, sf), outcomes(spark, sf))
    return out.withColumn("last_training_mass", F.coalesce("last_training_mass", F.lit(-1)))


@query("stale_cleanup", sql("""
SELECT node_id, coalesce(training_status = 'TRAINING', false) AS stale,
       CASE WHEN training_status = 'TRAINING' THEN CASE WHEN is_trained THEN 'COMPLETED' END ELSE training_status END AS training_status,
       CASE WHEN training_status = 'TRAINING' AND is_trained THEN false ELSE needs_training END AS needs_training
FROM parts""", PARTS))
def stale_cleanup(spark, sf):
    return training.stale_cleanup(parts(spark, sf)).select("node_id", "stale", "training_status", "needs_training")


QUARANTINE = f"""CASE WHEN forced_root THEN 'FORCED_ROOT' WHEN quarantine_count <= 0 THEN 'NO_QUARANTINE'
  WHEN last_quarantine_exit IS NULL THEN 'IN_QUARANTINE'
  WHEN epoch(TIMESTAMP '{AS_OF}' - last_quarantine_exit) / 3600 < CASE WHEN quarantine_count = 1 THEN 48 ELSE 168 END THEN 'IN_QUARANTINE'
  ELSE 'QUARANTINE_EXPIRED' END"""


@query("quarantine_status", sql(f"SELECT node_id, {QUARANTINE} AS quarantine_status FROM parts", PARTS))
def quarantine_status(spark, sf):
    return quarantine.with_status(parts(spark, sf), as_of(), P).select("node_id", "quarantine_status")


@query("quarantine_exit", sql(f"""
SELECT node_id, CASE WHEN {QUARANTINE} = 'QUARANTINE_EXPIRED' THEN TIMESTAMP '{AS_OF}' ELSE last_quarantine_exit END AS last_quarantine_exit
FROM parts""", PARTS))
def quarantine_exit(spark, sf):
    p = quarantine.with_status(parts(spark, sf), as_of(), P)
    return quarantine.leave_quarantine(p, as_of()).select("node_id", "last_quarantine_exit")


FAILURE_TYPES = ("PARENT_FAILED", "LIFE_INSURANCE", "TRAINING_ERROR", "SYSTEM_ERROR")


@query("quarantine_should_inc", sql(f"""
SELECT event_id, coalesce(epoch(ts - last_quarantine_exit) / 3600 < 48, false) AND event_id % 4 < 2
       AND (value / 100 NOT BETWEEN 0 AND 1 OR value / 100 < 0.5) AS should_increment
FROM events JOIN parts ON key = user_id WHERE event_type = 'error'""", PARTS))
def quarantine_should_inc(spark, sf):
    kinds = F.array(*[F.lit(t) for t in FAILURE_TYPES])
    failures = table(spark, sf, "events").where("event_type = 'error'").select(
        "event_id", node_name(F.col("user_id")).alias("node_id"), F.col("ts").alias("at"),
        (F.col("value") / 100).alias("progress"), F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("failure_type"))
    exits = parts(spark, sf).select("node_id", "last_quarantine_exit")
    return quarantine.should_increment(failures.join(exits, "node_id"), P).select("event_id", "should_increment")


@query("quarantine_counts", sql("""
, f AS (
  SELECT 'kn_' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS node_id, count(*) AS n, max(ts) AS last_at
  FROM events WHERE event_type = 'error' GROUP BY user_id), c AS (
  SELECT p.*, n, last_at, CASE WHEN n IS NULL THEN greatest(quarantine_count, 0) ELSE least(greatest(quarantine_count, 0) + n, 10) END AS qc
  FROM parts p LEFT JOIN f USING (node_id))
SELECT node_id, CAST(qc AS INTEGER) AS quarantine_count, CASE WHEN n IS NULL THEN forced_root ELSE qc >= 3 END AS forced_root,
       CASE WHEN n IS NOT NULL AND qc >= 3 THEN 'Reached quarantine limit (' || qc || ')' END AS forced_root_reason,
       total_failures + coalesce(n, 0) AS total_failures, CASE WHEN n IS NULL THEN last_quarantine_exit END AS last_quarantine_exit,
       last_at AS last_failure_time FROM c""", PARTS))
def quarantine_counts(spark, sf):
    failures = table(spark, sf, "events").where("event_type = 'error'").select(
        node_name(F.col("user_id")).alias("node_id"), F.col("ts").alias("at"))
    return quarantine.quarantine_counts(parts(spark, sf), failures, P)


@query("sanitize_orphans", sql(""", failed AS (SELECT node_id FROM parts WHERE training_status = 'FAILED')
SELECT node_id, parent_node_id IS NOT NULL AND parent_node_id IN (SELECT node_id FROM failed) AS sanitized,
       CASE WHEN parent_node_id NOT IN (SELECT node_id FROM failed) THEN parent_node_id END AS parent_node_id,
       CASE WHEN parent_node_id IN (SELECT node_id FROM failed) THEN NULL ELSE parent_similarity END AS parent_similarity,
       CASE WHEN parent_node_id IN (SELECT node_id FROM failed) THEN 'ROOT' ELSE inheritance_type END AS inheritance_type,
       CASE WHEN parent_node_id IN (SELECT node_id FROM failed) THEN parent_node_id END AS old_parent
FROM parts""", PARTS))
def sanitize_orphans(spark, sf):
    return lineage.sanitize_orphans(parts(spark, sf)).select(
        "node_id", "sanitized", "parent_node_id", "parent_similarity", "inheritance_type", "old_parent")


@query("sanitize_events", sql("""
SELECT node_id, coalesce(inheritance_type, 'HERITAGE') AS from_type, 'ROOT' AS to_type, 'SANITIZATION' AS reason,
       parent_node_id AS parent_id, CAST(NULL AS DOUBLE) AS similarity
FROM parts WHERE parent_node_id IN (SELECT node_id FROM parts WHERE training_status = 'FAILED')""", PARTS))
def sanitize_events(spark, sf):
    return lineage.sanitize_events(lineage.sanitize_orphans(parts(spark, sf)))


@query("children_of_failed", sql("""
SELECT node_id, parent_node_id FROM parts WHERE parent_node_id IN (SELECT node_id FROM parts WHERE training_status = 'FAILED')""", PARTS))
def children_of_failed(spark, sf):
    return lineage.children_of_failed(parts(spark, sf))


def _updates(p):
    k = F.col("key")
    return p.select("node_id", F.when(k % 3 == 0, node_name(F.floor(k / 3))).otherwise(F.col("node_id")).alias("parent"),
                    ((k % 120) / 100.0).alias("similarity"))


UPDATED = f"""{PARTS}, u AS (
  SELECT *, CASE WHEN key % 3 = 0 THEN 'kn_' || lpad(CAST(key // 3 AS VARCHAR), 12, '0') ELSE node_id END AS parent,
         (key % 120) / 100.0 AS similarity FROM parts), v AS (
  SELECT *, similarity BETWEEN 0 AND 1 AND parent <> node_id AS ok FROM u)"""


@query("parent_update", sql("""
SELECT node_id, CASE WHEN ok THEN parent ELSE parent_node_id END AS parent_node_id,
       CASE WHEN ok THEN similarity ELSE parent_similarity END AS parent_similarity,
       CASE WHEN ok THEN 'HERITAGE' ELSE inheritance_type END AS inheritance_type FROM v""", UPDATED))
def parent_update(spark, sf):
    p = parts(spark, sf)
    return lineage.parent_update(p, _updates(p))[0].select("node_id", "parent_node_id", "parent_similarity", "inheritance_type")


@query("parent_update_events", sql("""
SELECT node_id, inheritance_type AS from_type, 'HERITAGE' AS to_type,
       CASE WHEN parent_node_id IS NULL THEN 'PROGRESSIVE_ADOPTION' ELSE 'PARENT_CHANGE' END AS reason,
       parent AS parent_id, similarity FROM v WHERE ok""", UPDATED))
def parent_update_events(spark, sf):
    p = parts(spark, sf)
    return lineage.parent_update(p, _updates(p))[1]


def lineage_events(spark, sf):
    e = table(spark, sf, "events")
    old = F.get(F.array(*[F.lit(t) for t in ("ROOT", "HERITAGE", "OTHER")]), (F.col("event_id") % 3).cast("int"))
    return e.select(node_name(F.col("user_id")).alias("node_id"), "event_id", F.col("ts").alias("event_time"),
                    old.alias("from_type"), F.lit("HERITAGE").alias("to_type"),
                    F.when(F.col("event_type") != "view", F.upper("event_type")).alias("reason"),
                    node_name(F.col("event_id") % 7).alias("parent_id"), (F.col("value") / 300).alias("similarity"),
                    F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct("event_id"))).when(F.col("event_id") % 4 == 1, "{").alias("metadata"))


LINEAGE = """ev AS (
  SELECT 'kn_' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS node_id, event_id, ts,
         CASE WHEN event_id % 3 = 1 THEN 'HERITAGE' ELSE 'ROOT' END AS from_type,
         CASE WHEN event_type = 'view' THEN 'UNKNOWN' ELSE upper(event_type) END AS reason,
         'kn_' || lpad(CAST(event_id % 7 AS VARCHAR), 12, '0') AS parent_id,
         CASE WHEN value / 300 BETWEEN 0 AND 1 THEN value / 300 END AS similarity FROM events)"""


@query("lineage_history", sql("""
SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY ts, event_id) AS entry_no,
       count(*) OVER (PARTITION BY node_id) AS change_count, ts AS event_time,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS entry_timestamp, from_type AS entry_from, 'HERITAGE' AS entry_to, reason AS entry_reason,
       parent_id AS entry_parent_id, round(similarity, 6) AS entry_similarity,
       CASE WHEN event_id % 4 = 0 THEN '{"event_id":' || event_id || '}' ELSE '{}' END AS entry_metadata,
       round(similarity, 6) AS similarity FROM ev""", LINEAGE))
def lineage_history(spark, sf):
    """The fields are read back from the JSON entries."""
    names = ("timestamp", "from", "to", "reason", "parent_id", "similarity", "metadata")
    out = lineage.lineage_history(lineage_events(spark, sf)).withColumn("similarity", r6("similarity"))
    fields = {f"entry_{n}": F.get_json_object("entry", f"$.{n}") for n in names}
    return out.withColumns(fields).withColumn("entry_similarity", r6(F.col("entry_similarity").cast("double"))).drop("entry")


@query("lineage_summary", sql("""
SELECT node_id, CAST(count(*) AS BIGINT) AS change_count, last(from_type ORDER BY ts, event_id) AS from_type, 'HERITAGE' AS to_type,
       last(reason ORDER BY ts, event_id) AS reason, last(parent_id ORDER BY ts, event_id) AS parent_id,
       round(last(similarity ORDER BY ts, event_id), 6) AS similarity FROM ev GROUP BY node_id""", LINEAGE))
def lineage_summary(spark, sf):
    return lineage.lineage_summary(lineage_events(spark, sf)).withColumn("similarity", r6("similarity"))


@query("artifact_audit", f"""
SELECT page_id, concat_ws(',', CASE WHEN page_id % 4 > 1 THEN 'FORMAT' END, CASE WHEN page_id % 7 = 0 THEN 'EMPTY' END,
         CASE WHEN page_id % 5 = 0 THEN 'CHECKSUM' END) AS problems,
       CASE WHEN page_id % 7 = 0 THEN 0 ELSE strlen(html) END AS n_bytes
FROM pages""")
def artifact_audit(spark, sf):
    """Pages as stored artifacts: some with a wrong format or none, empty, or with a wrong checksum."""
    k = F.col("page_id")
    data = F.when(k % 7 == 0, F.lit("")).otherwise(F.col("html")).cast("binary")
    fmt = F.get(F.array(F.lit("safetensors"), F.lit("bin"), F.lit("onnx"), F.lit(None).cast("string")), (k % 4).cast("int"))
    rows = table(spark, sf, "pages").select("page_id", data.alias("data"), fmt.alias("fmt"))
    rows = rows.withColumn("checksum", F.when(k % 5 == 0, F.lit("0" * 64)).otherwise(F.sha2("data", 256)))
    problems = R.artifact_problems(F.col("fmt"), F.col("data"), F.col("checksum"), P)
    return rows.select("page_id", F.array_join(problems, ",").alias("problems"),
                       F.octet_length("data").cast("bigint").alias("n_bytes"))
