"""The deferred training: the plan before it and what its outcomes do; training itself is the user's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeflow.functions import rules as R
from nodeflow.operators import lineage, parents, quarantine, training
from nodeflow.params import Params
from nodeflow.session import cut


def training_plan(nodes: DataFrame, pointers: DataFrame, as_of: Column, params: Params) -> DataFrame:
    """(node_id, tier, tier_key, gate, epochs, priority, n_texts, n_batches, parent, similarity, lambda, rate).

    Stale states are cleared, children of failed parents freed and late parents bound first.
    gate: TRAIN, IN_QUARANTINE or NO_TEXTS. Rows are in training order.
    """
    clean = lineage.sanitize_orphans(training.stale_cleanup(nodes).drop("stale")).drop("sanitized", "old_parent", "old_type")
    clean = cut(clean)
    late = parents.late_binding(clean, params).select(
        "node_id", F.col("parent_node_id").alias("parent"), F.col("sim").alias("similarity"))
    bound = cut(quarantine.with_status(lineage.parent_update(clean, late)[0], as_of, params))
    order = training.training_order(bound, params).select("node_id", "tier", "tier_key")
    counts = pointers.groupBy("node_id").agg(F.count("source_id").alias("n_texts"))
    ready = lineage.inheritance_ready(bound).join(
        bound.select("node_id", F.lit(params.training_batch_size).alias("batch_size")), "node_id")
    setup = training.training_params(ready, params)
    plan = (
        bound.where("needs_training").join(order, "node_id").join(counts, "node_id", "left")
        .join(ready.select("node_id", "effective_parent", "effective_similarity"), "node_id").join(setup, "node_id")
        .withColumn("n_texts", F.coalesce("n_texts", F.lit(0)))
    )
    gate = (F.when(F.col("quarantine_status") == "IN_QUARANTINE", "IN_QUARANTINE")
            .when(F.col("n_texts") == 0, "NO_TEXTS").otherwise("TRAIN"))
    known = F.when(F.col("n_texts") > 0, F.col("n_texts"))
    batches = training.batch_plan(plan, params).select("node_id", "n_batches")
    return plan.join(batches, "node_id").select(
        "node_id", "tier", "tier_key", gate.alias("gate"),
        R.training_epochs(F.col("mass"), F.col("variance"), known, F.col("effective_similarity")).alias("epochs"),
        R.training_priority(F.col("mass"), F.col("variance")).alias("priority"), "n_texts", "n_batches",
        "effective_parent", "effective_similarity", "l2_lambda", "learning_rate", "strict_abort",
    ).orderBy("tier", "tier_key", "node_id")


def _replaced(nodes: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    kept = nodes.drop(*columns)
    return kept.join(fresh.select("node_id", *columns), "node_id")


def deferred_training(nodes: DataFrame, pointers: DataFrame, outcomes: DataFrame, as_of: Column, params: Params) -> dict[str, DataFrame]:
    """One training pass: what to train, and the nodes after the outcomes.

    pointers(node_id, source_id, created, text) carry resolved texts; a node trains with at least
    ``min_training_texts`` that are not blank among its last ones. outcomes(node_id, outcome, at,
    failure_type, progress) are those of this pass, without rows before the first. In this order: stale
    states are cleared, children of failed parents freed, late parents bound; after training the outcomes
    are taken over, trained roots adopt later roots along the training order, failures count for the
    quarantine, children of newly failed parents are freed and look for a titan again.

    Returns ``plan``, ``nodes``, ``queue`` (nodes that were looked at again) and ``events`` (lineage, with
    the ``step`` that made each).
    """
    swept = cut(lineage.sanitize_orphans(training.stale_cleanup(nodes).drop("stale")))
    events = [lineage.sanitize_events(swept).withColumn("step", F.lit("1 sanitize"))]
    clean = swept.drop("sanitized", "old_parent", "old_type")

    def bound(to: DataFrame, pairs: DataFrame, step: str) -> DataFrame:
        updates = pairs.select("node_id", F.col("parent_node_id").alias("parent"), F.least("sim", F.lit(1.0)).alias("similarity"))
        changed, made = lineage.parent_update(to, updates)
        events.append(made.withColumn("step", F.lit(step)))
        return cut(changed)

    ready = bound(clean, parents.late_binding(clean, params), "2 late binding")
    plan = training_plan(ready, pointers.select("node_id", "source_id"), as_of, params)
    enough = training.training_texts(pointers, params).select("node_id").distinct().withColumn("_enough", F.lit(True))
    plan = plan.join(enough, "node_id", "left").withColumn(
        "gate", F.when((F.col("gate") == "TRAIN") & F.col("_enough").isNull(), "NO_TEXTS").otherwise(F.col("gate"))).drop("_enough")

    after = training.training_outcomes(ready, outcomes)
    done = cut(_replaced(ready, after, [c for c in after.columns if c != "node_id"]))
    state = done.select("node_id", "is_trained", "training_status")
    order = training.training_ranks(ready, params).drop("is_trained", "training_status").join(state, "node_id")
    done = bound(done, parents.progressive_adoption(order, params), "3 adoption")

    failures = outcomes.where("outcome <> 'SUCCESS'").join(done.select("node_id", "last_quarantine_exit"), "node_id")
    counted = quarantine.should_increment(failures, params).where("should_increment")
    fresh = quarantine.quarantine_counts(done, counted, params)
    held = cut(_replaced(done, fresh, ["quarantine_count", "forced_root", "forced_root_reason", "last_quarantine_exit"]))
    events.append(lineage.forced_root_events(done, held).withColumn("step", F.lit("4 quarantine")))

    queue = cut(lineage.children_of_failed(held).select("node_id"))
    swept = cut(lineage.sanitize_orphans(held))
    events.append(lineage.sanitize_events(swept).withColumn("step", F.lit("5 sanitize")))
    freed = quarantine.with_status(swept.drop("sanitized", "old_parent", "old_type"), as_of, params)
    final = bound(freed, parents.re_evaluate(queue, freed, params), "6 re-evaluation")
    every = events[0]
    for more in events[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    return {"plan": plan, "nodes": final, "queue": queue, "events": every}
