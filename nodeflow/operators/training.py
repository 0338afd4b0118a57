"""The training plan and what outcomes of training do to nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeflow.functions import rules as R
from nodeflow.functions.texts import strip
from nodeflow.operators.parents import is_titan_size
from nodeflow.operators.provenance import recent
from nodeflow.operators.ranking import keyed_rank
from nodeflow.params import Params


def training_marks(nodes: DataFrame, params: Params) -> DataFrame:
    mark = R.training_mark(F.col("mass"), F.col("is_trained"), F.col("last_training_mass"), params)
    return nodes.withColumn("mark", mark).withColumn("needs_training", F.col("needs_training") | mark.isNotNull())


def pending_queue(nodes: DataFrame) -> DataFrame:
    return nodes.where("needs_training").orderBy(F.desc("mass"), "node_id")


def training_text_counts(nodes: DataFrame, pointers: DataFrame) -> DataFrame:
    """Number of pointers of every node that waits for training; 0 when it has none."""
    waiting = nodes.where("needs_training and mass > 0 and variance is not null").select(
        "node_id", "mass", "variance", "parent_similarity")
    counts = pointers.groupBy("node_id").agg(F.count("source_id").alias("n_texts"))
    return waiting.join(counts, "node_id", "left").withColumn("n_texts", F.coalesce("n_texts", F.lit(0)))


def training_metadata(nodes: DataFrame, pointers: DataFrame) -> DataFrame:
    known = F.when(F.col("n_texts") > 0, F.col("n_texts"))
    return training_text_counts(nodes, pointers).select(
        "node_id", "n_texts",
        R.training_epochs(F.col("mass"), F.col("variance"), known, F.col("parent_similarity")).alias("estimated_epochs"),
        R.training_priority(F.col("mass"), F.col("variance")).alias("training_priority"))


def training_metadata_totals(metadata: DataFrame) -> DataFrame:
    n = F.col("estimated_epochs")
    return metadata.agg(
        F.count("*").alias("total"), F.count(n).alias("updated"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_epochs"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_epochs"), F.coalesce(F.max(n), F.lit(0)).alias("max_epochs"))


def training_order(nodes: DataFrame, params: Params) -> DataFrame:
    """Pending nodes with their tier and sort keys, in order.

    1 titans (light first), 2 other roots, 3 children of trained parents, 4 waiting children
    (heavy first). The order is total, so the result can be range-partitioned.
    """
    trained = nodes.where("is_trained").select(F.col("node_id").alias("_key"), F.lit(True).alias("_ready"))
    pending = nodes.where("needs_training").withColumn("_key", R.parent_key()).join(trained, "_key", "left").drop("_key")
    tier = (
        F.when(F.col("parent_node_id").isNotNull(), F.when(F.col("_ready"), 3).otherwise(4))
        .when(is_titan_size(params), 1).otherwise(2)
    )
    key = F.when(F.col("tier") == 1, F.col("mass")).otherwise(-F.col("mass"))
    return pending.withColumn("tier", tier).withColumn("tier_key", key).drop("_ready").orderBy(
        "tier", "tier_key", "node_id")


def batch_plan(nodes_with_texts: DataFrame, params: Params) -> DataFrame:
    """Training batches per node from its number of texts (at most max_training_texts, at least one batch)."""
    used = F.least(F.col("n_texts"), F.lit(params.max_training_texts))
    return nodes_with_texts.select(
        "node_id", used.alias("n_used"),
        F.greatest(F.lit(1), F.ceil(used / params.training_batch_size)).cast("int").alias("n_batches"))


def training_texts(pointers: DataFrame, params: Params, order=None) -> DataFrame:
    """pointers(node_id, source_id, created, text): last texts of a node, blanks out, too few means none."""
    order = order or [F.desc("created"), F.desc("source_id")]
    last = recent(pointers, "node_id", order, params.max_training_texts)
    kept = last.where(F.coalesce(strip(F.col("text")), F.lit("")) != "")
    enough = F.count("*").over(W.partitionBy("node_id"))
    return kept.withColumn("n_valid", enough).where(F.col("n_valid") >= params.min_training_texts)


def training_params(nodes: DataFrame, params: Params) -> DataFrame:
    """nodes(node_id, inherits, effective_similarity, batch_size) -> rate, lambda and the strict abort flag."""
    inherits, sim = F.col("inherits"), F.col("effective_similarity")
    return nodes.select(
        "node_id", R.l2_lambda(inherits, sim, params).alias("l2_lambda"),
        R.learning_rate(inherits, F.col("batch_size"), params).alias("learning_rate"),
        R.strict_abort(inherits, sim, params).alias("strict_abort"))


def loss_abort(losses: DataFrame, params: Params) -> DataFrame:
    """losses(node_id, step, loss, baseline, strict): first step that ends a training, null when none does."""
    first = F.col("strict") & (F.col("step") == 0)
    limit = F.when(first, F.col("baseline")).otherwise(F.col("baseline") * params.life_insurance)
    return losses.groupBy("node_id").agg(
        F.min(F.when(F.col("loss") > limit, F.col("step"))).alias("abort_step"), F.count("*").alias("n_steps"))


def training_outcomes(nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """outcomes(node_id, outcome SUCCESS|FAILED|FALLBACK, at): final state of each node.

    SUCCESS clears the flag and remembers the mass; FAILED and FALLBACK fail the node, FALLBACK
    also its inheritance. Failures add up, the last outcome decides the rest. A node without a new
    failure keeps the time of its last one.
    """
    before = F.col("last_failure_time") if "last_failure_time" in nodes.columns else F.lit(None).cast("timestamp_ntz")
    folded = outcomes.groupBy("node_id").agg(
        F.max_by("outcome", F.struct("at", "outcome")).alias("outcome"),
        F.count_if(F.col("outcome") != "SUCCESS").alias("failures"),
        F.max(F.when(F.col("outcome") != "SUCCESS", F.col("at"))).alias("failed_at"))
    won, lost = F.col("outcome") == "SUCCESS", F.col("outcome") != "SUCCESS"
    return nodes.join(folded, "node_id", "left").select(
        "node_id",
        F.when(won, "COMPLETED").when(lost, "FAILED").otherwise(F.col("training_status")).alias("training_status"),
        F.when(won, True).when(lost, False).otherwise(F.col("is_trained")).alias("is_trained"),
        F.when(F.col("outcome").isNotNull(), False).otherwise(F.col("needs_training")).alias("needs_training"),
        F.when(won, F.col("mass")).otherwise(F.col("last_training_mass")).alias("last_training_mass"),
        F.when(F.col("outcome") == "FALLBACK", "FALLBACK").otherwise(F.col("inheritance_type")).alias("inheritance_type"),
        (F.col("total_failures") + F.coalesce("failures", F.lit(0))).alias("total_failures"),
        F.coalesce("failed_at", before).alias("last_failure_time"))


def stale_cleanup(nodes: DataFrame) -> DataFrame:
    """Nodes left in TRAINING: trained ones are complete, the others open again."""
    stale = F.coalesce(F.col("training_status") == "TRAINING", F.lit(False))
    return nodes.withColumns({
        "stale": stale,
        "needs_training": F.when(stale & F.col("is_trained"), False).otherwise(F.col("needs_training")),
        "training_status": F.when(stale, F.when(F.col("is_trained"), "COMPLETED")).otherwise(F.col("training_status")),
    })


def rank_by_mass(nodes: DataFrame) -> DataFrame:
    """Total training order by mass, heavy first, as a dense rank column."""
    return keyed_rank(nodes.withColumn("_order", -F.col("mass")), [], "_order", "node_id").drop("_order", "n")


def training_ranks(nodes: DataFrame, params: Params) -> DataFrame:
    """Pending nodes with their place in the training order as ``rank`` (from 1)."""
    return keyed_rank(training_order(nodes, params), [], "tier", "tier_key", "node_id").drop("n")
