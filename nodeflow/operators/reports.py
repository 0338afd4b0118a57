"""Summaries over nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeflow.functions.texts import strip


def run_summary(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.count("*").alias("total_nodes"), F.coalesce(F.sum("mass"), F.lit(0)).alias("total_mass"),
        F.coalesce(F.avg("mass"), F.lit(0.0)).alias("avg_mass"),
        F.coalesce(F.avg(F.coalesce("variance", F.lit(0.0))), F.lit(0.0)).alias("avg_variance"),
        F.count_if("is_trained").alias("trained_nodes"), F.count_if(F.col("mass") > 5).alias("candidate_nodes"))


def top_nodes(nodes: DataFrame, n: int = 10) -> DataFrame:
    return nodes.select("node_id", "mass", "variance").orderBy(F.desc("mass"), "node_id").limit(n)


def unlabeled_top(nodes: DataFrame, n: int = 100) -> DataFrame:
    open_label = F.coalesce("label", F.lit("")) == ""
    return nodes.where(open_label & (F.col("is_trained") | (F.col("mass") > 5))).orderBy(
        F.desc("mass"), "node_id").limit(n).select("node_id", "mass")


def node_status_view(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """All single-node look-ups at once: asked(node_id) with the defaults of an unknown node."""
    return asked.select("node_id").distinct().join(nodes, "node_id", "left").select(
        "node_id", F.col("mass").isNotNull().alias("known"), F.coalesce("mass", F.lit(0)).alias("mass"),
        F.coalesce("variance", F.lit(0.0)).alias("variance"), "training_status",
        F.coalesce("is_trained", F.lit(False)).alias("is_trained"),
        F.coalesce("last_training_mass", F.lit(0)).alias("last_training_mass"), "estimated_epochs",
        F.coalesce("has_weights", F.lit(False)).alias("has_weights"))


def consolidation_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """before(domain, node_id), after(domain, node_id, mass, variance) -> consolidation and hub ratio per domain.

    ``variance_change`` is the relative change of the mean variance against the first domain in order; null where
    that one has none.
    """
    old = before.groupBy("domain").agg(F.count("*").alias("initial_nodes"))
    new = after.groupBy("domain").agg(
        F.count("*").alias("final_nodes"), F.max("mass").alias("max_mass"), F.avg("mass").alias("avg_mass"),
        F.avg(F.coalesce("variance", F.lit(0.0))).alias("avg_variance"))
    baseline = new.agg(F.min_by("avg_variance", "domain")).scalar()
    return old.join(new, "domain").select(
        "domain", "initial_nodes", "final_nodes",
        ((F.col("initial_nodes") - F.col("final_nodes")) / F.col("initial_nodes")).alias("consolidation"),
        "max_mass", (F.col("max_mass") / F.col("avg_mass")).alias("hub_ratio"), "avg_variance",
        F.try_divide(F.col("avg_variance") - baseline, baseline).alias("variance_change"))


def dataset_stats(rows: DataFrame) -> DataFrame:
    """rows(dataset, text): rows read and texts that hold something."""
    return rows.groupBy("dataset").agg(
        F.count("*").alias("total_rows"), F.count_if(F.coalesce(strip(F.col("text")), F.lit("")) != "").alias("valid_texts"))
