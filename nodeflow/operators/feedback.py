"""Confidence feedback on nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeflow.functions import rules as R
from nodeflow.operators.ranking import clamped_sum
from nodeflow.params import Params


def feedback_delta(rows: DataFrame, params: Params) -> DataFrame:
    return rows.withColumn("_f", R.feedback(F.col("confidence"), params)).select("*", "_f.*").drop("_f")


def apply_feedback(nodes: DataFrame, rows: DataFrame, params: Params, order: str, *ties: str) -> DataFrame:
    """Apply rows(node_id, confidence, order) one after the other; NEW_BUFFER rows change nothing.

    Masses are whole numbers and steps are never negative, so cutting each sum to a whole
    number leaves the sum of the whole parts; the clamp of the variance folds per slice.
    """
    moved = feedback_delta(rows, params).where("status = 'OK'")
    mass = moved.groupBy("node_id").agg(F.sum(F.floor("delta_mass")).alias("_dm"))
    var = clamped_sum(moved, ["node_id"], F.col("delta_variance"), order, *ties)
    v0 = F.coalesce("variance", F.lit(0.0))
    changed = F.greatest(v0 + F.col("total"), F.col("total") - F.col("lowest"))
    return nodes.join(mass, "node_id", "left").join(var, "node_id", "left").withColumns({
        "mass": F.when(F.col("_dm").isNull(), F.col("mass")).otherwise(
            F.greatest(F.col("mass") + F.col("_dm"), F.lit(0))).cast("bigint"),
        "variance": F.when(F.col("total").isNull(), F.col("variance")).otherwise(changed),
    }).drop("_dm", "total", "lowest")
