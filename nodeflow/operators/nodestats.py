"""Per-node statistics: centroid, mass and variance, as mergeable aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeflow.functions import vectors as V
from nodeflow.params import Params


def node_stats(members: DataFrame, params: Params, key: str = "node_id") -> DataFrame:
    """members(key, embedding) -> (key, mass, centroid, m2)."""
    v = F.col("embedding")
    stats = members.where(F.size(v) == params.dim).groupBy(key).agg(F.count("*").alias("mass"), V.moments(v).alias("_s"))
    return stats.select(key, "mass", V.mean_of(F.col("_s")).alias("centroid"),
                        (V.variance_of(F.col("_s")) * (F.col("mass") - 1)).alias("m2"))


def node_signature(stats: DataFrame) -> DataFrame:
    """Replace m2 by the unbiased variance (0 up to one member)."""
    return stats.withColumn("variance", V.bessel(F.col("m2"), F.col("mass"))).drop("m2")


def node_signatures(members: DataFrame, params: Params, key: str = "node_id") -> DataFrame:
    return node_signature(node_stats(members, params, key))


def merge_signatures(parts: DataFrame, params: Params, key: str = "node_id") -> DataFrame:
    """parts(key, mass, centroid, variance), any number per key -> one signature per key.

    The spread between the centroids is their variance weighted by mass; partials combine
    before the shuffle.
    """
    n = F.col("mass")
    weight = F.greatest(n.cast("double"), F.lit(1e-12))
    merged = parts.groupBy(key).agg(
        F.sum(n).alias("mass"),
        V.moments(F.col("centroid"), weight).alias("_s"),
        F.sum(F.greatest(n - 1, F.lit(0)) * F.coalesce("variance", F.lit(0.0))).alias("_within"),
        F.sum(weight).alias("_w"), F.sum(weight * weight).alias("_w2"),
    )
    between = V.variance_of(F.col("_s")) * (F.col("_w") - F.col("_w2") / F.col("_w"))
    return merged.select(key, "mass", V.mean_of(F.col("_s")).alias("centroid"),
                         V.bessel(F.col("_within") + between, n).alias("variance"))


def node_update(nodes: DataFrame, accepted: DataFrame, params: Params) -> DataFrame:
    """Merge accepted(node_id, embedding) into nodes(node_id, mass, centroid, variance)."""
    columns = ["node_id", "mass", "centroid", "variance"]
    batch = node_signatures(accepted, params)
    return merge_signatures(nodes.select(*columns).unionByName(batch.select(*columns)), params)


def thematic_coherence(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean cosine of a node's members to its centroid."""
    sized = nodes.select("node_id", "centroid", V.norm(F.col("centroid")).alias("centroid_norm"))
    sim = V.cosine(F.col("embedding"), F.col("centroid"), norm_b=F.col("centroid_norm"))
    return members.join(sized, "node_id").groupBy("node_id").agg(F.avg(sim).alias("coherence"))
