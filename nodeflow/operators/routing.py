"""Send vectors to nodes and buffers: theta joins reduced to the best partner per row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeflow.functions import vectors as V
from nodeflow.operators.similarity import Spec, match
from nodeflow.params import Params

NEW_BUFFER = "NEW_BUFFER"


def dynamic_threshold(mass: Column, params: Params) -> Column:
    return F.lit(params.s_min) - params.threshold_decay / F.greatest(F.log1p(mass), F.lit(params.threshold_min_log))


def _rows(rows: DataFrame, vector: str = "embedding", key: str = "row_id", *extra: str) -> DataFrame:
    return rows.select(F.col(key).alias("lid"), F.col(vector).alias("lvec"), *extra)


def _nodes(nodes: DataFrame, *extra: Column) -> DataFrame:
    return nodes.select(F.col("node_id").alias("rid"), F.col("centroid").alias("rvec"), *extra)


def route_matches(rows: DataFrame, nodes: DataFrame, params: Params) -> DataFrame:
    """Best node per row among those above their own threshold: (row_id, node_id, score, sim, threshold)."""
    threshold = F.round(dynamic_threshold(F.col("mass"), params), 9)
    right = _nodes(nodes, threshold.alias("threshold"),
                   (params.mass_weight * F.log1p(F.col("mass"))).alias("bonus"))
    spec = Spec(
        floor_attr="threshold", k=1, right_attrs=("threshold", "bonus"), carry=("threshold",),
        keep=lambda sim, L, R: sim >= R["threshold"], score=lambda sim, L, R: sim + R["bonus"],
    )
    best = match(_rows(rows), right, spec, params)
    return best.select(F.col("lid").alias("row_id"), F.col("rid").alias("node_id"), "score", "sim", "threshold")


def route(rows: DataFrame, nodes: DataFrame, params: Params, carry: tuple[str, ...] = ()) -> DataFrame:
    """One decision per row; rows without a node go to NEW_BUFFER with score 0. ``carry``: other columns that stay."""
    found = route_matches(rows, nodes, params)
    return rows.select("row_id", *carry).join(found, "row_id", "left").select(
        "row_id",
        *carry,
        F.coalesce(F.col("node_id").cast("string"), F.lit(NEW_BUFFER)).alias("node_id"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "sim",
        "threshold",
    )


def nearest_node(rows: DataFrame, nodes: DataFrame, params: Params, floor: float = -1.0) -> DataFrame:
    """Most similar node per row: (row_id, node_id, sim, mass)."""
    best = match(_rows(rows), _nodes(nodes, F.col("mass")), Spec(floor=floor, k=1, carry=("mass",)), params)
    return best.select(F.col("lid").alias("row_id"), F.col("rid").alias("node_id"), "sim", "mass")


def route_miss_gap(rows: DataFrame, nodes: DataFrame, params: Params) -> DataFrame:
    """For rows no node accepts: the most similar node, the threshold it asks and what is missing."""
    missed = rows.join(route_matches(rows, nodes, params).select("row_id"), "row_id", "left_anti")
    threshold = dynamic_threshold(F.col("mass"), params)
    return nearest_node(missed, nodes, params).select(
        "row_id", "node_id", "sim", threshold.alias("threshold"), (threshold - F.col("sim")).alias("gap"))


def nearest_buffer(rows: DataFrame, buffers: DataFrame, params: Params) -> DataFrame:
    """buffers(buffer_id, size, centroid): best buffer per row with sim >= s_min."""
    right = buffers.where("size > 0 and centroid is not null").select(
        F.col("buffer_id").alias("rid"), F.col("centroid").alias("rvec"))
    best = match(_rows(rows), right, Spec(floor=params.s_min, k=1), params)
    return best.select(F.col("lid").alias("row_id"), F.col("rid").alias("buffer_id"), "sim")


def orphan_buffers(buffers: DataFrame, nodes: DataFrame, params: Params) -> DataFrame:
    """Node that takes over each leftover buffer: (buffer_id, node_id, sim)."""
    rows = buffers.where("centroid is not null").select(F.col("buffer_id").alias("row_id"),
                                                        F.col("centroid").alias("embedding"))
    return nearest_node(rows, nodes, params, floor=params.s_min).select(
        F.col("row_id").alias("buffer_id"), "node_id", "sim")


def local_filter(sim: Column, centroid: Column, params: Params) -> Column:
    """A node takes a vector at or above s_min, or any vector while it has no centroid."""
    return centroid.isNull() | (F.round(sim, 9) >= params.s_min)


def affinity_topk(rows: DataFrame, nodes: DataFrame, k: int, params: Params) -> DataFrame:
    """Top k nodes per row by mass * sim / (variance + 1e-6): (row_id, node_id, affinity, rank)."""
    right = _nodes(nodes, F.greatest(F.col("mass"), F.lit(0)).cast("double").alias("m"),
                   F.coalesce("variance", F.lit(0.0)).alias("v"))
    spec = Spec(k=k, right_attrs=("m", "v"),
                score=lambda sim, L, R: np.where(R["m"] > 0, R["m"] * sim / (R["v"] + 1e-6), 0.0))
    return match(_rows(rows), right, spec, params).select(
        F.col("lid").alias("row_id"), F.col("rid").alias("node_id"), "sim", F.col("score").alias("affinity"))


def topk(rows: DataFrame, nodes: DataFrame, k: int, params: Params) -> DataFrame:
    """k most similar nodes per row."""
    return match(_rows(rows), _nodes(nodes), Spec(k=k), params).select(
        F.col("lid").alias("row_id"), F.col("rid").alias("node_id"), "sim")


def pair_cosine(pairs: DataFrame) -> DataFrame:
    """pairs(row_id, node_id, embedding, centroid) -> cosine of each given pair."""
    return pairs.select("row_id", "node_id", V.cosine(F.col("embedding"), F.col("centroid")).alias("sim"))
