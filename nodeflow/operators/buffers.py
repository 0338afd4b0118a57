"""Buffers: where unmatched vectors gather until there are enough for a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeflow.functions import vectors as V
from nodeflow.operators.leaders import elect_leaders, follow_leaders
from nodeflow.operators.nodestats import node_signatures
from nodeflow.operators.similarity import Spec, match
from nodeflow.params import Params
from nodeflow.session import cut


def buffer_centroids(members: DataFrame, params: Params) -> DataFrame:
    """members(buffer_id, embedding) -> (buffer_id, size, centroid)."""
    return members.where(F.size("embedding") == params.dim).groupBy("buffer_id").agg(
        F.count("*").alias("size"), V.mean_vector(F.col("embedding")).alias("centroid"))


def leader_cluster(rows: DataFrame, params: Params) -> DataFrame:
    """rows(row_id, rank, embedding) in arrival order -> (row_id, buffer_row, sim).

    A row opens a buffer when no earlier opened buffer is within s_min; otherwise it joins
    the most similar of them. A buffer is named by the row that opened it.
    """
    r = cut(rows.where(F.size("embedding") == params.dim).select(
        F.col("row_id").alias("id"), "rank", F.col("embedding").alias("vec")))
    leaders = elect_leaders(r, params.s_min, params)
    joined = follow_leaders(r, leaders, params.s_min, params, first=False)
    followers = joined.join(leaders.select("id"), "id", "left_anti")
    return followers.select(F.col("id").alias("row_id"), F.col("leader").alias("buffer_row"), "sim").unionByName(
        leaders.select(F.col("id").alias("row_id"), F.col("id").alias("buffer_row"), F.lit(1.0).alias("sim")))


def fill_buffers(rows: DataFrame, buffers: DataFrame, params: Params) -> DataFrame:
    """Place rows(row_id, rank, embedding) in existing buffers(buffer_id, size, centroid) or new ones.

    Existing buffers come before every row. Returns (row_id, buffer_id, sim).
    """
    right = buffers.where("size > 0").select(F.col("buffer_id").alias("rid"), F.col("centroid").alias("rvec"))
    left = rows.select(F.col("row_id").alias("lid"), F.col("embedding").alias("lvec"))
    placed = cut(match(left, right, Spec(floor=params.s_min, k=1), params).select(
        F.col("lid").alias("row_id"), F.col("rid").alias("buffer_id"), "sim"))
    fresh = leader_cluster(rows.join(placed, "row_id", "left_anti"), params)
    name = F.concat(F.lit("buf_"), F.sha2(F.col("buffer_row").cast("string"), 256))
    return placed.unionByName(fresh.select("row_id", name.alias("buffer_id"), "sim"))


def promote(members: DataFrame, full: DataFrame, params: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members(buffer_id, source_id, embedding), full(buffer_id) -> (new nodes, their pointers, members that stay).

    A promoted buffer lends its name to the node, so a repeated batch gives the same ids.
    """
    name = F.concat(F.lit("kn_"), F.substring_index("buffer_id", "_", -1)).alias("node_id")
    ready = members.join(full, "buffer_id", "left_semi").select(name, "source_id", "embedding")
    return (node_signatures(ready, params), ready.select("node_id", "source_id").distinct(),
            members.join(full, "buffer_id", "left_anti"))
