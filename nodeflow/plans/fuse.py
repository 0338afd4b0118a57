"""Fusion from candidates to the rewritten state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeflow.operators import buffers as B
from nodeflow.operators import fusion, nodestats, routing
from nodeflow.operators.provenance import pointer_insert
from nodeflow.operators.training import training_metadata
from nodeflow.params import Params
from nodeflow.plans.ingest import State
from nodeflow.session import cut


def fuse(state: State, params: Params) -> tuple[State, DataFrame]:
    """Merge redundant nodes, mark mature ones, fold micro nodes, take over leftover buffers.

    Returns the state (with ``metadata`` for training) and one row of counts. Every dependent
    table is rewritten through the merge map.
    """
    nodes = state["nodes"].drop("last_training_mass")
    matching = fusion.fusion_matching(nodes, params)
    mapping = cut(fusion.merge_map(matching))
    fused = fusion.apply_merges(nodes, mapping, params)
    mature = ~F.col("is_trained") & (F.col("mass") >= params.training_threshold)
    newly_marked = mature & ~F.col("needs_training")
    fused = cut(fused.withColumn("marked", newly_marked).withColumn("needs_training", F.col("needs_training") | mature))
    folded, fold_map = fusion.micro_consolidate(fused.drop("marked"), params)
    pointers = fusion.reassign_pointers(fusion.reassign_pointers(state["pointers"], mapping), fold_map)

    sizes = cut(B.buffer_centroids(state["buffers"], params))
    taken = cut(routing.orphan_buffers(sizes, folded, params).select("buffer_id", "node_id"))
    moved = state["buffers"].join(taken, "buffer_id")
    stats = nodestats.node_signatures(moved.select("node_id", "embedding"), params)
    touched = folded.join(stats.select("node_id"), "node_id", "left_semi").select("node_id", "mass", "centroid", "variance")
    merged = nodestats.merge_signatures(touched.unionByName(stats), params).select(
        "node_id", F.col("mass").alias("_mass"), F.col("centroid").alias("_centroid"), F.col("variance").alias("_variance"))
    final = folded.join(merged, "node_id", "left").withColumns({
        c: F.coalesce(f"_{c}", c) for c in ("mass", "centroid", "variance")}).drop("_mass", "_centroid", "_variance")
    trained_mass = state["nodes"].select("node_id", "last_training_mass")
    final = cut(final.join(trained_mass, "node_id", "left").withColumn(
        "last_training_mass", F.coalesce("last_training_mass", F.lit(0).cast("bigint"))))
    pointers = cut(pointer_insert(pointers, moved.select("node_id", "source_id"), final))
    left = cut(state["buffers"].join(taken.select("buffer_id"), "buffer_id", "left_anti"))
    metadata = cut(training_metadata(final, pointers))

    figures = {
        "initial_nodes": (nodes, F.count("*")),
        "fusions": (mapping, F.count("*") / 2),
        "marked_for_training": (fused, F.count_if("marked")),
        "micro_consolidated": (fold_map, F.count("*") - F.count_distinct("new_id")),
        "buffers_reassigned": (taken, F.count("*")),
        "metadata_updated": (metadata, F.count("*")),
        "final_nodes": (final, F.count("*")),
    }
    rows = [df.agg(figure.cast("bigint").alias(name)) for name, (df, figure) in figures.items()]
    report = rows[0]
    for row in rows[1:]:
        report = report.unionByName(row, allowMissingColumns=True)
    report = report.agg(*[F.max(name).alias(name) for name in figures])
    return {**({"refused": state["refused"]} if "refused" in state else {}), "nodes": final, "buffers": left, "pointers": pointers, "metadata": metadata}, report
