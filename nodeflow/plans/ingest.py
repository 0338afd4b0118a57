"""One micro-batch of vectors against a frozen snapshot of the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nodeflow.functions import rules as R
from nodeflow.operators import buffers as B
from nodeflow.operators import nodestats, parents, provenance, routing
from nodeflow.operators.ranking import keyed_rank
from nodeflow.params import Params
from nodeflow.session import cut
from nodeflow.sources.vectors import refusal

NODE_SCHEMA = (
    "node_id string, centroid array<double>, mass bigint, variance double, origin_type string, is_trained boolean, "
    "needs_training boolean, training_status string, parent_node_id string, parent_similarity double, "
    "inheritance_type string, last_training_mass bigint"
)
BUFFER_SCHEMA = "buffer_id string, row_id bigint, source_id string, embedding array<double>"
POINTER_SCHEMA = "node_id string, source_id string"

State = dict[str, DataFrame]  # and the observed ``counts``, plain numbers


def empty_state(spark: SparkSession) -> State:
    return {"nodes": spark.createDataFrame([], NODE_SCHEMA), "buffers": spark.createDataFrame([], BUFFER_SCHEMA),
            "pointers": spark.createDataFrame([], POINTER_SCHEMA)}


def decide(rows: DataFrame, nodes: DataFrame, params: Params) -> DataFrame:
    """rows + decision: NODE, REJECTED (routed, but its node's filter or the feedback says no) or MISS."""
    others = tuple(c for c in rows.columns if c != "row_id")
    routed = routing.route(rows.where("row_id IS NOT NULL"), nodes, params, others)
    low = R.feedback(F.col("confidence"), params)["status"] == routing.NEW_BUFFER
    sent = F.col("node_id") != routing.NEW_BUFFER
    kept = (F.round("sim", 9) >= params.s_min) & ~(F.col("confidence").isNotNull() & low)
    verdict = F.when(~sent, "MISS").when(kept, "NODE").otherwise("REJECTED")
    return routed.withColumn("decision", verdict)


def process_batch(state: State, rows: DataFrame, params: Params) -> State:
    """rows(row_id, rank, source_id, embedding, confidence) -> the next state and ``decisions``.

    All rows are routed on the state before the batch; rows that a node keeps are merged into
    it as one partial, the others fill buffers, and full buffers become nodes. The result does
    not depend on the order or partitioning of the rows. Rows without a proper vector are ``refused``, with
    a reason. ``new_pointers`` is what the batch adds; ``changed_nodes`` and ``changed_buffers`` (with
    ``deleted``) are the rows it touches, so a stream writes no more than these. ``counts`` are observed
    while the batch runs: rows, refused, nodes, buffers, waiting rows.
    """
    vectors = F.col("embedding").cast("array<double>")
    seen, stored, held = Observation(), Observation(), Observation()
    judged = rows.withColumn("embedding", vectors).withColumn("source_id", F.coalesce("source_id", F.col("row_id").cast("string"))).withColumn(
        "reason", refusal(F.col("embedding"), params.dim))
    judged = cut(judged.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("reason").isNotNull()).alias("refused")))
    rows = judged.where("reason IS NULL").drop("reason")
    nodes = state["nodes"]
    decisions = cut(decide(rows, nodes, params))
    accepted = decisions.where("decision = 'NODE'")
    stats = nodestats.node_signatures(accepted.select("node_id", "embedding"), params)
    touched = nodes.join(stats.select("node_id"), "node_id", "left_semi").select("node_id", "mass", "centroid", "variance")
    merged = nodestats.merge_signatures(touched.unionByName(stats), params).select(
        "node_id", F.col("mass").alias("_mass"), F.col("centroid").alias("_centroid"), F.col("variance").alias("_variance"))
    updated = cut(nodes.join(merged, "node_id", "left").withColumns({
        c: F.coalesce(f"_{c}", c) for c in ("mass", "centroid", "variance")}).withColumn(
        "_changed", F.col("_mass").isNotNull()).drop("_mass", "_centroid", "_variance"))

    waiting = decisions.where("decision <> 'NODE'").select("row_id", "rank", "source_id", "embedding")
    open_buffers = cut(B.buffer_centroids(state["buffers"], params))
    placed = B.fill_buffers(waiting, open_buffers, params).select("row_id", "buffer_id")
    arrived = cut(waiting.join(placed, "row_id").select("buffer_id", "row_id", "source_id", "embedding"))
    members = state["buffers"].unionByName(arrived)
    here = open_buffers.select("buffer_id", "size").unionByName(arrived.groupBy("buffer_id").agg(F.count("*").alias("size")))
    sizes = here.groupBy("buffer_id").agg(F.sum("size").alias("size")).withColumn("_full", F.col("size") >= params.buffer_threshold)
    sizes = cut(sizes.observe(held, F.count_if(~F.col("_full")).alias("buffers"), F.coalesce(F.sum(F.when(~F.col("_full"), F.col("size"))), F.lit(0)).alias("waiting")))
    full = sizes.where("_full").select("buffer_id")
    fresh, fresh_pointers, left = B.promote(members, full, params)
    fresh = cut(fresh)
    chosen = parents.best_parent(fresh, parents.titans(updated, params), params)
    adopted = fresh.join(chosen.select("node_id", "parent_node_id", "sim"), "node_id", "left").select(
        "node_id", "centroid", "mass", "variance", F.lit("ORGANIC").alias("origin_type"),
        F.lit(False).alias("is_trained"), F.lit(False).alias("needs_training"),
        F.lit(None).cast("string").alias("training_status"), "parent_node_id",
        F.col("sim").alias("parent_similarity"),
        F.when(F.col("parent_node_id").isNull(), "ROOT").otherwise("HERITAGE").alias("inheritance_type"),
        F.lit(0).cast("bigint").alias("last_training_mass"), F.lit(True).alias("_changed"))
    after = updated.unionByName(adopted.select(*updated.columns))
    marked = R.training_mark(F.col("mass"), F.col("is_trained"), F.col("last_training_mass"), params)
    newly = marked.isNotNull() & ~F.col("needs_training")
    after = after.withColumns({"_changed": F.col("_changed") | newly, "needs_training": F.col("needs_training") | marked.isNotNull()})
    after = cut(after.observe(stored, F.count(F.lit(1)).alias("nodes")))
    new_pointers = accepted.select("node_id", "source_id").unionByName(fresh_pointers)
    new_pointers = provenance.known_pointers(new_pointers, after).distinct()
    gone = state["buffers"].join(full, "buffer_id", "left_semi").withColumn("deleted", F.lit(True))
    stay = arrived.join(full, "buffer_id", "left_anti").withColumn("deleted", F.lit(False))
    return {"nodes": after.drop("_changed"), "buffers": left, "new_pointers": new_pointers, "decisions": decisions,
            "pointers": state["pointers"].unionByName(new_pointers).distinct(),
            "refused": judged.where("reason IS NOT NULL").select("row_id", "source_id", "reason"),
            "changed_nodes": after.where("_changed").drop("_changed"), "changed_buffers": stay.unionByName(gone.select(*stay.columns)),
            "counts": {**seen.get, **stored.get, **held.get}}


def ingest(rows: DataFrame, params: Params, batches: int = 1, state: State | None = None) -> State:
    """Feed rows(row_id, source_id, embedding, confidence) in arrival order as equal batches; ``refused`` has
    the rows of all batches."""
    spark = rows.sparkSession
    state = state or empty_state(spark)
    ranked = cut(keyed_rank(rows, [], "row_id"))
    refused: DataFrame | None = None
    for i in range(batches):
        part = F.floor((F.col("rank") - 1) * batches / F.col("n")) == i
        state = process_batch(state, ranked.where(part).drop("n"), params)
        state = {**state, "buffers": cut(state["buffers"]), "pointers": cut(state["pointers"])}
        refused = state["refused"] if refused is None else refused.unionByName(state["refused"])
    return {**state, "refused": refused} if refused is not None else state

