"""Find redundant nodes and fold them together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeflow.functions.rules import parent_key
from nodeflow.operators.nodestats import merge_signatures
from nodeflow.operators.similarity import Spec, match
from nodeflow.params import Params
from nodeflow.session import cut


def organic() -> Column:
    return F.coalesce(F.col("origin_type"), F.lit("ORGANIC")) != "SEED"


def small(params: Params) -> Column:
    return F.col("mass") <= params.fusion_max_mass


def stable(params: Params) -> Column:
    return F.coalesce(F.col("variance"), F.lit(0.0)) <= params.fusion_max_variance


def small_stable(nodes: DataFrame, params: Params) -> DataFrame:
    return nodes.where(organic() & small(params) & stable(params))


def _sides(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = [F.col("mass").cast("double"), F.coalesce("variance", F.lit(0.0))]
    return tuple(
        nodes.select(F.col("node_id").alias(f"{s}id"), F.col("centroid").alias(f"{s}vec"),
                     base[0].alias(f"{s}m"), base[1].alias(f"{s}v")) for s in "lr")


def adjacency(nodes: DataFrame, floor: float, params: Params) -> DataFrame:
    """Unordered node pairs with cosine >= floor: (node_id_1, node_id_2, sim)."""
    left, right = _sides(nodes)
    return match(left, right, Spec(floor=floor, k=None, pairs="after"), params).select(
        F.col("lid").alias("node_id_1"), F.col("rid").alias("node_id_2"), "sim")


def similarity_histogram(nodes: DataFrame, thresholds: tuple[float, ...], params: Params) -> DataFrame:
    """Number of unordered pairs at or above each threshold; tasks send counts, not pairs."""
    left, right = _sides(nodes)
    spec = Spec(floor=min(thresholds), pairs="after", counts=tuple(thresholds))
    return match(left, right, spec, params).groupBy("threshold").agg(F.sum("n").alias("n_pairs"))


def _increase(sim, L, R):
    """Variance of the two nodes taken as one, above the larger of the two."""
    n = L["lm"] + R["rm"]
    dist = L["norm"] ** 2 + R["norm"] ** 2 - 2.0 * sim * L["norm"] * R["norm"]
    m2 = (L["lm"] - 1) * L["lv"] + (R["rm"] - 1) * R["rv"] + L["lm"] * R["rm"] * dist / np.maximum(n, 1)
    pooled = np.where(n > 1, np.maximum(0.0, m2 / np.maximum(n - 1, 1)), 0.0)
    return pooled - np.maximum(L["lv"], R["rv"])


def _spec(params: Params, k: int | None, pairs: str) -> Spec:
    limit = params.fusion_variance_increase
    return Spec(floor=params.fusion_similarity, k=k, pairs=pairs, hash_ties=k is not None,
                left_attrs=("lm", "lv"), right_attrs=("rm", "rv"),
                keep=lambda sim, L, R: np.round(_increase(sim, L, R), 9) <= limit)


def fusion_candidates(nodes: DataFrame, params: Params) -> DataFrame:
    """Pairs of small stable nodes worth merging: (node_id_1, node_id_2, sim)."""
    left, right = _sides(small_stable(nodes, params))
    return match(left, right, _spec(params, None, "after"), params).select(
        F.col("lid").alias("node_id_1"), F.col("rid").alias("node_id_2"), "sim")


def fusion_matching(nodes: DataFrame, params: Params) -> DataFrame:
    """Greedy matching of the candidates, most similar first, each node once.

    A pair that comes first for both its nodes is in the greedy result, so all such pairs
    are taken per round and their nodes leave. Each node holds only its next best partners;
    a list that is used up is filled again from the nodes left. Equal similarities are
    ordered by a hash of the pair, which keeps the rounds few among copies.
    """
    k = params.neighbour_list
    spec = _spec(params, k, "other")
    free = cut(small_stable(nodes, params).select("node_id", "centroid", "mass", "variance"))

    def lists(rows: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        edges = cut(match(_sides(rows)[0], _sides(targets)[1], spec, params).select("lid", "rid", "sim", "tie"))
        full = cut(edges.groupBy("lid").count().where(F.col("count") >= k).select(F.col("lid").alias("node_id")))
        return edges, full

    edges, full = lists(free, free)
    any_full = not full.isEmpty()
    taken: list[DataFrame] = []
    while not edges.isEmpty():
        first = edges.groupBy("lid").agg(
            F.min(F.struct((-F.col("sim")).alias("worst"), "tie", "rid")).alias("b"))
        pairs = first.select(F.least("lid", "b.rid").alias("node_id_1"), F.greatest("lid", "b.rid").alias("node_id_2"),
                             (-F.col("b.worst")).alias("sim"))
        new = cut(pairs.groupBy("node_id_1", "node_id_2").agg(F.max("sim").alias("sim"), F.count("*").alias("n"))
                  .where("n = 2").drop("n"))
        if new.isEmpty():  # a sum that differs in its last bits seen from either side: take the first pair
            new = cut(pairs.orderBy(F.desc("sim"), "node_id_1", "node_id_2").limit(1))
        taken.append(new)
        used = new.select(F.explode(F.array("node_id_1", "node_id_2")).alias("node_id"))
        edges = cut(edges.join(used.withColumnRenamed("node_id", "lid"), "lid", "left_anti")
                    .join(used.withColumnRenamed("node_id", "rid"), "rid", "left_anti"))
        if any_full:
            free = cut(free.join(used, "node_id", "left_anti"))
            full = cut(full.join(used, "node_id", "left_anti"))
            empty = full.join(edges.select(F.col("lid").alias("node_id")), "node_id", "left_anti")
            again = cut(free.join(empty, "node_id", "left_semi"))
            if not again.isEmpty():
                more, more_full = lists(again, free)
                edges = cut(edges.unionByName(more))
                full = cut(full.join(again.select("node_id"), "node_id", "left_anti").unionByName(more_full))
    if not taken:
        return free.where(F.lit(False)).select(
            F.col("node_id").alias("node_id_1"), F.col("node_id").alias("node_id_2"), F.lit(0.0).alias("sim"))
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out


def merged_id(*ids: Column) -> Column:
    return F.concat(F.lit("kn_"), F.sha2(F.concat_ws("|", F.array_sort(F.array(*ids))), 256))


def merge_map(matching: DataFrame) -> DataFrame:
    """(old_id, new_id): the one table every dependent table is rewritten through."""
    new = merged_id(F.col("node_id_1"), F.col("node_id_2"))
    return matching.select(F.explode(F.array("node_id_1", "node_id_2")).alias("old_id"), new.alias("new_id"))


def apply_merges(nodes: DataFrame, mapping: DataFrame, params: Params) -> DataFrame:
    """Rewrite nodes through a merge map; parents follow the map, merged nodes become roots.

    A merged node needs training when a part did, when a part was trained, or by its mass. Other
    columns of the nodes stay; a merged node starts without label, quarantine and weights.
    """
    kept = nodes.join(mapping, nodes.node_id == mapping.old_id, "left_anti")
    moved = nodes.join(mapping, nodes.node_id == mapping.old_id).withColumn("node_id", F.col("new_id"))
    merged = merge_signatures(moved, params)
    flags = moved.groupBy("node_id").agg(
        F.max(F.col("needs_training") | F.col("is_trained")).alias("carry"))
    fresh = merged.join(flags, "node_id").select(
        "node_id", "centroid", "mass", "variance", F.lit("ORGANIC").alias("origin_type"),
        F.lit(False).alias("is_trained"),
        (F.col("carry") | (F.col("mass") >= params.training_threshold)).alias("needs_training"),
        F.lit(None).cast("string").alias("training_status"), F.lit(None).cast("string").alias("parent_node_id"),
        F.lit(None).cast("double").alias("parent_similarity"), F.lit("ROOT").alias("inheritance_type"))
    remap = mapping.select(F.col("old_id").alias("parent_node_id"), F.col("new_id").alias("_new_parent"))
    new = {"quarantine_count": 0, "forced_root": False, "has_weights": False}
    types = {f.name: f.dataType for f in nodes.schema}
    fresh = fresh.withColumns({c: F.lit(v).cast(types[c]) for c, v in new.items() if c in types})
    rest = kept.withColumn("_key", parent_key()).join(remap.withColumnRenamed("parent_node_id", "_key"), "_key", "left").withColumn(
        "parent_node_id", F.coalesce("_new_parent", "parent_node_id")).drop("_key", "_new_parent")
    return rest.unionByName(fresh, allowMissingColumns=True)


def reassign_pointers(pointers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Move (node_id, source_id) through the merge map; a pair exists once."""
    m = mapping.select(F.col("old_id").alias("node_id"), "new_id")
    return pointers.join(m, "node_id", "left").select(
        F.coalesce("new_id", "node_id").alias("node_id"), "source_id").distinct()


def micro_consolidate(nodes: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """Fold nodes of little mass into their most similar node: (nodes, merge map old -> final).

    Per round every micro node picks its nearest node; turns go by (mass, hash). A node moves
    when its turn is before its target's and the target does not move itself, so any number
    of nodes join one target at once. What was merged is not moved again in this run.
    """
    state = cut(nodes.withColumn("_done", F.lit(False)))
    total: DataFrame | None = None
    while True:
        micro = state.where(~F.col("_done") & organic() & (F.col("mass") <= params.micro_max_mass))
        left = micro.select(F.col("node_id").alias("lid"), F.col("centroid").alias("lvec"))
        right = state.select(F.col("node_id").alias("rid"), F.col("centroid").alias("rvec"))
        turn = F.struct("mass", F.xxhash64("node_id").alias("h"), "node_id")
        turns = micro.select(F.col("node_id").alias("lid"), turn.alias("turn"))
        picks = cut(match(left, right, Spec(floor=params.micro_similarity, k=1, pairs="other"), params)
                    .select("lid", "rid").join(turns, "lid"))
        if picks.isEmpty():
            break
        target = picks.select(F.col("lid").alias("rid"), F.col("turn").alias("target_turn"))
        early = cut(picks.join(target, "rid", "left").where(
            F.col("target_turn").isNull() | (F.col("turn") < F.col("target_turn"))).select("lid", "rid"))
        moves = early.join(early.select(F.col("lid").alias("rid")), "rid", "left_anti")
        name = F.concat(F.lit("kn_"), F.sha2(F.concat_ws("|", F.lit("fold"), "rid"), 256)).alias("new_id")
        mapping = cut(moves.select(F.col("lid").alias("old_id"), name).unionByName(
            moves.select(F.col("rid").alias("old_id"), name).distinct()))
        done = state.where("_done").select("node_id").unionByName(mapping.select(F.col("new_id").alias("node_id")))
        merged = apply_merges(state.drop("_done"), mapping, params)
        state = cut(merged.join(done.distinct().withColumn("_d", F.lit(True)), "node_id", "left")
                    .withColumn("_done", F.coalesce("_d", F.lit(False))).drop("_d"))
        if total is None:
            total = mapping
        else:
            step = mapping.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("_next"))
            total = cut(total.join(step, "new_id", "left").select(
                "old_id", F.coalesce("_next", "new_id").alias("new_id")).unionByName(
                    mapping.join(total.select(F.col("new_id").alias("old_id")), "old_id", "left_anti")))
    if total is None:
        total = state.where(F.lit(False)).select(F.col("node_id").alias("old_id"), F.col("node_id").alias("new_id"))
    return state.drop("_done"), total


def population(nodes: DataFrame, params: Params) -> DataFrame:
    """One row: counts and ranges of mass and variance, small and stable nodes."""
    v = F.coalesce("variance", F.lit(0.0))
    return nodes.agg(
        F.count("*").alias("total_nodes"), F.avg("mass").alias("avg_mass"), F.min("mass").alias("min_mass"),
        F.max("mass").alias("max_mass"), F.avg(v).alias("avg_variance"), F.min(v).alias("min_variance"),
        F.max(v).alias("max_variance"), F.count_if(small(params)).alias("small_nodes"),
        F.count_if(stable(params)).alias("stable_nodes"),
        F.count_if(small(params) & stable(params)).alias("small_stable_nodes"))


def diagnose(nodes: DataFrame, thresholds: tuple[float, ...], params: Params) -> DataFrame:
    """Population, pair counts and advice codes as one row.

    Advice: FEW_CANDIDATES, LOWER_SIMILARITY:<t>, RAISE_MAX_MASS, RAISE_MAX_VARIANCE.
    """
    active = params.fusion_similarity
    levels = tuple(sorted({*thresholds, active}))
    counts = similarity_histogram(nodes, levels, params).agg(
        F.sum(F.when(F.col("threshold") == active, F.col("n_pairs"))).alias("pairs_at_threshold"),
        F.min(F.when(F.col("n_pairs") > 0, F.col("threshold"))).alias("lowest_with_pairs"))
    advice = F.array_compact(F.array(
        F.when(F.col("small_stable_nodes") < 2, "FEW_CANDIDATES"),
        F.when((F.col("pairs_at_threshold") == 0) & F.col("lowest_with_pairs").isNotNull(),
               F.concat(F.lit("LOWER_SIMILARITY:"), F.format_number("lowest_with_pairs", 2))),
        F.when(F.col("avg_mass") > 2 * params.fusion_max_mass, "RAISE_MAX_MASS"),
        F.when(F.col("avg_variance") > 2 * params.fusion_max_variance, "RAISE_MAX_VARIANCE")))
    stats = population(nodes, params)
    both = stats.unionByName(counts, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in (*stats.columns, *counts.columns)])
    return both.withColumn("advice", F.array_join(advice, ","))
