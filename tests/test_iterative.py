"""Parallel rounds against the sequential algorithms they replace."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeflow import Params
from nodeflow.operators import fusion, parents
from nodeflow.operators.buffers import leader_cluster
from nodeflow.operators import leaders as leaders_module
from nodeflow.operators.leaders import elect_leaders

DIM = 5
BASE = Params(dim=DIM, s_min=0.6, fusion_similarity=0.5, fusion_max_mass=99, fusion_max_variance=9.0,
              fusion_variance_increase=0.35, adoption_similarity=0.6)
# tiny lists and heads force refills, several heads and the tiled join
NARROW = replace(BASE, neighbour_list=2, leader_list=2, leader_head_rows=20)
TILED = replace(NARROW, broadcast_bytes=0, tile_rows=30, group_rows=30, max_pivots=5)


def points(n, seed, copies):
    m = np.random.default_rng(seed).normal(size=(n, DIM))
    m[np.random.default_rng(seed + 1).permutation(n)[:copies]] = m[0]
    return m


def cos(m):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.round(u @ u.T, 9)


def sequential_leaders(sim, floor, adopts=None):
    leaders = []
    for i in range(len(sim)):
        if (adopts is None or adopts[i]) and not any(sim[i, j] >= floor for j in leaders):
            leaders.append(i)
    return leaders


@pytest.mark.parametrize("params", [BASE, NARROW, TILED], ids=["base", "narrow", "tiled"])
def test_leaders_follow_the_sequential_order(spark, params):
    m = points(120, 7, copies=40)
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(m)], "id bigint, rank bigint, vec array<double>")
    got = {r.id for r in elect_leaders(rows.repartition(5), params.s_min, params).collect()}
    assert got == set(sequential_leaders(cos(m), params.s_min))


@pytest.mark.parametrize("params", [BASE, NARROW, TILED], ids=["base", "narrow", "tiled"])
def test_rounds_find_the_leaders_of_heads_beyond_one_task(spark, params):
    m = points(120, 7, copies=40)
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(m)], "id bigint, rank bigint, vec array<double>")
    got = {r.id for r in elect_leaders(rows.repartition(5), params.s_min, replace(params, leader_task_rows=0)).collect()}
    assert got == set(sequential_leaders(cos(m), params.s_min))


def test_a_head_that_fits_one_task_is_settled_at_once(spark, monkeypatch):
    """Chains of neighbours, several steps of the walk, equal ranks and rows without a proper vector; the number
    of intermediate tables depends on the heads alone."""
    angle = np.cumsum(np.random.default_rng(5).uniform(0.0, 0.6, 700))
    m = np.c_[np.cos(angle), np.sin(angle), np.zeros((700, DIM - 2))]
    data = [(i, i, v.tolist()) for i, v in enumerate(m)]
    data += [(1000, 1000, None), (1001, 1001, [1.0, 0.0]), (1002, 3000, m[0].tolist()), (1003, -1, (-m[0]).tolist()), (1004, -1, (-m[0]).tolist())]
    rows = spark.createDataFrame(data, "id bigint, rank bigint, vec array<double>").repartition(5)
    cuts, cut = [], leaders_module.cut
    monkeypatch.setattr(leaders_module, "cut", lambda df: cuts.append(1) or cut(df))
    got = {r.id for r in elect_leaders(rows, 0.6, BASE).collect()}
    assert len(cuts) == 1
    assert got == {r.id for r in elect_leaders(rows, 0.6, replace(BASE, leader_task_rows=0)).collect()}
    assert {1000, 1001, 1003, 1004} < got and 1002 not in got


def test_sparse_rows_need_few_heads(spark, monkeypatch):
    """Rows without a neighbour: heads double, so their number grows with the logarithm."""
    m = np.eye(256)
    rows = spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, rank long, vec array<double>")
    heads, settle = [], leaders_module._settle
    monkeypatch.setattr(leaders_module, "_settle", lambda head, *args: heads.append(head.count()) or settle(head, *args))
    assert elect_leaders(rows, 0.5, replace(NARROW, dim=256, leader_head_rows=16)).count() == 256
    assert sum(heads) == 256 and len(heads) <= 5


def test_rows_join_the_most_similar_earlier_leader(spark):
    m = points(100, 11, copies=30)
    sim = cos(m)
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(m)],
                                 "row_id bigint, rank bigint, embedding array<double>")
    leaders = sequential_leaders(sim, 0.6)
    want = {i: i for i in leaders}
    for i in range(len(m)):
        if i not in want:
            want[i] = max((j for j in leaders if j < i), key=lambda j: (sim[i, j], -j))
    got = leader_cluster(rows, NARROW).collect()
    assert {r.row_id: r.buffer_row for r in got} == want and len(got) == len(m)


def test_adoption_walks_the_training_order(spark):
    m = points(80, 21, copies=20)
    sim = cos(m)
    trained = [i % 3 != 0 for i in range(80)]
    has_parent = [i % 7 == 0 for i in range(80)]
    rows = [(f"n{i:03d}", i + 1, v.tolist(), "x" if has_parent[i] else None, trained[i], "FAILED" if i % 11 == 0 else None)
            for i, v in enumerate(m)]
    order = spark.createDataFrame(rows, "node_id string, rank bigint, centroid array<double>, parent_node_id string, "
                                        "is_trained boolean, training_status string")
    parent = {i: None for i in range(80)}
    for i in range(80):
        if has_parent[i] or parent[i] is not None or not trained[i] or i % 11 == 0:
            continue
        for j in range(i + 1, 80):
            if not has_parent[j] and parent[j] is None and sim[i, j] >= 0.6:
                parent[j] = i
    want = {(f"n{j:03d}", f"n{i:03d}") for j, i in parent.items() if i is not None}
    got = {(r.node_id, r.parent_node_id) for r in parents.progressive_adoption(order, NARROW).collect()}
    assert got == want and len(want) > 10


def node_frame(spark, m, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"n{i:03d}", v.tolist(), int(rng.integers(2, 9)), float(rng.uniform(0.1, 1.0)),
             "SEED" if i % 13 == 0 else "ORGANIC", bool(i % 3), False, None, None, None, "ROOT")
            for i, v in enumerate(m)]
    schema = ("node_id string, centroid array<double>, mass bigint, variance double, origin_type string, "
              "is_trained boolean, needs_training boolean, training_status string, parent_node_id string, "
              "parent_similarity double, inheritance_type string")
    return rows, spark.createDataFrame(rows, schema).repartition(4)


def pooled(a, b):
    n = a[2] + b[2]
    d = float(np.sum((np.array(a[1]) - np.array(b[1])) ** 2))
    return max(0.0, ((a[2] - 1) * a[3] + (b[2] - 1) * b[3] + a[2] * b[2] * d / n) / (n - 1))


@pytest.mark.parametrize("params", [BASE, NARROW, TILED], ids=["base", "narrow", "tiled"])
def test_matching_equals_greedy(spark, params):
    m = points(90, 31, copies=0)
    rows, frame = node_frame(spark, m, 5)
    sim = cos(m)
    cand = [(sim[i, j], i, j) for i in range(90) for j in range(i + 1, 90)
            if sim[i, j] >= 0.5 and rows[i][4] != "SEED" and rows[j][4] != "SEED"
            and round(pooled(rows[i], rows[j]) - max(rows[i][3], rows[j][3]), 9) <= 0.35]
    used, want = set(), set()
    for _, i, j in sorted(cand, key=lambda c: (-c[0], c[1], c[2])):
        if i not in used and j not in used:
            used |= {i, j}
            want.add((rows[i][0], rows[j][0]))
    got = {(r.node_id_1, r.node_id_2) for r in fusion.fusion_matching(frame, params).collect()}
    assert got == want and len(want) > 5
    listed = {(r.node_id_1, r.node_id_2) for r in fusion.fusion_candidates(frame, params).collect()}
    assert listed == {(rows[i][0], rows[j][0]) for _, i, j in cand}


def test_matching_among_copies_is_maximal(spark):
    """Forty copies tie in every pair; the matching is valid and leaves no pair open."""
    m = points(70, 41, copies=40)
    rows, frame = node_frame(spark, m, 6)
    params = replace(NARROW, fusion_variance_increase=9.0)
    got = [(r.node_id_1, r.node_id_2, r.sim) for r in fusion.fusion_matching(frame, params).collect()]
    ids = [x for a, b, _ in got for x in (a, b)]
    assert len(ids) == len(set(ids))
    sim, at = cos(m), {r[0]: i for i, r in enumerate(rows)}
    assert all(abs(sim[at[a], at[b]] - s) < 1e-9 for a, b, s in got)
    free = [i for i, r in enumerate(rows) if r[0] not in ids and r[4] != "SEED"]
    assert not any(sim[i, j] >= 0.5 for i in free for j in free if i < j)
    # most similar first: no open pair beats what both its nodes got
    value = {x: s for a, b, s in got for x in (a, b)}
    organic = [i for i, r in enumerate(rows) if r[4] != "SEED"]
    for i in organic:
        for j in organic:
            if i < j and sim[i, j] >= 0.5:
                assert sim[i, j] <= max(value.get(rows[i][0], -1), value.get(rows[j][0], -1)) + 1e-9


def test_merge_keeps_mass_parents_and_flags(spark):
    m = points(60, 51, copies=10)
    rows, frame = node_frame(spark, m, 7)
    frame = frame.withColumn("parent_node_id", F.when(F.col("node_id") > "n030", "n001"))
    mapping = fusion.merge_map(fusion.fusion_matching(frame, BASE))
    moved = {r.old_id: r.new_id for r in mapping.collect()}
    out = {r.node_id: r for r in fusion.apply_merges(frame, mapping, BASE).collect()}
    assert sum(r.mass for r in out.values()) == sum(r[2] for r in rows)
    assert len(out) == len(rows) - len(moved) // 2 and not set(moved) & set(out)
    assert all(r.parent_node_id in (None, moved.get("n001", "n001")) for r in out.values())
    by_new = {}
    for old, new in moved.items():
        by_new.setdefault(new, []).append(next(r for r in rows if r[0] == old))
    for new, (a, b) in by_new.items():
        assert out[new].variance == pytest.approx(pooled(a, b), abs=1e-9)
        assert out[new].needs_training == (a[5] or b[5] or a[2] + b[2] >= BASE.training_threshold)
        want = (np.array(a[1]) * a[2] + np.array(b[1]) * b[2]) / (a[2] + b[2])
        assert np.allclose(out[new].centroid, want)


def test_merge_keeps_other_columns(spark):
    rows, frame = node_frame(spark, points(60, 51, copies=10), 7)
    frame = frame.withColumns({"label": F.lit("x"), "quarantine_count": F.lit(2)})
    mapping = fusion.merge_map(fusion.fusion_matching(frame, BASE))
    new = {r.new_id for r in mapping.collect()}
    out = fusion.apply_merges(frame, mapping, BASE)
    assert set(out.columns) >= {"label", "quarantine_count"} and new
    assert all((r.label, r.quarantine_count) == ((None, 0) if r.node_id in new else ("x", 2)) for r in out.collect())


def test_micro_nodes_fold_until_none_is_left(spark):
    m = points(80, 61, copies=30)
    rows, frame = node_frame(spark, m, 8)
    params = replace(BASE, micro_max_mass=4, micro_similarity=0.4)
    out, mapping = fusion.micro_consolidate(frame, params)
    got = out.collect()
    assert sum(r.mass for r in got) == sum(r[2] for r in rows)
    moved = {r.old_id: r.new_id for r in mapping.collect()}
    original = {r[0] for r in rows}
    final = {r.node_id for r in got}
    assert original - final == set(moved) & original and len(original - final) > 10
    assert {moved[o] for o in original & set(moved)} <= final
    sim = cos(np.array([r.centroid for r in got]))
    np.fill_diagonal(sim, -1)
    for i, r in enumerate(got):
        if r.node_id in original and r.mass <= 4 and r.origin_type != "SEED":
            assert sim[i].max() < 0.4
