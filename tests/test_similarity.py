"""The similarity join against a plain NumPy model, on all physical paths."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nodeflow import Params
from nodeflow.operators import fusion, routing, similarity
from nodeflow.operators.similarity import Spec, match

BROADCAST = Params(dim=6)
TILED = Params(dim=6, broadcast_bytes=0, tile_rows=20, group_rows=25, max_pivots=7)


PATHS = {"broadcast": (BROADCAST, None), "cells": (TILED, 1e9), "grid": (TILED, -1.0)}
EVERY_PATH = pytest.mark.parametrize("params, pays, prefixes", [(*v, p) for v in PATHS.values() for p in (False, True)],
                                     ids=[f"{n}{p}" for n in PATHS for p in ("", "-prefixes")])


def force_prefixes(monkeypatch, width):
    """Prefixes for blocks of ``width`` right rows, whatever they cost."""
    for name, value in (("_WIDTH", width), ("_GAIN", 1e9), ("_GATHER", 0)):
        monkeypatch.setattr(similarity, name, value)


@pytest.fixture(autouse=True)
def forced_path(request, monkeypatch):
    """Cells or the grid, with prefixes or whole blocks, whatever they cost."""
    given = request.node.callspec.params if hasattr(request.node, "callspec") else {}
    if given.get("pays") is not None:
        monkeypatch.setattr(similarity, "_PAYS", given["pays"])
    if given.get("prefixes"):
        force_prefixes(monkeypatch, 8)


def vectors(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, 6))
    m[:copies] = m[0]
    return m


def arrow(m, side, **attrs):
    ids, vecs = pa.array(np.arange(len(m))), pa.array(list(m), pa.list_(pa.float64()))
    return pa.table({f"{side}id": ids, f"{side}vec": vecs, f"{side}hash": pa.array(np.arange(len(m)) * 7919), **attrs})


def kernel(left, right, spec):
    """Sorted rows of the kernel in one task, the side and the coordinates it multiplied."""
    side = similarity._Side(*similarity._side_parts(right, spec))
    run = similarity._count if spec.counts else similarity._best
    rows = pa.Table.from_batches(list(run(left.combine_chunks(), side, spec))).to_pydict()
    return sorted(zip(*rows.values())), side


def frame(spark, m, side, names=None):
    names = names or [f"{side}{i:04d}" for i in range(len(m))]
    rows = [(names[i], [float(x) for x in v], float(i)) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, f"{side}id string, {side}vec array<double>, {side}w double").repartition(3)


def cosines(a, b):
    a = a / np.linalg.norm(a, axis=1, keepdims=True)
    b = b / np.linalg.norm(b, axis=1, keepdims=True)
    return np.round(a @ b.T, 9)


@EVERY_PATH
def test_best_k(spark, params, pays, prefixes):
    a, b = vectors(90, 1), vectors(150, 2, copies=50)
    sim = cosines(a, b)
    for k in (1, 4):
        got = match(frame(spark, a, "l"), frame(spark, b, "r"), Spec(floor=0.3, k=k), params).collect()
        want = set()
        for i in range(len(a)):
            order = [j for j in sorted(range(len(b)), key=lambda j: (-sim[i, j], j)) if sim[i, j] >= 0.3][:k]
            want |= {(f"l{i:04d}", f"r{j:04d}", sim[i, j]) for j in order}
        assert {(r.lid, r.rid, r.sim) for r in got} == want
        assert len(got) == len(want) > 20


@EVERY_PATH
def test_weighted_score_and_gate(spark, params, pays, prefixes):
    a, b = vectors(40, 3), vectors(120, 4)
    sim = cosines(a, b)
    spec = Spec(floor=0.2, k=1, right_attrs=("rw",), carry=("rw",),
                keep=lambda s, L, R: s >= 0.2 + R["rw"] / 500, score=lambda s, L, R: s + 0.01 * R["rw"])
    got = {r.lid: (r.rid, r.rw) for r in match(frame(spark, a, "l"), frame(spark, b, "r"), spec, params).collect()}
    want = {}
    for i in range(len(a)):
        ok = [j for j in range(len(b)) if sim[i, j] >= 0.2 + j / 500]
        if ok:
            j = max(ok, key=lambda j: sim[i, j] + 0.01 * j)
            want[f"l{i:04d}"] = (f"r{j:04d}", float(j))
    assert got == want and len(want) > 20


@EVERY_PATH
def test_self_pairs_and_counts(spark, params, pays, prefixes):
    a = vectors(130, 5, copies=40)
    names = [f"n{i:04d}" for i in range(len(a))]
    sim = cosines(a, a)
    upper = np.triu(np.ones_like(sim, dtype=bool), 1)
    left, right = frame(spark, a, "l", names), frame(spark, a, "r", names)
    got = {(r.lid, r.rid) for r in match(left, right, Spec(floor=0.7, k=None, pairs="after"), params).collect()}
    want = {(names[i], names[j]) for i, j in zip(*np.nonzero(upper & (sim >= 0.7)))}
    assert got == want
    spec = Spec(floor=0.5, pairs="after", counts=(0.5, 0.9))
    rows = match(left, right, spec, params).groupBy("threshold").sum("n").collect()
    assert {r[0]: r[1] for r in rows} == {t: int((upper & (sim >= t)).sum()) for t in (0.5, 0.9)}
    others = match(left, right, Spec(floor=-1.0, k=1, pairs="other"), params).collect()
    assert len(others) == len(a) and all(r.lid != r.rid for r in others)


def test_hot_cell_is_split_on_both_sides(spark):
    """A third of the rows are copies; groups stay bounded and the result stays whole."""
    a = vectors(300, 6, copies=100)
    params = Params(dim=6, broadcast_bytes=0, tile_rows=16, group_rows=10, max_pivots=4)
    got = match(frame(spark, a, "l"), frame(spark, a, "r"), Spec(floor=0.5, k=3), params).count()
    sim = cosines(a, a)
    assert got == int(np.minimum((sim >= 0.5).sum(axis=1), 3).sum())


def test_large_sides_are_copied_once_per_tile(spark, monkeypatch):
    """64 dimensions, right side far beyond the broadcast: same results, copies bounded by the number of tiles."""
    rng = np.random.default_rng(7)
    m = rng.normal(size=(600, 64))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    left = spark.createDataFrame(rows, "row_id long, embedding array<double>").repartition(4)
    nodes = spark.createDataFrame([(f"n{i:04d}", [float(x) for x in v], i % 20 + 1, 0.5) for i, v in enumerate(m[::-1])],
                                  "node_id string, centroid array<double>, mass long, variance double")
    near = Params(dim=64, s_min=0.25)
    far = Params(dim=64, s_min=0.25, broadcast_bytes=1000, tile_rows=200, group_rows=300)
    seen = []
    dealt = similarity._by_grid

    def counted(*args):
        queries, targets = dealt(*args)
        seen.append((queries.count(), targets.count()))
        return queries, targets

    monkeypatch.setattr(similarity, "_by_grid", counted)
    for run in (lambda p: routing.route(left, nodes, p), lambda p: routing.topk(left, nodes, 3, p),
                lambda p: fusion.adjacency(nodes, 0.3, p)):
        want = sorted(map(str, run(near).collect()))
        assert sorted(map(str, run(far).collect())) == want and want
    assert seen and all(n_left <= 3 * 600 and n_right <= 2 * 600 for n_left, n_right in seen)


def test_lone_low_threshold_leaves_other_cells_pruned(spark, monkeypatch):
    """Cells have floors of their own: one node that accepts everything does not open the others."""
    rng = np.random.default_rng(8)
    centres = np.eye(64)[:20] * 10
    m = np.concatenate([c + rng.normal(size=(20, 64)) * 0.1 for c in centres])
    limits = [-0.9] + [0.8] * (len(m) - 1)
    right = spark.createDataFrame([(i, [float(x) for x in v], t) for i, (v, t) in enumerate(zip(m, limits))], "rid long, rvec array<double>, t double")
    left = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "lid long, lvec array<double>")
    spec = Spec(floor_attr="t", k=1, right_attrs=("t",), keep=lambda sim, L, R: sim >= R["t"])
    params = Params(dim=64, broadcast_bytes=0, tile_rows=40, group_rows=100)
    copies = []
    dealt = similarity._by_cell

    def counted(*args):
        out = dealt(*args)
        copies.append(out[0].count() if out else None)
        return out

    monkeypatch.setattr(similarity, "_by_cell", counted)
    got = {r.lid: r.rid for r in match(left, right, spec, params).collect()}
    sim = cosines(m, m)
    sim[sim < np.array(limits)[None, :]] = -2
    assert got == {i: int(np.argmax(sim[i])) for i in range(len(m))}
    assert copies[0] is not None and copies[0] < len(m) * 60


SPECS = {
    "floor": Spec(floor=0.8, k=None),
    "after": Spec(floor=0.8, k=None, pairs="after"),
    "best": Spec(k=3),
    "others": Spec(k=2, pairs="other", hash_ties=True),
    "counts": Spec(floor=0.8, counts=(0.8, 0.9)),
    "weighted": Spec(k=2, right_attrs=("w",), score=lambda sim, L, R: sim * R["w"], keep=lambda sim, L, R: sim >= R["w"] / 4),
    "left attribute": Spec(floor=0.75, k=2, left_attrs=("v",), right_attrs=("w",), keep=lambda sim, L, R: R["w"] < L["v"]),
}


def spectrum(n, power, seed):
    """384 dimensions turned at random, the size of the i-th axis falling as i ** -power."""
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(np.random.default_rng(0).normal(size=(384, 384)))[0]
    return (rng.normal(size=(n, 384)) * np.arange(1, 385) ** -power) @ turn


@pytest.mark.parametrize("name", SPECS)
def test_prefixes_save_products_and_lose_nothing(monkeypatch, name):
    spec, rng = SPECS[name], np.random.default_rng(9)
    right = spectrum(9000, 0.7, 1)
    right[5000:5040] = right[0]  # ties
    left = np.concatenate([right[:200] + 0.01 * rng.normal(size=(200, 384)), spectrum(200, 0.7, 2)])
    extra = {"left": {"v": pa.array(rng.random(len(left)))}, "right": {"w": pa.array(rng.random(len(right)))}}
    tables = arrow(left, "l", **extra["left"]), arrow(right, "r", **extra["right"])
    got, side = kernel(*tables, spec)
    monkeypatch.setattr(similarity, "_GAIN", -1.0)
    want, whole = kernel(*tables, spec)
    assert got == want and len(got) > 0
    assert side.axes is not None and whole.axes is None
    assert whole.spent == 384 * len(left) * len(right)
    assert side.spent < whole.spent / (1.5 if spec.k else 3)  # with k, the first block is taken whole


def test_prefixes_stay_away_where_they_do_not_pay(monkeypatch):
    """Equal sizes along all axes: the sample shows no gain. Left rows the sample could not foresee: few blocks are tried."""
    rng = np.random.default_rng(10)
    even = rng.normal(size=(9000, 384))
    got, side = kernel(arrow(even[:50], "l"), arrow(even, "r"), Spec(floor=0.5, k=None))
    assert side.axes is None and len(got) == 50
    right, spec = spectrum(9000, 0.7, 3), Spec(floor=0.8, k=None)
    axes = kernel(arrow(right[:1], "l"), arrow(right, "r"), spec)[1].axes
    near = axes[:, :4] @ np.array([3.0, 1, 1, 1]) + 0.01 * rng.normal(size=(4000, 384))
    got, side = kernel(arrow(near, "l"), arrow(right, "r"), Spec(floor=0.3, counts=(0.3, 0.6)))
    monkeypatch.setattr(similarity, "_GAIN", -1.0)
    want, whole = kernel(arrow(near, "l"), arrow(right, "r"), Spec(floor=0.3, counts=(0.3, 0.6)))
    assert got == want and side.spent < 1.2 * whole.spent


def test_falling_scores_keep_prefixes_out(monkeypatch):
    """A score that falls with the similarity is stated by the caller and gives the farthest rows."""
    force_prefixes(monkeypatch, 8)
    a, b = vectors(30, 11), vectors(60, 12)
    spec = Spec(k=1, score=lambda sim, L, R: -sim, rising=False)
    got, side = kernel(arrow(a, "l"), arrow(b, "r"), spec)
    assert side.axes is None and [r[1] for r in got] == cosines(a, b).argmin(axis=1).tolist()


@pytest.mark.parametrize("params", [BROADCAST, TILED], ids=["broadcast", "tiled"])
@pytest.mark.parametrize("pairs, k", [("all", 1), ("all", 3), ("other", 1), ("other", 3)])
def test_equal_vectors_are_compared_once(spark, monkeypatch, params, pairs, k):
    monkeypatch.setattr(similarity, "_FEW", 0, raising=False)
    kinds = vectors(3, 5)
    m = kinds[np.arange(240) % 3]
    names = [f"x{(i * 7) % 240:04d}" for i in range(240)]
    judged = spark.sparkContext.accumulator(0)

    def keep(sim, L, R):
        judged.add(int(sim.size))
        return sim >= -0.9

    spec = Spec(floor=-0.9, k=k, pairs=pairs, right_attrs=("rw",), carry=("rw",), keep=keep,
                score=lambda sim, L, R: sim + R["rw"])
    right = frame(spark, m, "r", names).withColumn("rw", (F.col("rw") % 2) / 100)
    got = match(frame(spark, m, "l", names), right, spec, params).collect()
    unit = kinds / np.linalg.norm(kinds, axis=1)[:, None]
    sims = np.round(unit @ unit.T, 9)
    want = set()
    for i in range(240):
        found = sorted((-(sims[i % 3, j % 3] + j % 2 / 100), names[j], j) for j in range(240)
                       if sims[i % 3, j % 3] >= -0.9 and (pairs == "all" or i != j))[:k]
        want |= {(names[i], name, round(sims[i % 3, j % 3], 6), round(-score, 6), j % 2 / 100) for score, name, j in found}
    assert len(got) == len(want)
    assert {(r.lid, r.rid, round(r.sim, 6), round(r.score, 6), r.rw) for r in got} == want
    assert judged.value <= 2 * 3 * 6 * (k + 1)  # 240 * 240 pairs otherwise


POOL = pa.proxy_memory_pool(pa.default_memory_pool())  # has to outlive what it holds


def test_without_right_rows_no_left_row_is_read(spark):
    """The first batch of a run meets no node and no buffer."""
    left = spark.range(3).select(F.col("id").alias("row_id"), F.raise_error(F.lit("was read")).cast("array<double>").alias("embedding"))
    nodes = spark.createDataFrame([], "node_id string, centroid array<double>, mass bigint")
    assert routing.route_matches(left, nodes, BROADCAST).collect() == []
    got = routing.route(left, nodes, BROADCAST).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [(i, routing.NEW_BUFFER, 0.0, None, None) for i in range(3)]


def test_a_right_side_is_held_once():
    """Building it takes little more than the matrix itself, beside the rows it is built from."""
    import tracemalloc

    m = np.random.default_rng(3).normal(size=(40_000, 64))
    rows = pa.table({"rid": pa.array(np.arange(len(m))[::-1]), "rhash": pa.array(np.arange(len(m))),
                     "rvec": pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * 64, pa.int32()), pa.array(m.ravel()))})
    was = pa.default_memory_pool()
    pa.set_memory_pool(POOL)
    tracemalloc.start()
    try:
        unit, ids, *_ = similarity._side_parts(rows, Spec(k=None, rising=False))
        arrow, plain = POOL.max_memory(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(was)
    assert (np.diff(ids) > 0).all()
    np.testing.assert_allclose(unit, (m / np.linalg.norm(m, axis=1)[:, None])[::-1])
    assert arrow + plain < 1.5 * m.nbytes
