"""Micro-batches, fusion, plan and streams."""

import datetime
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeflow import Params
from nodeflow.operators.state import StateStore
from nodeflow.plans.fuse import fuse
from nodeflow.plans.ingest import empty_state, ingest, process_batch
from nodeflow.plans.run import full_run
from nodeflow.session import scratch_path
from nodeflow.streaming import ingest as SI

P = Params(dim=4, s_min=0.8, training_threshold=6, titan_min_mass=5, titan_max_variance=1.0, micro_max_mass=3)


def unit(m):
    return m / np.linalg.norm(m, axis=-1, keepdims=True)


def batch(n, seed, start=0):
    rng = np.random.default_rng(seed)
    centres = unit(np.random.default_rng(3).normal(size=(5, 4)))
    m = unit(centres[rng.integers(0, 5, n)] + rng.normal(scale=0.35, size=(n, 4)))
    return [(start + i, f"d:{start + i}", v.tolist(), None if i % 4 else (i % 100) / 100) for i, v in enumerate(m)]


SCHEMA = "row_id bigint, source_id string, embedding array<double>, confidence double"


class Model:
    """One snapshot micro-batch in plain Python."""

    def __init__(self):
        self.nodes, self.buffers, self.pointers = {}, {}, set()

    def step(self, rows):
        members = {k: [] for k in self.nodes}
        waiting = []
        for rid, sid, vec, conf in rows:
            v = np.array(vec)
            best = None
            for nid in sorted(self.nodes):
                mass, c, _ = self.nodes[nid]
                sim = round(float(v @ c / np.linalg.norm(v) / np.linalg.norm(c)), 9)
                th = round(P.s_min - P.threshold_decay / max(np.log1p(mass), P.threshold_min_log), 9)
                if sim >= th and (best is None or sim + P.mass_weight * np.log1p(mass) > best[0]):
                    best = (sim + P.mass_weight * np.log1p(mass), nid, sim)
            if best and best[2] >= P.s_min and (conf is None or conf >= P.feedback_low):
                members[best[1]].append(v)
                self.pointers.add((best[1], sid))
            else:
                waiting.append((rid, sid, v))
        for nid, vs in members.items():
            if vs:
                mass, c, var = self.nodes[nid]
                b = np.array(vs)
                n, mean = len(b), b.mean(axis=0)
                m2 = (mass - 1) * var + ((b - mean) ** 2).sum() + mass * n * ((mean - c) ** 2).sum() / (mass + n)
                self.nodes[nid] = (mass + n, (mass * c + n * mean) / (mass + n), m2 / (mass + n - 1))
        centres = {b: np.mean([v for _, v in ms], axis=0) for b, ms in self.buffers.items()}
        leaders = []
        for rid, sid, v in waiting:
            def sim(c):
                return round(float(v @ c / np.linalg.norm(v) / np.linalg.norm(c)), 9)
            near = [(sim(c), b) for b, c in centres.items() if sim(c) >= P.s_min]
            if near:
                home = max(near)[1]
            else:
                led = [(sim(lv), -k) for k, lv in leaders if sim(lv) >= P.s_min]
                if led:
                    home = f"row{-max(led)[1]}"
                else:
                    leaders.append((rid, v))
                    home = f"row{rid}"
            self.buffers.setdefault(home, []).append((sid, v))
        for b in [b for b, ms in self.buffers.items() if len(ms) >= P.buffer_threshold]:
            ms = self.buffers.pop(b)
            a = np.array([v for _, v in ms])
            self.nodes[f"kn_{b}"] = (len(a), a.mean(axis=0), float(((a - a.mean(axis=0)) ** 2).sum() / (len(a) - 1)))
            self.pointers |= {(f"kn_{b}", sid) for sid, _ in ms}


def facts(state):
    nodes = state["nodes"].collect()
    pointers = {}
    for r in state["pointers"].collect():
        pointers.setdefault(r.node_id, set()).add(r.source_id)
    return sorted((r.mass, round(r.variance, 9), tuple(np.round(r.centroid, 9)), tuple(sorted(pointers[r.node_id])))
                  for r in nodes)


def test_batches_equal_the_plain_model(spark):
    model, state = Model(), empty_state(spark)
    for i in range(3):
        rows = batch(60, 100 + i, start=60 * i)
        model.step(rows)
        frame = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.col("row_id")).repartition(3 + i)
        state = process_batch(state, frame, P)
    ptr = {}
    for n, s in model.pointers:
        ptr.setdefault(n, set()).add(s)
    want = sorted((m, round(v, 9), tuple(np.round(c, 9)), tuple(sorted(ptr[n]))) for n, (m, c, v) in model.nodes.items())
    got = facts(state)
    assert [g[3] for g in got] == [w[3] for w in want] and len(got) >= 5
    for g, w in zip(got, want):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], abs=1e-8) and np.allclose(g[2], w[2])
    held = sorted(len(ms) for ms in model.buffers.values())
    assert sorted(r["count"] for r in state["buffers"].groupBy("buffer_id").count().collect()) == held
    # every row is in exactly one place
    assert sum(g[0] for g in got) + sum(held) == 180


def jobs_of(spark, name, run):
    """What ``run`` returns and the number of Spark jobs it took."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    out = run()
    n = len(sc.statusTracker().getJobIdsForGroup(name))
    sc.setJobGroup("others", "others")
    return out, n


def test_jobs_of_a_batch_do_not_grow_with_its_rows(spark):
    few, many = (jobs_of(spark, f"batch-{n}", lambda: process_batch(
        empty_state(spark), spark.createDataFrame(batch(n, 9), SCHEMA).withColumn("rank", F.col("row_id")), replace(P, s_min=0.9)))[1]
        for n in (60, 600))
    assert 0 < many <= few + 8 and many < 70


def test_rows_without_an_id_stay_out_of_the_decisions(spark):
    rows = [*batch(40, 5), (None, "d:none", [1.0, 0.0, 0.0, 0.0], None)]
    out = process_batch(empty_state(spark), spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.coalesce("row_id", F.lit(99))), P)
    assert sorted(r.row_id for r in out["decisions"].collect()) == list(range(40))
    assert out["nodes"].agg(F.sum("mass")).first()[0] + out["buffers"].count() == 40


def test_fusion_conserves_mass_and_pointers(spark):
    state = ingest(spark.createDataFrame(batch(150, 9), SCHEMA), replace(P, s_min=0.9), batches=2)
    before = state["nodes"].agg(F.sum("mass")).first()[0]
    buffered = state["buffers"].count()
    sources = {r.source_id for r in state["pointers"].collect()} | {r.source_id for r in state["buffers"].collect()}
    after, report = fuse(state, replace(P, fusion_max_variance=2.0, s_min=0.7))
    r = report.first()
    assert r.final_nodes < r.initial_nodes and r.fusions > 0
    mass = after["nodes"].agg(F.sum("mass")).first()[0]
    assert mass + after["buffers"].count() == before + buffered
    assert {x.source_id for x in after["pointers"].collect()} | {x.source_id for x in after["buffers"].collect()} == sources
    known = {x.node_id for x in after["nodes"].collect()}
    assert {x.node_id for x in after["pointers"].collect()} <= known
    parents = {x.parent_node_id for x in after["nodes"].collect()} - {None}
    assert parents <= known


def test_full_run_plans_every_pending_node(spark):
    out = full_run(spark.createDataFrame(batch(120, 17), SCHEMA), P, F.lit("2024-01-31").cast("timestamp_ntz"), batches=2)
    pending = {r.node_id for r in out["nodes"].where("needs_training").collect()}
    plan = out["plan"].collect()
    assert {r.node_id for r in plan} == pending and len(plan) == len(pending) > 0
    assert [(r.tier, r.tier_key, r.node_id) for r in plan] == sorted((r.tier, r.tier_key, r.node_id) for r in plan)
    assert all(1 <= r.epochs <= 7 and r.n_texts > 0 and r.gate == "TRAIN" for r in plan)


def test_stream_equals_batches_and_repeats_are_harmless(spark):
    rows = [r for i in range(2) for r in batch(50, 200 + i, start=50 * i)]
    path, state, mark = (scratch_path(spark, n) for n in ("in", "state", "mark"))
    for i in range(2):
        spark.createDataFrame(rows[50 * i:50 * i + 50], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    q = SI.stream_ingest(stream, state, mark, P)
    q.awaitTermination(300)
    assert q.exception() is None
    store = StateStore(spark, state)
    assert store.versions() == [0, 1]
    streamed = SI.current(spark, state)
    assert facts(streamed) == facts(ingest(spark.createDataFrame(rows, SCHEMA), P, batches=2))
    before = facts(streamed)
    store.write(1, {"nodes": spark.range(0)})  # a repeated batch finds its version
    assert facts(SI.current(spark, state)) == before
    shown = SI.progress(spark, state).orderBy("batch").collect()
    assert [r.batch for r in shown] == [0, 1] and shown[1].nodes >= shown[0].nodes > 0


def test_half_written_version_does_not_count(spark):
    root = scratch_path(spark, "state")
    store = StateStore(spark, root)
    store.write(3, {"t": spark.range(5)})
    spark.range(9).write.parquet(f"{root}/data/version=4/t")
    assert store.versions() == [3] and store.read("t").count() == 5
    store.write(4, {"t": spark.range(7)})
    assert store.read("t").count() == 7 and store.read("t", 3).count() == 5


def test_holdback_over_batches(spark):
    state = {"training": spark.createDataFrame([], "node_id string"), "held": spark.createDataFrame([], "seq bigint, node_id string")}
    script = [
        [(1, "a", "START"), (2, "a", "ROW"), (3, "b", "ROW")],
        [(4, "a", "ROW"), (5, "b", "START"), (6, "b", "ROW")],
        [(7, "a", "END"), (8, "a", "ROW"), (9, "b", "ROW")],
    ]
    ready = []
    for rows in script:
        state = SI.holdback_step(state, spark.createDataFrame(rows, "seq bigint, node_id string, kind string"))
        ready.append(sorted(r.seq for r in state["ready"].collect()))
    assert ready == [[3], [], [2, 4, 8]]
    assert sorted(r.seq for r in state["held"].collect()) == [6, 9]


def _log(spark, versions, compact_at=(), retain=100):
    """A log written from [(key, value or None)] per version; None deletes."""
    store, model, seen = StateStore(spark, scratch_path(spark, "log"), buckets=4), {}, []
    for v, rows in enumerate(versions):
        rows = [(k, x, x is None) for k, x in rows]
        store.write(v, changes={"t": (spark.createDataFrame(rows, "k string, x int, deleted boolean"), ["k"])})
        model = {k: x for k, x in {**model, **{k: x for k, x, _ in rows}}.items() if x is not None}
        seen.append(dict(model))
        if v in compact_at:
            store.compact({"t": ["k"]}, retain)
    return store, seen


def _table(store, until=None, buckets=None):
    return {r.k: r.x for r in store.read_log("t", ["k"], until, buckets).collect()}


LOGGED = [[("a", 1), ("b", 2), ("c", 3)], [("a", 4), ("b", None)], [], [("b", 5), ("d", 6), ("c", None)], [("a", None), ("e", 7)], [("e", 8)]]


def test_log_reads_the_newest_rows(spark):
    store, seen = _log(spark, LOGGED)
    assert [_table(store, v) for v in range(6)] == seen and _table(store) == seen[-1]
    some = {r.b for r in spark.createDataFrame([("b",), ("d",)], "k string").select(store.bucket_of(F.col("k")).alias("b")).collect()}
    part = _table(store, buckets=sorted(some))
    assert {"b", "d"} <= set(part) and part.items() <= seen[-1].items()
    # a version writes what it touches
    assert [spark.read.parquet(f"{store.root}/log/t/version-{v}").count() for v in range(6)] == [len(r) for r in LOGGED]


def test_compaction_changes_no_read(spark):
    store, seen = _log(spark, LOGGED, compact_at=(1, 4))
    assert [_table(store, v) for v in range(6)] == seen
    # half of a compaction does not count
    store._append("t", "base", 5, spark.createDataFrame([("z", 9, False)], "k string, x int, deleted boolean"), ["k"])
    assert _table(store) == seen[-1]
    store.compact({"t": ["k"]})
    assert _table(store) == seen[-1]
    assert spark.read.parquet(f"{store.root}/log/t/base-5").count() == len(seen[-1])


def test_retention_removes_what_no_read_needs(spark):
    store, seen = _log(spark, LOGGED, compact_at=(1, 3, 5), retain=2)
    assert [_table(store, v) for v in (3, 4, 5)] == seen[3:]
    left = store._names("log/t")
    assert "version-0" not in left and "version-3" not in left and "base-1" not in left and "base-3" in left and "version-4" in left
    with pytest.raises(Exception):
        _table(store, 0)
    assert store.versions() == list(range(6))  # the notes stay


def test_refused_rows_are_counted_and_kept(spark):
    rows = batch(60, 5)
    bad = [(900, "x", None, None), (901, None, [1.0, 2.0], 0.5), (902, "y", [1.0, None, 0.0, 1.0], None), (903, "z", [float("nan"), 1.0, 0.0, 1.0], None), (904, "w", [], None)]
    mixed = spark.createDataFrame([*rows[:30], *bad, *rows[30:]], SCHEMA).withColumn("rank", F.col("row_id"))
    out = process_batch(empty_state(spark), mixed, P)
    clean = process_batch(empty_state(spark), spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.col("row_id")), P)
    assert {(r.row_id, r.source_id, r.reason) for r in out["refused"].collect()} == {
        (900, "x", "MISSING"), (901, "901", "WRONG_SIZE"), (902, "y", "GAP"), (903, "z", "GAP"), (904, "w", "WRONG_SIZE")}
    assert facts(out) == facts(clean) and clean["refused"].count() == 0
    assert out["counts"] == {**clean["counts"], "rows": 65, "refused": 5} and clean["counts"]["rows"] == 60
    assert out["counts"]["nodes"] == out["nodes"].count() and out["counts"]["waiting"] == out["buffers"].count()
    assert out["counts"]["buffers"] == out["buffers"].select("buffer_id").distinct().count()
    assert ingest(mixed.drop("rank"), P, batches=3)["refused"].count() == 5


def test_a_batch_writes_only_what_it_touches(spark):
    state = empty_state(spark)
    for i in range(3):
        before = {r.node_id: r for r in state["nodes"].collect()}
        held = {(r.buffer_id, r.row_id) for r in state["buffers"].collect()}
        state = process_batch(state, spark.createDataFrame(batch(40, 300 + i, start=40 * i), SCHEMA).withColumn("rank", F.col("row_id")), P)
        after = {r.node_id: r for r in state["nodes"].collect()}
        assert {r.node_id for r in state["changed_nodes"].collect()} == {k for k, r in after.items() if before.get(k) != r}
        now = {(r.buffer_id, r.row_id) for r in state["buffers"].collect()}
        changes = state["changed_buffers"].collect()
        assert {(r.buffer_id, r.row_id) for r in changes if r.deleted} == held - now
        assert {(r.buffer_id, r.row_id) for r in changes if not r.deleted} == now - held


def _held_back(spark, batches):
    from nodeflow.streaming import holdback as H

    path, out, mark = (scratch_path(spark, n) for n in ("in", "out", "mark"))
    schema = "seq bigint, node_id string, kind string"
    settings = {"spark.sql.streaming.stateStore.providerClass": H.STATE_STORE, "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for part in (batches[:1], batches[1:]):  # a restart after the first batch
            for rows in part:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
            if part:
                stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
                q = H.holdback(stream).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
                q.awaitTermination(120)
                assert q.exception() is None and not q.isActive
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return {r.seq: r.released for r in spark.read.schema(H.READY).parquet(out).collect()}


@pytest.mark.parametrize("cuts", [1, 2, 5])
def test_stateful_holdback_equals_the_table_form(spark, cuts):
    r = np.random.default_rng(cuts)
    rows = [(i, ["a", "b", "c", None][r.integers(4)], ["ROW", "ROW", "ROW", "START", "END"][r.integers(5)]) for i in range(200)]
    size = -(-len(rows) // cuts)
    parts = [rows[at:at + size] for at in range(0, len(rows), size)]
    state = {"training": spark.createDataFrame([], "node_id string"), "held": spark.createDataFrame([], "seq bigint, node_id string")}
    ready = []
    for part in parts:
        state = SI.holdback_step(state, spark.createDataFrame(part, "seq bigint, node_id string, kind string"))
        ready += [x.seq for x in state["ready"].collect()]
    got = _held_back(spark, parts)
    assert sorted(got) == sorted(ready) and state["held"].count() > 0


class _Handle:
    """The states and timers of one node, in plain Python."""

    class Cell:
        def __init__(self):
            self.values = []

        exists = lambda self: bool(self.values)
        clear = lambda self: self.values.clear()
        appendList = lambda self, x: self.values.extend(x)

        def update(self, x):
            self.values = [x]

    class Value(Cell):
        def get(self):
            return self.values[0]

    class Many(Cell):
        def get(self):
            return iter(self.values)

    def __init__(self):
        self.timers = set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getValueState(self, *_):
        return self.Value()

    def getListState(self, *_):
        return self.Many()


def test_a_training_without_an_end_is_ended_by_its_timer():
    import pandas as pd
    from nodeflow.streaming.holdback import HoldBack

    class Now:
        def __init__(self, ms):
            self.getCurrentProcessingTimeInMs = lambda: ms

    def sent(frames):
        return [(int(s), w) for f in frames for s, w in zip(f["seq"], f["released"])]

    def rows(*pairs):
        return iter([pd.DataFrame(pairs[:1], columns=["seq", "kind"]), pd.DataFrame(pairs[1:], columns=["seq", "kind"])])

    handle, node = _Handle(), HoldBack(limit_ms=50)
    node.init(handle)
    assert sent(node.handleInputRows(("a",), rows((0, "ROW"), (1, "START"), (2, "ROW")), Now(100))) == [(0, "AT_ONCE")] and handle.timers == {150}
    assert sent(node.handleInputRows(("a",), rows((3, "ROW"), (4, "START")), Now(120))) == [] and handle.timers == {150}
    handle.timers.clear()  # a timer leaves when it fires
    assert sent(node.handleExpiredTimer(("a",), Now(160), None)) == [(2, "LIMIT"), (3, "LIMIT")] and not node.held.exists()
    assert sent(node.handleInputRows(("a",), rows((5, "ROW"), (6, "START")), Now(200))) == [(5, "AT_ONCE")] and handle.timers == {250}
    assert sent(node.handleInputRows(("a",), rows((7, "ROW"), (8, "END")), Now(210))) == [(7, "AT_ONCE")] and not handle.timers


@pytest.mark.parametrize("cuts", [1, 2, 5])
def test_holdback_does_not_depend_on_batches(spark, cuts):
    kinds = "ROW START ROW END ROW START ROW START ROW ROW".split()
    rows = [(i, "a", k) for i, k in enumerate(kinds)] + [(10, None, "ROW")]
    state = {"training": spark.createDataFrame([], "node_id string"), "held": spark.createDataFrame([], "seq bigint, node_id string")}
    ready, size = [], -(-len(rows) // cuts)
    for at in range(0, len(rows), size):
        state = SI.holdback_step(state, spark.createDataFrame(rows[at:at + size], "seq bigint, node_id string, kind string"))
        ready += [r.seq for r in state["ready"].collect()]
    assert sorted(ready) == [0, 2, 4, 10]
    assert sorted(r.seq for r in state["held"].collect()) == [6, 8, 9]


def test_state_refuses_a_stream_with_another_checkpoint(spark):
    path, state, mark, other = (scratch_path(spark, n) for n in ("in", "state", "mark", "other"))
    rows = spark.createDataFrame([(1, "a", "START"), (2, "a", "ROW")], "seq bigint, node_id string, kind string")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    SI.stream_holdback(stream, state, mark).awaitTermination(120)
    SI.stream_holdback(stream, state, mark).awaitTermination(120)  # the same stream goes on
    assert [r.seq for r in StateStore(spark, state).read("held").collect()] == [2]
    with pytest.raises(Exception, match="belongs to stream"):
        SI.stream_holdback(stream, state, other).awaitTermination(120)


def test_deferred_training_links_every_step(spark):
    """Each node shows one step: the plan's gate, late binding, adoption, failure, quarantine and a new parent."""
    from nodeflow.plans.training import deferred_training

    axis = lambda i, other=0.0: [1.0 if j == i else other for j in range(4)]
    day = datetime.datetime(2024, 1, 31)
    exit_at = day - datetime.timedelta(hours=5)
    # name, vector, mass, trained, status, pending, parent, parent_similarity, quarantine_count, last exit
    rows = [
        ("titan", axis(0), 50, True, "COMPLETED", False, None, None, 0, None),
        ("late", axis(0, 0.1), 14, False, None, True, None, None, 0, None),
        ("dead", axis(3), 30, False, "FAILED", False, None, None, 0, None),
        ("orphan", axis(3, 0.2), 13, False, None, True, "dead", 0.9, 0, None),
        ("root", axis(1), 19, False, None, True, None, None, 0, None),
        ("adoptee", axis(1, 0.1), 15, False, None, True, None, None, 0, None),
        ("fails", axis(2), 18, False, None, True, None, None, 2, exit_at),
        ("child", [0.9, 0.0, 0.3, 0.0], 12, False, None, False, "fails", 0.8, 0, None),
    ]
    schema = ("node_id string, centroid array<double>, mass long, is_trained boolean, training_status string, needs_training boolean, "
              "parent_node_id string, parent_similarity double, quarantine_count int, last_quarantine_exit timestamp_ntz")
    nodes = spark.createDataFrame(rows, schema).withColumns({
        "variance": F.lit(0.1), "inheritance_type": F.when(F.col("parent_node_id").isNull(), "ROOT").otherwise("HERITAGE"),
        "last_training_mass": F.lit(0).cast("long"), "has_weights": F.col("is_trained"), "forced_root": F.lit(False),
        "total_failures": F.lit(0).cast("long"), "last_failure_time": F.lit(None).cast("timestamp_ntz")})
    texts = [(n, f"s{i}", day, "  " if n == "late" and i < 3 else "x") for n, k in (("late", 13), ("root", 12), ("adoptee", 30)) for i in range(k)]
    pointers = spark.createDataFrame(texts, "node_id string, source_id string, created timestamp_ntz, text string")
    outcomes = spark.createDataFrame([("root", "SUCCESS", day, None, None), ("fails", "FAILED", day, "PARENT_FAILED", 0.1)],
                                     "node_id string, outcome string, at timestamp_ntz, failure_type string, progress double")
    out = deferred_training(nodes, pointers, outcomes, F.lit("2024-01-31").cast("timestamp_ntz"), Params(dim=4))
    gates = {r.node_id: r.gate for r in out["plan"].collect()}
    assert gates == {"late": "NO_TEXTS", "orphan": "NO_TEXTS", "root": "TRAIN", "adoptee": "TRAIN", "fails": gates["fails"]}
    final = {r.node_id: r for r in out["nodes"].collect()}
    assert len(final) == len(rows)
    assert {n: r.parent_node_id for n, r in final.items()} == {
        "titan": None, "late": "titan", "dead": None, "orphan": None, "root": None, "adoptee": "root", "fails": None, "child": "titan"}
    assert final["root"].training_status == "COMPLETED" and final["root"].last_training_mass == 19
    assert final["fails"].forced_root and final["fails"].quarantine_count == 3 and final["fails"].total_failures == 1
    events = {(r.node_id, r.reason, r.parent_id) for r in out["events"].collect()}
    assert events == {("late", "PROGRESSIVE_ADOPTION", "titan"), ("orphan", "SANITIZATION", "dead"), ("adoptee", "PROGRESSIVE_ADOPTION", "root"),
                      ("fails", "FORCED_ROOT", None), ("child", "SANITIZATION", "fails"), ("child", "PROGRESSIVE_ADOPTION", "titan")}
    assert [r.node_id for r in out["queue"].collect()] == ["child"]


def test_a_stream_batch_is_written_by_several_tasks(spark, monkeypatch):
    from nodeflow.queries import flows

    monkeypatch.setattr(flows, "_FILE_ROWS", 10, raising=False)
    rows = spark.range(95).select(F.col("id"), (F.lit(94) - F.col("id")).alias("place"))
    seen = {}
    stream = flows._stream(spark, rows, "place", 3).writeStream.foreachBatch(
        lambda batch, i: seen.update({i: [(r.place, r.file) for r in batch.select("place", F.input_file_name().alias("file")).collect()]}))
    flows._finish(stream.trigger(availableNow=True).start())
    batches = [seen[i] for i in sorted(seen)]
    assert [len({file for _, file in b}) for b in batches] == [4, 4, 4]
    assert [p for b in batches for p in sorted(place for place, _ in b)] == list(range(95))


def test_files_of_a_stream_use_the_cores(spark, monkeypatch):
    from nodeflow.queries import flows

    monkeypatch.setattr(flows, "_TASK_ROWS", 10, raising=False)
    rows, cores = spark.range(400).select("id"), spark.sparkContext.defaultParallelism
    seen = {}
    stream = flows._stream(spark, rows, "id", 2).writeStream.foreachBatch(
        lambda batch, i: seen.update({i: [(r.id, r.file) for r in batch.select("id", F.input_file_name().alias("file")).collect()]}))
    flows._finish(stream.trigger(availableNow=True).start())
    batches = [seen[i] for i in sorted(seen)]
    assert [len({file for _, file in b}) for b in batches] == [min(cores, 20)] * 2
    assert [i for b in batches for i in sorted(i for i, _ in b)] == list(range(400))
