"""Rules, ranks and folds against plain Python, hot keys included."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from nodeflow import Params
from nodeflow.functions import rules as R
from nodeflow.operators import evaluation, feedback, fusion, lineage, reports, training
from nodeflow.operators.ranking import clamped_sum, keyed_rank

P = Params(dim=2)


def hot_rows(n=3000, seed=1):
    """A third of all rows share one key."""
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}", rng.randrange(500), rng.uniform(-1, 1))
            for i in range(n)]


def test_rank_of_a_hot_key(spark):
    rows = hot_rows()
    frame = spark.createDataFrame(rows, "id bigint, k string, o int, v double")
    got = {r.id: (r.rank, r.n) for r in keyed_rank(frame, ["k"], "o", "id").collect()}
    groups = {}
    for i, k, o, _ in rows:
        groups.setdefault(k, []).append((o, i))
    want = {i: (at + 1, len(g)) for g in groups.values() for at, (_, i) in enumerate(sorted(g))}
    assert got == want
    # no slice of the hot key is large
    from nodeflow.operators.ranking import sliced
    top = sliced(frame, "o").groupBy("k", "_slice").count().agg(F.max("count")).first()[0]
    assert top < len(groups["hot"]) / 6


def test_clamped_sum_folds_in_order(spark):
    rows = hot_rows(seed=2)
    frame = spark.createDataFrame(rows, "id bigint, k string, o int, v double")
    got = {r.k: (r.total, r.lowest) for r in clamped_sum(frame, ["k"], F.col("v"), "o", "id").collect()}
    for key, (total, lowest) in got.items():
        x = 0.3
        for _, _, v in sorted((o, i, v) for i, k, o, v in rows if k == key):
            x = max(x + v, 0.0)
        assert max(0.3 + total, total - lowest) == pytest.approx(x, abs=1e-9)


def test_feedback_fold_equals_one_by_one(spark):
    rng = random.Random(5)
    events = [(i, f"n{rng.randrange(4)}", rng.random()) for i in range(400)]
    nodes = [("n0", 3, 0.02), ("n1", 0, None), ("n2", 7, 0.9), ("n3", 1, 0.0), ("idle", 5, 0.4)]
    frame = spark.createDataFrame(events, "seq bigint, node_id string, confidence double")
    got = {r.node_id: (r.mass, r.variance) for r in feedback.apply_feedback(
        spark.createDataFrame(nodes, "node_id string, mass bigint, variance double"), frame, P, "seq").collect()}
    for node, mass, var in nodes:
        seen = False
        v = var or 0.0
        for _, n, c in events:
            if n != node or c < 0.5:
                continue
            seen = True
            dm, dv = (1.0, -0.05 * c) if c >= 0.85 else (0.5, 0.05 * (1 - c))
            mass, v = max(int(mass + dm), 0), max(v + dv, 0.0)
        assert got[node][0] == mass
        assert got[node][1] == (pytest.approx(v, abs=1e-9) if seen else var)


def test_feedback_zones(spark):
    cs = [0.0, 0.49, 0.5, 0.84, 0.85, 1.0, None]
    rows = spark.createDataFrame([(c,) for c in cs], "confidence double")
    got = [(r.status, r.delta_mass, round(r.delta_variance, 6)) for r in feedback.feedback_delta(rows, P).collect()]
    assert got == [("NEW_BUFFER", 0, 0), ("NEW_BUFFER", 0, 0), ("OK", 0.5, 0.025), ("OK", 0.5, 0.008),
                   ("OK", 1.0, -0.0425), ("OK", 1.0, -0.05), ("NEW_BUFFER", 0, 0)]


def test_epochs(spark):
    # (mass, variance, texts, similarity) -> worked out by hand from the formula
    cases = [((0, 0.5, None, None), 2), ((1, 0.0, None, None), 1), ((12, 0.2, 12, None), 1), ((100, 1.0, 50, None), 4),
             ((100, 2.0, 10, None), 7), ((250, 1.0, 150, None), 2), ((250, 2.0, 50, None), 4), ((100, 1.0, 50, 0.9), 2),
             ((100, 1.0, 50, -0.3), 4), ((4, 3.0, None, None), 5)]
    rows = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, m bigint, v double, t int, s double")
    got = [r[0] for r in rows.orderBy("i").select(R.training_epochs(F.col("m"), F.col("v"), F.col("t"), F.col("s"))).collect()]
    assert got == [c[1] for c in cases]


@pytest.mark.parametrize("slices", [None, 7])
def test_upper_median(spark, slices):
    rng = random.Random(9)
    rows = [("a", rng.uniform(-5, 5)) for _ in range(900)] + [("b", 1.5)] * 400 + [("c", float(i)) for i in range(10)]
    inf, nan = float("inf"), float("nan")
    odd = spark.createDataFrame([("i", inf)] * 60 + [("i", 1.0)] * 50 + [("n", nan)] * 3 + [("n", 2.0)] * 4 + [(None, -inf), (None, None)],
                                "k string, v double")
    medians = {r.k: r.median_value for r in evaluation.eval_summary(odd, "k", "v").collect()}
    assert medians == {"i": inf, "n": 2.0, None: -inf}
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.median_value for r in evaluation.upper_median(frame, "k", "v", slices).collect()}
    for k in "abc":
        vs = sorted(v for key, v in rows if key == k)
        assert got[k] == vs[len(vs) // 2]


def test_confidence_of_steps(spark):
    steps = [[1.0, 2.0, 3.0], [800.0, 0.0, 0.0]]
    rows = spark.createDataFrame([(steps,), ([],)], "s array<array<double>>")
    got = [r[0] for r in rows.select(evaluation.confidence(F.col("s"))).collect()]
    top = math.exp(3) / sum(math.exp(x) for x in (1, 2, 3))
    assert got[0] == pytest.approx((top + 1) / 2) and got[1] == 0.0


def test_quarantine_gate(spark):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    rows = [("a", True, 0, None), ("b", False, 0, None), ("c", False, 1, None), ("d", False, 1, "2024-01-29 00:00:01"),
            ("e", False, 1, "2024-01-29 00:00:00"), ("f", False, 2, "2024-01-25 00:00:00"), ("g", False, 3, "2024-01-20 00:00:00"),
            ("h", None, -4, None)]
    frame = spark.createDataFrame(rows, "n string, f boolean, c int, x string").withColumn("x", F.col("x").cast("timestamp_ntz"))
    got = [r[0] for r in frame.orderBy("n").select(
        R.quarantine_status(F.col("f"), F.col("c"), F.col("x"), as_of, P)).collect()]
    assert got == ["FORCED_ROOT", "NO_QUARANTINE", "IN_QUARANTINE", "IN_QUARANTINE", "QUARANTINE_EXPIRED", "IN_QUARANTINE",
                   "QUARANTINE_EXPIRED", "NO_QUARANTINE"]


def test_parent_update_rejects_what_is_invalid(spark):
    nodes = spark.createDataFrame([("a", None, None, "ROOT"), ("b", "a", 0.7, "HERITAGE"), ("c", None, None, "ROOT")],
                                  "node_id string, parent_node_id string, parent_similarity double, inheritance_type string")
    ups = spark.createDataFrame([("a", "c", 0.9), ("b", "c", 0.8), ("c", "c", 0.9), ("zz", "a", 0.5)],
                                "node_id string, parent string, similarity double")
    out, events = lineage.parent_update(nodes, ups)
    got = {r.node_id: (r.parent_node_id, r.parent_similarity, r.inheritance_type) for r in out.collect()}
    assert got == {"a": ("c", 0.9, "HERITAGE"), "b": ("c", 0.8, "HERITAGE"), "c": (None, None, "ROOT")}
    assert {(r.node_id, r.reason, r.from_type) for r in events.collect()} == {
        ("a", "PROGRESSIVE_ADOPTION", "ROOT"), ("b", "PARENT_CHANGE", "HERITAGE")}


def test_last_texts_then_blanks_then_minimum(spark):
    p = Params(max_training_texts=5, min_training_texts=4)
    rows = [("a", f"s{i}", i, "x" if i != 1 else " ") for i in range(6)] + [("b", f"s{i}", i, "x" if i > 1 else "") for i in range(5)]
    frame = spark.createDataFrame(rows, "node_id string, source_id string, created int, text string")
    got = sorted((r.node_id, r.source_id) for r in training.training_texts(frame, p).collect())
    assert got == [("a", "s2"), ("a", "s3"), ("a", "s4"), ("a", "s5")]


def test_loss_abort_strict_and_loose(spark):
    rows = [("s", 0, 1.1, 1.0, True), ("l", 0, 1.1, 1.0, False), ("l", 1, 2.5, 1.0, False), ("k", 0, 0.9, 1.0, True), ("k", 1, 1.9, 1.0, True)]
    frame = spark.createDataFrame(rows, "node_id string, step int, loss double, baseline double, strict boolean")
    assert {r.node_id: r.abort_step for r in training.loss_abort(frame, P).collect()} == {"s": 0, "l": 1, "k": None}


def test_diagnosis_of_no_nodes(spark):
    empty = spark.createDataFrame([], "node_id string, centroid array<double>, mass bigint, variance double, origin_type string")
    assert fusion.fusion_matching(empty, P).count() == 0
    assert fusion.fusion_candidates(empty, P).count() == 0


def test_nulls_and_repeats_lose_nothing(spark):
    from nodeflow.operators.lineage import parent_update
    from nodeflow.operators.provenance import label_update
    from nodeflow.operators.ranking import keyed_rank
    from nodeflow.operators.training import training_outcomes

    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), (None, 2.0), (None, None)], "k string, v double")
    got = sorted((r["k"] or "", r["rank"], r["n"], r["v"]) for r in keyed_rank(rows, ["k"], "v").collect())
    assert got == [("", 1, 2, None), ("", 2, 2, 2.0), ("a", 1, 3, None), ("a", 2, 3, 1.0), ("a", 3, 3, 3.0)]

    nodes = spark.createDataFrame([("n", None, None, "ROOT", "old")], "node_id string, parent_node_id string, parent_similarity double, inheritance_type string, label string")
    updates = spark.createDataFrame([("n", "p", 0.5), ("n", "q", 0.7)], "node_id string, parent string, similarity double")
    changed, events = parent_update(nodes, updates)
    assert [r["parent_node_id"] for r in changed.collect()] == ["q"] and events.count() == 1
    labels = spark.createDataFrame([("n", "x"), ("n", "y"), ("n", None)], "node_id string, new_label string")
    assert [r["label"] for r in label_update(nodes, labels).collect()] == ["y"]

    trained = spark.sql("SELECT 'n' AS node_id, 'X' AS training_status, false AS is_trained, true AS needs_training, 5 AS mass, 1 AS last_training_mass, "
                        "'ROOT' AS inheritance_type, 2 AS total_failures, TIMESTAMP_NTZ '2024-01-01' AS last_failure_time")
    none = spark.createDataFrame([], "node_id string, outcome string, at timestamp_ntz")
    assert training_outcomes(trained, none).first()["last_failure_time"].year == 2024


def test_history_entries_hold_every_field(spark):
    rows = [("a", 1, "OLD", "HERITAGE", "", "p", 0.5, '{"count": 3, "why": ["x"]}'), ("a", 2, "HERITAGE", "ROOT", "R", None, 1.5, None),
            ("b", 3, None, None, None, "q", None, "{broken")]
    frame = spark.createDataFrame(rows, "node_id string, event_id long, from_type string, to_type string, reason string, parent_id string, similarity double, metadata string")
    events = frame.withColumn("event_time", F.expr("timestamp_ntz '2024-05-06 07:08:09.012345' + make_dt_interval(0, 0, 0, event_id)"))
    got = {(r.node_id, r.entry_no): json.loads(r.entry) for r in lineage.lineage_history(events).collect()}
    at = "2024-05-06T07:08:1{}.012345"
    assert got == {
        ("a", 1): {"timestamp": at.format(0), "from": "ROOT", "to": "HERITAGE", "reason": "UNKNOWN", "parent_id": "p", "similarity": 0.5,
                   "metadata": {"count": 3, "why": ["x"]}},
        ("a", 2): {"timestamp": at.format(1), "from": "HERITAGE", "to": "ROOT", "reason": "R", "parent_id": None, "similarity": None, "metadata": {}},
        ("b", 1): {"timestamp": at.format(2), "from": "ROOT", "to": "ROOT", "reason": "UNKNOWN", "parent_id": "q", "similarity": None, "metadata": {}}}
    bare = lineage.lineage_history(events.drop("metadata")).collect()
    assert [json.loads(r.entry)["metadata"] for r in bare] == [{}, {}, {}]


def test_perplexity_of_keys_without_batches(spark):
    losses = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("other", 1, 9.0)], "k string, o int, loss double")
    asked = spark.createDataFrame([("a",), ("none",), ("none",), (None,)], "k string")
    got = {r.k: (r.validation_loss, r.perplexity, r.n_batches) for r in evaluation.perplexity_rollup(losses, P, "k", "o", asked=asked).collect()}
    assert got == {"a": (3.0, pytest.approx(math.exp(3)), 1), "none": (math.inf, math.inf, 0), None: (math.inf, math.inf, 0)}


def test_variance_change_between_domains(spark):
    before = spark.createDataFrame([(d, f"{d}{i}") for d in "abc" for i in range(4)], "domain string, node_id string")

    def change(*variances):
        after = spark.createDataFrame([(d, f"{d}0", 2, v) for d, v in zip("abc", variances)], "domain string, node_id string, mass int, variance double")
        return [r.variance_change for r in reports.consolidation_metrics(before, after).orderBy("domain").collect()]

    assert change(0.4, 0.2, None) == [0.0, -0.5, -1.0]
    assert change(0.0, 0.2, 0.1) == [None, None, None]
