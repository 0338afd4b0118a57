"""Exact search against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeflow.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def _want(rows, k, every):
    ok = {(i, tuple(int(np.floor(np.float64(np.float32(x)) * 64)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, q in ok:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("params", [topk.TopKParams(k=5), topk.TopKParams(k=5, bucket_rows=16, query_rows=3, weak=0.3), topk.TopKParams(k=5, bucket_rows=16, query_rows=3, weak=0.0), topk.TopKParams(k=1000, bucket_rows=50)])
def test_equals_all_products(spark, params):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)) * rng.lognormal(0, 1, (300, 1))
    v[50:120] = v[50]
    v[130] = 0
    rows = [(int(i), [float(x) for x in np.float32(x)]) for i, x in enumerate(v)]
    rows += [(1000, None), (1020, []), (1040, [1.0, None] * 4), (1060, [float("nan")] * 8), (1080, [float("inf")] * 8), (None, [1.0] * 8), (2000, [1.0, 2.0]), (2001, [0.5, 0.5]), (2020, [3.0]), rows[20], (20, [1.0] * 8)]
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in rows], SCHEMA).repartition(4)
    got = topk.top_products(df, F.col("id") % 20 == 0, params).collect()
    assert sorted(tuple(r) for r in got) == _want(rows, params.k, 20)


def test_empty(spark):
    assert topk.top_products(spark.createDataFrame([], SCHEMA), F.col("id") % 20 == 0).count() == 0


def test_pruning_keeps_what_can_reach_the_floor():
    rng = np.random.default_rng(4)
    skipped = 0
    for _ in range(300):
        bucket = topk.Bucket(np.arange(40), rng.integers(-64, 64, (40, 3)))
        q = rng.integers(-64, 64, 3)
        scores = topk.products(bucket.vectors, q[None, :])[:, 0]
        floor = float(np.sort(scores)[-5])
        rows = topk.candidates(q, floor, bucket, topk.TopKParams())
        assert set(np.flatnonzero(scores >= floor)) <= set(rows.tolist())
        skipped += 40 - len(rows)
    assert skipped > 1000


def test_large_integers_are_exact():
    a = np.array([[2**31, 3], [1, 1]])
    assert topk.products(a, a)[0, 0] == 2**62 + 9
