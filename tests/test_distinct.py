"""Distinct keys over an unbounded past, against a plain set."""

import random

import pytest

from nodeflow.operators.state import StateStore
from nodeflow.session import scratch_path
from nodeflow.streaming import distinct as D

SCHEMA = "k string, n bigint, row string, bucket int"


def _batches(count, rows, distinct, seed):
    rnd = random.Random(seed)
    out, at = [], 0
    for _ in range(count):
        part = []
        for _ in range(rows):
            k, n = rnd.choice([None, "a", "b", ""]), rnd.choice([None, *range(distinct)])
            part.append((k, n, f"row {at}", at))
            at += 1
        out.append(part)
    return out


@pytest.mark.parametrize("blocks, distinct", [(64, 60), (1, 30000)], ids=["wide", "one crowded filter"])
def test_each_key_once_over_restarts(spark, blocks, distinct):
    """With one filter for all keys nearly every new key is looked up; none is dropped."""
    path, batches = scratch_path(spark, "state"), _batches(3, 10000 if blocks == 1 else 100, distinct, blocks)
    seen, notes = set(), []
    for v, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, SCHEMA).repartition(3)
        D.distinct_step(StateStore(spark, path), v, batch, ["k", "n"], blocks)  # a new store: as after a restart
        D.distinct_step(StateStore(spark, path), v, batch, ["k", "n"], blocks)  # a batch run again is passed over
        new = {r[:2] for r in rows} - seen
        notes.append((len(new), len({r[:2] for r in rows} & seen)))
        seen |= new
        if v == 1:
            StateStore(spark, path).compact(D.LOGS)
    got = D.distinct_rows(spark, path).collect()
    keys = [(r.k, r.n) for r in got]
    assert len(keys) == len(set(keys)) and set(keys) == seen
    given = {r[2]: r for rows in batches for r in rows}
    assert all(given[r.row] == tuple(r) for r in got)  # columns of the rows stay, whatever their names
    counts = D.distinct_progress(spark, path).orderBy("version").collect()
    assert [(c.new, c.known) for c in counts] == notes
    false = sum(c.looked_up - c.known for c in counts)
    assert false > 5000 if blocks == 1 else false < 10


def test_a_lost_batch_is_done_again(spark):
    """Data without a commit does not count as seen."""
    path = scratch_path(spark, "state")
    store = StateStore(spark, path)
    D.distinct_step(store, 0, spark.createDataFrame([("a", 1)], "k string, n int"), ["k"])
    put, store._put = store._put, lambda *a: (_ for _ in ()).throw(OSError("lost")) if "commits" in a[0] else put(*a)
    late = spark.createDataFrame([("a", 2), ("b", 3)], "k string, n int")
    with pytest.raises(OSError):
        D.distinct_step(store, 1, late, ["k"])
    D.distinct_step(StateStore(spark, path), 1, late, ["k"])
    D.distinct_step(StateStore(spark, path), 2, late.limit(0), ["k"])
    assert sorted(map(tuple, D.distinct_rows(spark, path).collect())) == [("a", 1), ("b", 3)]
