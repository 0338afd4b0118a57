"""Exact largest inner products, with candidates in buckets of similar length.

Vectors are sorted by length and cut into buckets of bounded size. Queries travel in blocks. A block first
meets the bucket of the longest vectors, which gives each query a score its k-th answer cannot fall below;
of the other buckets it visits only those whose length can still reach that score. Inside a bucket the
score becomes a local cosine threshold: a query skips the bucket if no cosine can reach it, reads only
the longest vectors if the threshold is weak, and otherwise only vectors whose coordinate at the query's
largest component lies where that cosine allows it. What is left is verified with exact integer products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeflow.session import cut


@dataclass(frozen=True)
class TopKParams:
    k: int = 20
    bucket_rows: int = 4096
    query_rows: int = 512  # of a block
    buckets_max: int = 100_000  # bounds what the driver holds of the buckets (their length); rows per bucket grow beyond
    weak: float = 0.05  # below this local threshold a coordinate rules out too little, and lengths are used
    slack: float = 1e-9  # of bounds in floating point; products are exact


RESULT = "query_id long, qkey long, vec_id long, score long"


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", factor: float = 64.0) -> DataFrame:
    """(id, v): floor(factor * x) of each component as a long. Rows without id or with a null vector, an empty
    one, or a null or non-finite component are left out; rows equal in both count once."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    kept = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * factor).cast("long")).alias("v")).distinct()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows; floating point only where it is exact."""
    if len(a) and len(b) and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def candidates(q: np.ndarray, floor: float, bucket: "Bucket", params: TopKParams) -> np.ndarray | None:
    """Rows of the bucket that may score ``floor`` or more with q; None if it has none."""
    size = float(np.sqrt(float((q.astype(np.float64) ** 2).sum())))
    if floor == -np.inf or size == 0:
        return np.arange(len(bucket.ids)) if floor <= 0 else None
    local = floor / (size * bucket.lengths[0]) if bucket.lengths[0] else (np.inf if floor > 0 else -1.0)
    if local > 1 + params.slack:
        return None
    if local <= 0:
        return np.arange(len(bucket.ids))
    if local < params.weak:
        return np.arange(int(np.searchsorted(-bucket.lengths, -floor / size * (1 - params.slack), side="right")))
    # unit vectors p with cosine >= local to the unit query u have p[f] within u[f] * local -+ sqrt((1 - u[f]^2) (1 - local^2))
    u = q / size
    f = int(np.argmax(np.abs(u)))
    room = np.sqrt(max(0.0, 1 - u[f] ** 2) * max(0.0, 1 - local**2)) + params.slack
    low, high = u[f] * local - room, u[f] * local + room
    if abs(u[f]) >= local:  # the axis itself lies in the cap, so the range goes to its end
        low, high = (low, 1 + params.slack) if u[f] > 0 else (-1 - params.slack, high)
    order, sorted_ = bucket.coordinate(f)
    return order[np.searchsorted(sorted_, low, side="left") : np.searchsorted(sorted_, high, side="right")]


class Bucket:
    """Vectors by descending length; unit coordinates are sorted when first asked for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.vectors, self.lengths, self._sorted = ids[order], vectors[order], lengths[order], {}

    def coordinate(self, f: int):
        if f not in self._sorted:
            unit = self.vectors[:, f] / np.where(self.lengths == 0, 1, self.lengths)
            order = np.argsort(unit, kind="stable")
            self._sorted[f] = order, unit[order]
        return self._sorted[f]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))][:k]
    return np.lexsort((ids, -scores))


def _search(r, params: TopKParams):
    """Top k of each query of a block within one bucket."""
    bucket = Bucket(np.frombuffer(r.ids, "<i8"), np.frombuffer(r.vectors, "<i8").reshape(-1, r.dim))
    queries, qids, qkeys, floors = np.frombuffer(r.queries, "<i8").reshape(-1, r.dim), np.frombuffer(r.qids, "<i8"), np.frombuffer(r.qkeys, "<i8"), np.frombuffer(r.floors, "<f8")
    out = []
    for q, i, key, floor in zip(queries, qids, qkeys, floors):
        rows = candidates(q, floor, bucket, params)
        if rows is None or not len(rows):
            continue
        rows = rows[bucket.ids[rows] != i]
        scores = products(bucket.vectors[rows], q[None, :])[:, 0]
        good = scores >= floor
        rows, scores = rows[good], scores[good]
        top = best(scores, bucket.ids[rows], params.k)
        out.append(np.stack((np.full(len(top), i), np.full(len(top), key), bucket.ids[rows[top]], scores[top])))
    return np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)


def _searched(batches, params):
    for pdf in batches:
        for r in pdf.itertuples():
            i, key, vec, score = _search(r, params)
            yield pd.DataFrame({"query_id": i, "qkey": key, "vec_id": vec, "score": score})


def _packed(name: str, schema: str, size: int):
    """Rows of a sorted partition in packs of at most ``size`` rows and one dimension; ids name the place."""
    def pack(batches):
        from pyspark import TaskContext

        task, seq, ids, vectors, keys = TaskContext.get().partitionId(), 0, [], [], []

        def full():
            v = np.array(vectors, "<i8")
            lengths = np.sqrt((v.astype(np.float64) ** 2).sum(1))
            return pd.DataFrame({name: [(task << 32) + seq], "dim": [v.shape[1]], "longest": [float(lengths.max())],
                                 "ids" if name == "bucket" else "qids": [np.array(ids, "<i8").tobytes()], "vectors" if name == "bucket" else "queries": [v.tobytes()],
                                 "qkeys": [np.array(keys, "<i8").tobytes()]})[[c.split()[0] for c in schema.split(", ")]]

        for pdf in batches:
            for i, key, v in zip(pdf["id"], pdf["key"], pdf["v"]):
                if ids and (len(ids) >= size or len(v) != len(vectors[0])):
                    yield full()
                    seq, ids, vectors, keys = seq + 1, [], [], []
                ids.append(i)
                vectors.append(v)
                keys.append(key)
        if ids:
            yield full()

    return pack


def top_products(rows: DataFrame, is_query, params: TopKParams = TopKParams(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest products of each query with vectors of other ids.

    ``is_query`` is a column over ``id``. Vectors are compared with those of their own dimension only. Ties
    go to the smaller vec_id. Rows with the same id but other vectors are each candidates, and each a query
    if asked for; they rank apart under one query_id. Scores that leave 64 bits wrap around. No valid rows
    give no result.
    """
    spark = rows.sparkSession
    sq = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    valid = cut(quantised(rows, vec_id, vector).select("id", "v", F.size("v").alias("dim"), sq.alias("sq"), F.xxhash64("v").alias("key")))
    n = valid.count()
    size = max(params.bucket_rows, -(-n // params.buckets_max))
    parts = max(1, -(-n // (4 * size)))
    by_length = valid.repartitionByRange(parts, F.col("dim"), F.col("sq").desc(), "key", "id").sortWithinPartitions("dim", F.desc("sq"), "key", "id")
    schema = "bucket long, dim int, longest double, ids binary, vectors binary"
    buckets = cut(by_length.select("id", "key", "v").mapInPandas(_packed("bucket", schema, size), schema))
    asked = valid.where(is_query)
    schema = "block long, dim int, longest double, qids binary, qkeys binary, queries binary"
    spread = max(1, -(-asked.count() // (4 * params.query_rows)))
    blocks = cut(asked.repartitionByRange(spread, "dim", F.col("sq").desc(), "key", "id").sortWithinPartitions("dim", F.desc("sq"), "key", "id")
                 .select("id", "key", "v").mapInPandas(_packed("block", schema, params.query_rows), schema))

    # lengths of the buckets: at most about buckets_max numbers
    known: dict[int, list[tuple[float, int]]] = {}
    for r in buckets.select("bucket", "dim", "longest").collect():
        known.setdefault(r["dim"], []).append((-r["longest"], r["bucket"]))
    for v in known.values():
        v.sort()
    lengths = {d: (np.array([-x for x, _ in v]), np.array([b for _, b in v], np.int64)) for d, v in known.items()}
    sent = spark.sparkContext.broadcast(lengths)

    def first_visit(batches):
        for pdf in batches:
            floors = [np.full(len(q) // 8, -np.inf).tobytes() for q in pdf["qids"]]
            yield pdf.assign(visit=[int(sent.value[d][1][0]) for d in pdf["dim"]], floors=floors)[["dim", "qids", "qkeys", "queries", "floors", "visit"]]

    fields = "dim int, qids binary, qkeys binary, queries binary, floors binary, visit long"
    search = lambda visits: visits.join(buckets.select("bucket", "ids", "vectors"), F.col("visit") == F.col("bucket")).drop("bucket", "visit").mapInPandas(
        lambda batches: _searched(batches, params), RESULT)
    seeds = cut(search(blocks.mapInPandas(first_visit, fields)))

    # the k-th score so far, for each query; then the buckets that can still reach it
    place = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    floors = seeds.withColumn("r", F.row_number().over(place)).where(F.col("r") == params.k).select("query_id", "qkey", F.col("score").alias("floor"))
    lone = asked.select("id", "key", "v", "dim", "sq").join(floors, (F.col("id") == F.col("query_id")) & (F.col("key") == F.col("qkey")), "left")
    lone = lone.repartitionByRange(spread, "dim", F.col("sq").desc(), "key", "id").sortWithinPartitions("dim", F.desc("sq"), "key", "id").select("id", "key", "v", "floor")

    def visits(batches):
        held: list = []

        def block(rows_):
            v = np.array([x for _, _, x, _ in rows_], "<i8")
            floor = np.array([-np.inf if f is None or f != f else f for *_, f in rows_], "<f8")
            size_ = np.sqrt((v.astype(np.float64) ** 2).sum(1))
            longest, names = sent.value[v.shape[1]]
            # a bucket is worth a visit if some query of the block can reach its floor there
            for k in range(1, len(names)):
                go = size_ * longest[k] * (1 + params.slack) >= floor
                if go.any():
                    yield pd.DataFrame({"dim": [v.shape[1]], "qids": [np.array([i for i, *_ in rows_], "<i8")[go].tobytes()], "qkeys": [np.array([x for _, x, *_ in rows_], "<i8")[go].tobytes()],
                                        "queries": [v[go].tobytes()], "floors": [floor[go].tobytes()], "visit": [int(names[k])]})

        for pdf in batches:
            for row in zip(pdf["id"], pdf["key"], pdf["v"], pdf["floor"]):
                if held and (len(held) >= params.query_rows or len(row[2]) != len(held[0][2])):
                    yield from block(held)
                    held = []
                held.append(row)
        if held:
            yield from block(held)

    more = search(lone.mapInPandas(visits, fields).repartition("visit"))
    ranked = seeds.unionByName(more).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= params.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
