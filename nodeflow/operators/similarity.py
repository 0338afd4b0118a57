"""Exact similarity join between two tables of vectors.

``match`` pairs each left row with right rows by cosine. Only rows that pass the caller's
``keep`` test leave a task, and with ``k`` set only the best k per left row do, so no pair
list of a group is ever written out.

Two physical ways, same result:

* the right side is counted first; up to ``Params.broadcast_bytes`` it is broadcast as one
  matrix and the left side is only scanned (no shuffle);
* beyond that, both sides are cut into large tiles of bounded size that meet in groups. Where
  the threshold allows it, right rows lie in cells around pivots and a left row visits only
  the cells whose range of angles can hold a partner: for unit vectors,
  |angle(l,p) - angle(r,p)| <= angle(l,r). Rows that visit a hot cell are salted. The visits
  are counted first; if cells save too little, every pair of tiles meets once instead.

Where only the best k count, equal vectors are compared once: of equal right rows those with the smallest
ids go in, one left row stands for all with its vector, and its partners are handed to them.

Inside a task, pairs are ruled out by prefixes: along the principal axes of the right rows, the
product of the first coordinates plus the product of the two tail norms is a bound on the whole
product (Cauchy-Schwarz). Only pairs whose bound passes are multiplied out, so nothing is lost.
The axes come from a sample of the task's own right rows and decide the cost alone; where the
sample or the blocks seen so far show no gain, whole blocks are multiplied as before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from nodeflow.params import Params
from nodeflow.session import cut

DECIMALS = 9  # similarities are compared after rounding, so a sum's order cannot flip a threshold
_CHUNK = 500_000  # similarities held at once per task; keep and score make a dozen arrays of this size
_EPS = 1e-6
_SLICE = 8192  # left rows of a group that are taken to the kernel at once
_COPY = 512  # similarities that cost about as much as sending one row to a task
_PAYS = 0.7  # cells are used when they cost at most this share of all pairs of tiles
_WIDTH = 4096  # right rows of a block
_SAMPLE = 2048  # right rows that choose the axes
_GATHER = 20  # a pair on its own costs about as much as this many pairs of a block
_GAIN = 0.5  # prefixes are used when they cost at most this share of whole blocks
_FEW = 1024  # right rows up to which copies of vectors and the number of tasks do not matter
_COPIES = 0.5  # equal vectors are compared once when at most this share of the rows differ
_TASK_PAIRS = 2 ** 28  # pairs of one task beside a broadcast


@dataclass(frozen=True)
class Spec:
    """What to keep of all similarities.

    keep(sim, L, R) -> mask and score(sim, L, R) -> scores get arrays of shape [left, right];
    L and R map attribute names to column vectors / row vectors, plus ``norm``.
    ``pairs``: "all", "other" (ids differ) or "after" (right id > left id).
    ``hash_ties``: equal scores are ordered by a symmetric hash of the pair instead of the
    right id; chains of equal pairs then resolve in few rounds.
    ``rising``: no pair with a larger similarity, all else equal, fails ``keep`` or has a smaller score
    than this one; a bound on the similarity then bounds both. False keeps prefixes out.
    """

    floor: float = -1.0  # no kept pair has a smaller similarity
    keep: Callable | None = None
    score: Callable | None = None
    k: int | None = 1
    pairs: str = "all"
    hash_ties: bool = False
    left_attrs: tuple[str, ...] = ()
    right_attrs: tuple[str, ...] = ()
    carry: tuple[str, ...] = ()
    counts: tuple[float, ...] = field(default=())
    floor_attr: str | None = None  # right attribute whose minimum is the floor
    rising: bool = True


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(size == 0, 1.0, size)[:, None], size


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of a column, each of length 1."""
    return _unit(_matrix(column))[0]


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarities of unit vectors as ``match`` compares them."""
    return np.round(left @ right.T, DECIMALS)


def _ordered_unit(column: pa.ChunkedArray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms of the rows in ``order``. Chunks are read one by one, so beside the column there is one
    matrix only."""
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    unit, size, at = None, np.empty(len(order)), 0
    for chunk in column.chunks:
        for a in range(0, len(chunk), 1024):
            part, norms = _unit(_matrix(chunk.slice(a, 1024)))
            if unit is None:
                unit = np.empty((len(order), part.shape[1]))
            here = place[at:at + len(part)]
            unit[here], size[here] = part, norms
            at += len(part)
    return (np.empty((0, 1)) if unit is None else unit), size


def _attrs(table, names) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch)
            else table.column(c).to_numpy() for c in names}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class _Side:
    """The right rows of one task, ordered by id."""

    unit: np.ndarray
    ids: np.ndarray
    attrs: dict
    hash: np.ndarray
    out: pa.Table
    axes: np.ndarray | None = None  # leading principal axes, if prefixes pay
    short: np.ndarray | None = None  # the rows along them
    tail: np.ndarray | None = None  # norms of the rest
    spent: int = 0  # coordinates multiplied so far


def _shorten(unit: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    short = unit @ axes
    rest = np.einsum("ij,ij->i", unit, unit) - np.einsum("ij,ij->i", short, short)
    return short, np.sqrt(np.maximum(rest, 0.0))


def _bound(short, tail, right_short, right_tail) -> np.ndarray:
    bound = short @ right_short.T
    bound += np.outer(tail, right_tail)
    bound += _EPS
    return bound


def _axes(unit: np.ndarray, attrs: dict, spec: Spec) -> np.ndarray | None:
    """The principal axes to use as a prefix, judged by pairs of a sample; None where prefixes do not pay."""
    m, dim = unit.shape
    if not spec.rising or m <= _WIDTH:
        return None
    at = np.arange(0, m, -(-m // _SAMPLE))
    some = unit[at]
    axes = np.linalg.eigh(some.T @ some)[1][:, ::-1]
    probe, rest = at[::16], np.delete(at, np.s_[::16])
    theirs = {c: v[:, rest] for c, v in attrs.items()}
    mine = {"norm": np.ones((1, 1))}
    known = not spec.left_attrs  # else keep and score cannot be judged here, only the floor

    def passing(sim, least):
        mask = sim >= spec.floor
        if known and spec.keep is not None:
            mask &= spec.keep(sim, mine, theirs)
        if known and spec.k is not None:
            score = sim if spec.score is None else np.broadcast_to(spec.score(sim, mine, theirs), sim.shape)
            if least is None:
                usable = np.where(mask, score, -np.inf)
                return np.partition(usable, max(0, usable.shape[1] - spec.k), axis=1)[:, [max(0, usable.shape[1] - spec.k)]]
            mask &= score >= least
        return mask

    least = passing(unit[probe] @ unit[rest].T, None) if known and spec.k is not None else -np.inf
    best, chosen = _GAIN * dim, None
    for n in (2 ** e for e in range(2, dim.bit_length()) if 2 ** e < dim):
        head = np.ascontiguousarray(axes[:, :n])
        share = passing(_bound(*_shorten(unit[probe], head), *_shorten(unit[rest], head)), least).mean()
        cost = n + share * _GATHER * dim
        if cost <= best:
            best, chosen = cost, head
    return chosen


def _side_parts(table: pa.Table, spec: Spec) -> tuple:
    """Fields of a _Side as plain arrays, which a broadcast can carry to workers without this package."""
    narrow = table.drop_columns(["rvec"]).combine_chunks()
    order = pc.sort_indices(narrow, [("rid", "ascending")])
    narrow = narrow.take(order)
    unit, size = _ordered_unit(table.column("rvec"), order.to_numpy())
    attrs = {c: v[None, :] for c, v in _attrs(narrow, spec.right_attrs).items()}
    attrs["norm"] = size[None, :]
    hashes = narrow.column("rhash").to_numpy().astype(np.int64).view(np.uint64)
    axes = _axes(unit, attrs, spec)
    short, tail = (None, None) if axes is None else _shorten(unit, axes)
    return unit, narrow.column("rid").to_numpy(), attrs, hashes, narrow.select(["rid", *spec.carry]), axes, short, tail


def _column(table, name: str) -> np.ndarray:
    column = table.column(name)
    return column.to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else column.to_numpy()


def _products(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Similarities of single pairs, ordered by i. ``room`` takes the partners of one left row."""
    out = np.empty(len(i))
    ends = np.searchsorted(i, np.arange(len(left) + 1))
    for row in np.unique(i):
        lo, hi = ends[row], ends[row + 1]
        partners = np.take(right, j[lo:hi], axis=0, out=room[:hi - lo], mode="clip")
        np.dot(partners, left[row], out=out[lo:hi])
    return np.round(out, DECIMALS)


def _judge(spec: Spec, sim: np.ndarray, mine: dict, theirs: dict) -> tuple[np.ndarray, np.ndarray]:
    """(mask, scores) of similarities or of bounds on them."""
    mask = sim >= spec.floor
    if spec.keep is not None:
        mask &= spec.keep(sim, mine, theirs)
    return mask, sim if spec.score is None else np.broadcast_to(spec.score(sim, mine, theirs), sim.shape)


def _found(left, right: _Side, spec: Spec):
    """Yield (left places, right places, similarities, scores, ties) of slices of the left rows, the best k only
    where k is set. The right side is taken block by block; the k-th best score so far is a floor for the next."""
    n, m = left.num_rows, len(right.ids)
    if n == 0 or m == 0:
        return
    unit, size = _unit(_matrix(left.column("lvec")))
    dim = unit.shape[1]
    attrs = {**_attrs(left, spec.left_attrs), "norm": size}
    if spec.pairs != "all":
        lids = _column(left, "lid")
        first, after = np.searchsorted(right.ids, lids, side="left"), np.searchsorted(right.ids, lids, side="right")
    lhash = _column(left, "lhash").astype(np.int64).view(np.uint64) if spec.hash_ties else None
    short, tail = (None, None) if right.axes is None else _shorten(unit, right.axes)
    k = None if spec.counts else spec.k
    width = min(m, _WIDTH)
    step = max(1, (2 if k is not None and k > 1 else 1) * _CHUNK // width)  # lists of partners cost more a step
    room = None if short is None else np.empty((width, dim))
    cost = gain = 0.0  # of the prefixes: coordinates multiplied with them, and without
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        mine = {c: v[lo:hi, None] for c, v in attrs.items()}
        least = np.full(hi - lo, -np.inf)
        kept = None
        for a in range(0, m, width):
            b = min(m, a + width)
            theirs = {c: v[:, a:b] for c, v in right.attrs.items()}
            shape = (hi - lo, b - a)
            allowed = None
            if spec.pairs == "after":
                allowed = np.arange(a, b)[None, :] >= after[lo:hi, None]
            elif spec.pairs == "other":
                cols = np.arange(a, b)[None, :]
                allowed = (cols < first[lo:hi, None]) | (cols >= after[lo:hi, None])
            single = False
            if short is not None and cost <= _GAIN * gain + 8 * dim * step * width and (k is None or a):
                mask, score = _judge(spec, _bound(short[lo:hi], tail[lo:hi], right.short[a:b], right.tail[a:b]), mine, theirs)
                mask = mask if allowed is None else mask & allowed
                if k is not None:
                    mask &= score >= least[:, None]
                i, j = np.nonzero(mask)
                single = len(i) * _GATHER <= mask.size
                prefix = short.shape[1] * mask.size
                right.spent += prefix + (len(i) * dim if single else 0)
                cost += prefix + dim * (len(i) * _GATHER if single else mask.size)
                gain += dim * mask.size
            if single:
                sim = _products(unit[lo:hi], right.unit[a:b], i, j, room)
                mask, score = _judge(spec, sim, {c: v[i, 0] for c, v in mine.items()}, {c: v[0, j] for c, v in theirs.items()})
                if k is not None:
                    mask &= score >= least[i]
                i, j, sim, score = i[mask], j[mask], sim[mask], score[mask].astype(np.float64)
            else:
                right.spent += dim * shape[0] * shape[1]
                sim = cosines(unit[lo:hi], right.unit[a:b])
                mask, score = _judge(spec, sim, mine, theirs)
                mask = mask if allowed is None else mask & allowed
                if k is not None:
                    mask &= score >= least[:, None]
                    if k < shape[1]:
                        usable = np.where(mask, score, -np.inf)
                        mask &= usable >= -np.partition(-usable, k - 1, axis=1)[:, [k - 1]]
                i, j = np.nonzero(mask)
                sim, score = sim[i, j], score[i, j].astype(np.float64)
            tie = np.zeros(len(i), dtype=np.int64)
            if spec.hash_ties:
                tie = (_mix(lhash[lo + i] + right.hash[a + j]) >> np.uint64(1)).astype(np.int64)
            new = (i, a + j, sim, score, tie)
            if k is None:
                if len(i):
                    yield (lo + i, *new[1:])
                continue
            if len(i):
                kept = new if kept is None else tuple(np.concatenate(x) for x in zip(kept, new))
                i, j, sim, score, tie = kept
                order = np.lexsort((j, tie, -score, i))
                start = np.r_[True, np.diff(i[order]) != 0]
                rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
                last = order[rank == k - 1]
                least[i[last]] = score[last]
                kept = tuple(x[order[rank < k]] for x in kept)
        if kept is not None:
            yield (lo + kept[0], *kept[1:])


def _best(left, right: _Side, spec: Spec) -> Iterator[pa.RecordBatch]:
    for i, j, sim, score, tie in _found(left, right, spec):
        taken = right.out.take(pa.array(j))
        lid = left.column("lid").take(pa.array(i))
        names = ["lid", "rid", "sim", "score", "tie", *spec.carry]
        data = [lid, taken.column("rid"), pa.array(sim), pa.array(score), pa.array(tie),
                *[taken.column(c) for c in spec.carry]]
        yield from pa.table(dict(zip(names, data))).combine_chunks().to_batches()


def _count(left, right: _Side, spec: Spec) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(spec.counts), dtype=np.int64)
    for _, _, sim, _, _ in _found(left, right, spec):
        total += np.array([(sim >= t).sum() for t in spec.counts], dtype=np.int64)
    yield pa.RecordBatch.from_pydict({"threshold": pa.array(spec.counts, pa.float64()), "n": pa.array(total)})


def _schema(left: DataFrame, right: DataFrame, spec: Spec) -> T.StructType:
    if spec.counts:
        return T.StructType([T.StructField("threshold", T.DoubleType()), T.StructField("n", T.LongType())])
    fields = [T.StructField("lid", left.schema["lid"].dataType), T.StructField("rid", right.schema["rid"].dataType),
              T.StructField("sim", T.DoubleType()), T.StructField("score", T.DoubleType()),
              T.StructField("tie", T.LongType())]
    return T.StructType(fields + [T.StructField(c, right.schema[c].dataType) for c in spec.carry])


def _prepare(df: DataFrame, side: str, attrs: tuple[str, ...], dim: int) -> DataFrame:
    vec = F.col(f"{side}vec")
    if df.schema[f"{side}vec"].dataType not in (T.ArrayType(T.FloatType(), n) for n in (True, False)):
        vec = vec.cast("array<double>")  # floats travel as they are; the kernel widens them
    return df.where(F.size(f"{side}vec") == dim).select(
        f"{side}id", vec.alias(f"{side}vec"), *dict.fromkeys(attrs), F.xxhash64(f"{side}id").alias(f"{side}hash"))


def match(left: DataFrame, right: DataFrame, spec: Spec, params: Params) -> DataFrame:
    """left(lid, lvec, attrs), right(rid, rvec, attrs) -> (lid, rid, sim, score, tie, carry)."""
    left = _prepare(left, "l", spec.left_attrs, params.dim)
    right = _prepare(right, "r", spec.right_attrs + spec.carry, params.dim)
    n_right, floor, beside = _measured(right, spec)
    if n_right == 0 and not spec.counts:
        return _none(left, right, spec)
    if spec.floor_attr and floor is not None:
        spec = replace(spec, floor=floor)
    n_left = None
    if n_right > _FEW:
        right = cut(right)
        few = _once(right, spec)
        if few is not None:
            right = few
            n_right, _, beside = _measured(right, spec)
        different = F.lit(0) if spec.left_attrs or not _collapses(spec) else F.approx_count_distinct(F.xxhash64("lvec"))
        n_left, n_vectors = left.agg(F.count("*"), different).first()
        if 0 < n_vectors <= _COPIES * n_left:
            return _for_copies(left, right, n_right, beside, spec, params)
    return _matched(left, right, n_left, n_right, beside, spec, params)


def _none(left: DataFrame, right: DataFrame, spec: Spec) -> DataFrame:
    """No pairs; the left rows are not read for it."""
    return left.where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in _schema(left, right, spec).fields])


def _measured(right: DataFrame, spec: Spec) -> tuple[int, float | None, int]:
    """Rows, lowest floor and bytes beside the vectors: one job over the narrow columns, vectors are not computed for it."""
    lowest = F.min(spec.floor_attr) if spec.floor_attr else F.lit(spec.floor)
    other = [F.octet_length(F.col(c).cast("string")) for c in right.columns if c not in ("rvec", "rhash")]
    beside = sum((F.coalesce(n, F.lit(0)) for n in other), F.lit(8))
    return tuple(right.agg(F.count("*"), lowest, F.coalesce(F.sum(beside), F.lit(0))).first())


def _collapses(spec: Spec) -> bool:
    """Whether equal vectors with equal attributes have the same partners: scores say nothing of ids, and only the best k count."""
    return spec.k is not None and not spec.counts and not spec.hash_ties and spec.pairs != "after"


def _once(right: DataFrame, spec: Spec) -> DataFrame | None:
    """Of equal right rows those with the smallest ids, as many as one left row can take (one more where its own does
    not count); None if most rows differ anyway."""
    if not _collapses(spec):
        return None
    same = ["rvec", *dict.fromkeys(spec.right_attrs)]
    n, n_different = right.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*same))).first()
    if n_different > _COPIES * n:
        return None
    place = F.row_number().over(W.partitionBy(*same).orderBy("rid"))  # cut off before the shuffle as well
    return cut(right.withColumn("_place", place).where(F.col("_place") <= spec.k + (spec.pairs == "other")).drop("_place"))


def _for_copies(left: DataFrame, right: DataFrame, n_right: int, beside: int, spec: Spec, params: Params) -> DataFrame:
    """One left row stands for all with its vector; its partners are handed to these."""
    schema = _schema(left, right, spec)
    stands = cut(left.groupBy("lvec").agg(F.min("lid").alias("lid")).withColumn("lhash", F.xxhash64("lid")))
    n_stands = stands.count()
    wide = replace(spec, k=spec.k + (spec.pairs == "other"), pairs="all")
    found = _matched(stands, right, n_stands, n_right, beside, wide, params)
    partner = F.struct((-F.col("score")).alias("worst"), "tie", "rid", *[F.col(c) for c in ("sim", "score", *spec.carry)])
    lists = found.groupBy("lid").agg(F.array_sort(F.collect_list(partner)).alias("partners"))
    lists = stands.select("lid", "lvec").join(lists, "lid").select("lvec", "partners")
    if n_stands * params.dim * 8 <= params.broadcast_bytes // 8:
        lists = F.broadcast(lists)  # no shuffle, so many copies of one vector stay spread
    partners = F.col("partners")
    if spec.pairs == "other":
        partners = F.filter(partners, lambda x: ~x["rid"].eqNullSafe(F.col("lid")))
    return left.select("lid", "lvec").join(lists, "lvec").select("lid", F.inline(F.slice(partners, 1, spec.k))).select(*schema.names)


def _matched(left: DataFrame, right: DataFrame, n_left: int | None, n_right: int, beside: int, spec: Spec, params: Params) -> DataFrame:
    schema = _schema(left, right, spec)
    if n_right * params.dim * 8 + beside <= params.broadcast_bytes:
        tasks = min(n_left or 0, math.ceil((n_left or 0) * n_right / _TASK_PAIRS))
        return _broadcast(left if tasks <= 1 else left.repartition(tasks, "lid"), right, spec, schema)
    parts = _tiled(left, cut(right) if n_left is None else right, n_right, spec, schema, params)
    if spec.counts:
        return parts
    if spec.k is None:
        return parts
    if spec.k == 1:
        rest = [F.col(c) for c in ("sim", "score", *spec.carry)]
        best = F.min(F.struct((-F.col("score")).alias("worst"), "tie", "rid", *rest)).alias("b")
        return parts.groupBy("lid").agg(best).select("lid", *[f"b.{c}" for c in schema.names[1:]])
    order = W.partitionBy("lid").orderBy(F.desc("score"), "tie", "rid")
    return parts.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= spec.k).drop("_rn")


def _broadcast(left: DataFrame, right: DataFrame, spec: Spec, schema: T.StructType) -> DataFrame:
    parts = left.sparkSession.sparkContext.broadcast(_side_parts(right.toArrow(), spec))
    kernel = _count if spec.counts else _best

    def run(batches):
        side = _Side(*parts.value)
        for batch in batches:
            yield from kernel(batch, side, spec)

    return left.mapInArrow(run, schema)


def _tiled(left: DataFrame, right: DataFrame, n_right: int, spec: Spec, schema: T.StructType,
           params: Params) -> DataFrame:
    """Tiles of both sides meet in groups. The number of copies of a row is that of the tiles it visits."""
    bound = max(1, params.tile_bytes // (8 * params.dim))
    tile_rows, group_rows = min(params.tile_rows, bound), min(params.group_rows, bound)
    dealt = None
    if spec.floor > 0 or spec.floor_attr:
        dealt = _by_cell(left, right, n_right, spec, params, tile_rows, group_rows)
    queries, targets = dealt or _by_grid(left, right, n_right, tile_rows, group_rows)
    keys = ["cell", "tile", "salt"]
    kernel = _count if spec.counts else _best
    arrow_schema = to_arrow_schema(schema)
    empty = {f.name: [] for f in schema.fields}

    def run(l_table: pa.Table, r_table: pa.Table) -> pa.Table:
        if not l_table.num_rows or not r_table.num_rows:
            return pa.table(empty, schema=arrow_schema)
        side = _Side(*_side_parts(r_table, spec))
        found = [b for at in range(0, l_table.num_rows, _SLICE)
                 for b in kernel(l_table.slice(at, _SLICE).combine_chunks(), side, spec)]
        return pa.Table.from_batches(found, schema=arrow_schema)

    return queries.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInArrow(run, schema)


def _by_grid(left: DataFrame, right: DataFrame, n_right: int, tile_rows: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """Every tile of the left side meets every tile of the right side once."""
    tiles, salts = max(1, math.ceil(n_right / tile_rows)), max(1, math.ceil(left.count() / group_rows))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cell = F.lit(0).alias("cell")
    return (left.select("*", cell, every(tiles).alias("tile"), F.pmod("lhash", F.lit(salts)).cast("int").alias("salt")),
            right.select("*", cell, F.pmod("rhash", F.lit(tiles)).cast("int").alias("tile"), every(salts).alias("salt")))


def _by_cell(left: DataFrame, right: DataFrame, n_right: int, spec: Spec, params: Params,
             tile_rows: int, group_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """Rows meet in cells around pivots; None if the cells rule out too little to pay for themselves."""
    spark = left.sparkSession
    n_pivots = max(1, min(params.max_pivots, math.ceil(16 * n_right / tile_rows)))
    heads = right.select("rvec", "rhash", "rid").orderBy("rhash", "rid").limit(n_pivots).toArrow()
    pivots = spark.sparkContext.broadcast(_unit(_matrix(heads.column("rvec")))[0])

    def place(batches):
        for b in batches:
            if b.num_rows:
                angle = np.arccos(np.clip(_unit(_matrix(b.column("rvec")))[0] @ pivots.value.T, -1, 1))
                cell = angle.argmin(axis=1)
                yield b.append_column("cell", pa.array(cell, pa.int32())).append_column(
                    "angle", pa.array(angle[np.arange(len(cell)), cell]))

    placed = right.mapInArrow(place, T.StructType(
        right.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))
    # at most max_pivots rows come back here; each cell has a floor of its own
    lowest = F.coalesce(F.min(spec.floor_attr), F.lit(spec.floor)) if spec.floor_attr else F.lit(spec.floor)
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"),
                                       lowest.alias("floor")).collect()
    reach = np.arccos(np.clip([c.floor - 10.0 ** -DECIMALS for c in cells], -1, 1)) + _EPS
    ids = np.array([c.cell for c in cells])
    low = np.array([c.lo for c in cells]) - reach
    high = np.array([c.hi for c in cells]) + reach

    def reachable(b):
        angle = np.arccos(np.clip(_unit(_matrix(b.column("lvec")))[0] @ pivots.value.T, -1, 1))[:, ids]
        return (angle >= low[None, :]) & (angle <= high[None, :])

    def visits(batches):
        for b in batches:
            if b.num_rows:
                total = np.append(reachable(b).sum(axis=0), b.num_rows)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(np.append(ids, -1), pa.int32()), "n": pa.array(total, pa.int64())})

    def visit(batches):
        for b in batches:
            if b.num_rows:
                i, c = np.nonzero(reachable(b))
                for at in range(0, len(i), 10_000):
                    part = b.take(pa.array(i[at:at + 10_000]))
                    yield part.append_column("cell", pa.array(ids[c[at:at + 10_000]], pa.int32()))

    load = {r.cell: r.n for r in left.mapInArrow(visits, "cell int, n bigint").groupBy("cell").agg(
        F.sum("n").alias("n")).collect()}
    n_left = load.pop(-1, 0)
    # one small row per cell (at most max_pivots), made per side so that column ids stay apart
    plan = [(int(c.cell), max(1, math.ceil(c.n / tile_rows)), max(1, math.ceil(load.get(c.cell, 0) / group_rows)))
            for c in cells]
    cost = sum(load.get(c.cell, 0) * (c.n + _COPY * tiles) + _COPY * c.n * salts for c, (_, tiles, salts) in zip(cells, plan))
    if cost > _PAYS * (n_left * (n_right + _COPY * math.ceil(n_right / tile_rows)) + _COPY * n_right * math.ceil(n_left / group_rows)):
        return None
    plan_left, plan_right = (spark.createDataFrame(plan, "cell int, tiles int, salts int") for _ in "lr")
    visiting = left.mapInArrow(visit, T.StructType(left.schema.fields + [T.StructField("cell", T.IntegerType())]))
    queries = visiting.join(F.broadcast(plan_left), "cell").select(
        *visiting.columns,
        F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"),
        F.pmod("lhash", "salts").cast("int").alias("salt"))
    targets = placed.join(F.broadcast(plan_right), "cell").select(
        *placed.columns,
        F.pmod("rhash", "tiles").cast("int").alias("tile"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return queries, targets
