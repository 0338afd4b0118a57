"""Near-duplicate documents by SimHash and multi-index hashing.

The 64 bits of a fingerprint are read as two segments of 32. Fingerprints that differ in at most three bits
differ in at most one bit of some segment, so each distinct fingerprint probes the table of each segment
with the 33 values of its Hamming ball of radius one, and whole distances are verified on what it finds.
A bucket sends the links of a spanning forest of its verified pairs, never all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from nodeflow.llm.base import hash128
from nodeflow.llm.components import components
from nodeflow.session import cut

RADIUS = 3
HALF = 32


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42, step: int = 1 << 16) -> int:
    """Bit b is set if it is set in over half of the XXH64 values of the shingles; 0 without words."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= shingle:
        return h(joined, seed)
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)))
    n = len(found) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, step):
        first, last = starts[at : min(n, at + step)].tolist(), (starts[at + shingle : min(n, at + step) + shingle] - 1).tolist()
        values = np.fromiter((h(joined[i:j], seed) for i, j in zip(first, last)), np.uint64, len(first))
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    values = np.fromiter((fingerprint_of(t) for t in texts), np.uint64, len(texts))
    return pd.Series(values.view(np.int64))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def bucket_links(fps: np.ndarray, own: np.ndarray, radius: int, tile: int = 1024) -> list[tuple[int, int]]:
    """Spanning forest of the verified pairs (table row, any row) of one bucket, compared in tiles."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out, base = [], np.unique(fps[own])
    every = np.unique(fps)
    for i in range(0, len(base), tile):
        a = base[i : i + tile]
        for j in range(0, len(every), tile):
            b = every[j : j + tile]
            x, y = np.nonzero(_bits(a[:, None] ^ b[None, :]) <= radius)
            for p, q in zip(a[x].tolist(), b[y].tolist()):
                if p != q and (r := root(p)) != (s := root(q)):
                    parent[max(r, s)] = min(r, s)
                    out.append((p, q))
    return out


def near_links(fingerprints: DataFrame, fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints at most ``radius`` (up to 3) bits apart, enough to connect
    all that are linked. Nulls are ignored."""
    if radius > 3:
        raise ValueError("two segments with balls of radius one reach distance 3")
    distinct = fingerprints.select(F.col(fp).alias("fp")).where("fp IS NOT NULL").distinct()
    low = F.col("fp").bitwiseAND(F.lit(2**HALF - 1))
    high = F.shiftrightunsigned("fp", HALF)
    segments = F.explode(F.array(F.struct(F.lit(0).alias("seg"), low.alias("value")), F.struct(F.lit(1).alias("seg"), high.alias("value")))).alias("s")
    split = distinct.select("fp", segments).select("fp", "s.seg", "s.value")
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(HALF)])
    probes = split.select("fp", "seg", "value", F.explode(ball).alias("flip")).select(
        "fp", F.col("value").bitwiseXOR(F.col("flip")).bitwiseOR(F.shiftleft(F.col("seg").cast("long"), HALF)).alias("bucket"), (F.col("flip") == 0).alias("own"))

    def link(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            b = pdf["bucket"].to_numpy()
            last = int(np.searchsorted(b, b[-1])) if len(b) else 0  # the last bucket may go on in the next batch
            rest = pdf.iloc[last:]
            yield from _found(pdf.iloc[:last])
        if rest is not None:
            yield from _found(rest)

    def _found(pdf):
        if len(pdf) < 2:
            return
        b, fps, own = pdf["bucket"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["own"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        ends = np.append(starts[1:], len(b))
        tables = np.add.reduceat(own.astype(np.int64), starts)
        links = [x for s, e in zip(starts[(tables > 0) & (ends - starts > 1)], ends[(tables > 0) & (ends - starts > 1)]) for x in bucket_links(fps[s:e], own[s:e], radius)]
        pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    sorted_probes = probes.repartition("bucket").sortWithinPartitions("bucket")
    return sorted_probes.mapInPandas(link, "a long, b long").distinct()


def near_duplicates(rows: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id, k1, k2): one row per row of ``rows``; component_id is the smallest doc_id
    that links reach, the own one included.

    Null, empty and blank texts have fingerprint 0 and link like any other. A null doc_id stays null and is
    never the smallest unless all are null. Repeated rows stay. k1 and k2 hash id and text.
    """
    k1, k2 = hash128(doc_id, text)
    marked = cut(rows.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp"), k1, k2))
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(near_links(marked)).select(F.col("node").alias("fp"), "root")
    rooted = first.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id", "root")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", "root", "k1", "k2")


def keep_one(rows: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component: the one with the smallest doc_id (nulls last, ties by a hash of the text;
    then by a hash of all columns). All columns stay."""
    found = near_duplicates(rows, text, doc_id)
    picked = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("p"))
    keys = picked.select(F.col("p.k1").alias("_p1"), F.col("p.k2").alias("_p2"))
    k1, k2 = hash128(doc_id, text)
    # a row travels as one column, so its names cannot clash; of rows equal in id and text the smallest stays
    known = [f.name for f in rows.schema if f.dataType.typeName() != "map"]  # maps have no hash
    own = rows.select(k1.alias("_k1"), k2.alias("_k2"), F.xxhash64(*known).alias("_h"), F.struct("*").alias("_row"))
    kept = own.join(keys, (F.col("_k1") == F.col("_p1")) & (F.col("_k2") == F.col("_p2")))
    return kept.groupBy("_k1", "_k2").agg(F.min_by("_row", "_h").alias("_row")).select("_row.*")
