"""Benchmark passages inside documents.

Every run of words that is as long as a benchmark item is a window; a document with fewer words than the item
is one window as a whole. A window counts as a copy of the item when their word shingles, weighted by how often they occur, are similar enough (sum of minima over sum of
maxima). Windows get a SimHash fingerprint of their words; the fingerprints of the items are looked up in
Hamming blocks: 64 bits are cut into four blocks, and of a pair at most ``RADIUS`` = 15 bits apart one
block differs in at most three bits, so a table of the balls of radius three around each item's blocks finds
every such pair. Pairs farther apart are found when one block is that near. All that are found are verified
by their similarity, whatever their distance. Everything is DataFrame code.

Windows without enough shingles of items of their length cannot reach the similarity and are never
fingerprinted: with threshold t and m shingles a window needs at least t * m of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeflow.llm.base import hash128, sized


@dataclass(frozen=True)
class DecontaminationParams:
    shingle: int = 5
    similarity: float = 0.8
    broadcast_shingles: int = 2_000_000  # item shingles up to which they are broadcast (16 bytes each)
    broadcast_balls: int = 1_000_000  # entries of the items' balls up to which they are broadcast (about 140 bytes each)


BLOCKS, BLOCK_BITS, BALL = 4, 16, 3
RADIUS = BLOCKS * (BALL + 1) - 1  # up to it every pair is found


def _word_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower-cased."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


def _shingles(hashes: str, width: int) -> Column:
    at = F.col(hashes)
    starts = F.when(F.size(at) >= width, F.sequence(F.lit(0), F.size(at) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[at[i + k] for k in range(width)]))


def _simhash(hashes: Column) -> Column:
    """64 bits, each set when over half of the hashes have it."""
    def ones(b):
        return F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))

    def place(b):
        return F.call_function("shiftleft", F.lit(1).cast("long"), b)

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
                       lambda bits, b: F.when(ones(b) * 2 > F.size(hashes), bits.bitwiseOR(place(b))).otherwise(bits))


def _blocks(fp: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(fp, BLOCK_BITS * b).bitwiseAND(F.lit(2**BLOCK_BITS - 1)).bitwiseOR(F.lit(b << BLOCK_BITS)) for b in range(BLOCKS)])


def _common(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    def times(x, v):
        return F.size(F.filter(x, lambda y: y == v))

    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, v: s + F.least(times(a, v), times(b, v)))


def matches(docs: DataFrame, items: DataFrame, params: DecontaminationParams = DecontaminationParams(), text: str = "text", doc_id: str = "doc_id",
            item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, similarity, k1, k2): one row for each document and item it copies.

    ``start`` is the word at which the most similar window begins (the first of equals). Items with fewer
    words than a shingle are one shingle as a whole; items and documents without words never match. Nulls in
    ids pass through; rows with the same id and text report once. Empty tables give an empty result.
    """
    known = items.select(F.col(item_id).alias("item_id"), _word_hashes(F.col(item_text)).alias("iw")).where(F.size("iw") > 0)
    known = known.withColumn("n", F.size("iw")).withColumn("w", F.least("n", F.lit(params.shingle)))
    sizes = known.groupBy("w").agg(F.sum(F.col("n") - F.col("w") + 1).alias("shingles"), F.count("*").alias("items")).collect()
    k1, k2 = hash128(doc_id, text)
    hashed = docs.select(F.col(doc_id).alias("doc_id"), k1, k2, _word_hashes(F.col(text)).alias("wh"))
    found = [_of_width(hashed, known.where(F.col("w") == r["w"]).drop("w"), r["w"], r["shingles"], r["items"], params) for r in sizes]
    empty = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, similarity double, k1 long, k2 long")
    if not found:
        return empty
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _of_width(docs: DataFrame, items: DataFrame, width: int, shingles: int, n_items: int, params: DecontaminationParams) -> DataFrame:
    items = items.withColumn("ish", _shingles("iw", width))
    wanted = items.select("n", F.explode("ish").alias("h")).distinct()
    if shingles <= params.broadcast_shingles:
        wanted = F.broadcast(wanted)
    m = F.col("n") - (width - 1)
    need = F.ceil(m * params.similarity - 1e-9).cast("int")

    # where a document holds shingles of items, by item length
    hits = docs.select("k1", "k2", F.posexplode(_shingles("wh", width)).alias("p", "h")).join(wanted, "h")
    listed = hits.groupBy("k1", "k2", "n").agg(F.array_sort(F.collect_set("p")).alias("ps")).withColumn("m", m).withColumn("need", need)
    # starts of windows that hold enough of them
    slack = F.transform("ps", lambda p, i: F.struct(p.alias("p"), (F.col("m") - 1 - (F.get(F.col("ps"), i + F.col("need") - 1) - p)).alias("room")))
    starts = F.transform(F.filter(slack, lambda x: x["room"] >= 0),
                         lambda x: F.sequence(F.greatest(x["p"] - F.least(x["room"], F.col("m") - F.col("need")), F.lit(0)), x["p"]))
    listed = listed.select("k1", "k2", "n", F.array_distinct(F.flatten(starts)).alias("starts")).where(F.size("starts") > 0)

    # few documents hold enough: the others need not move to meet them
    placed = listed.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "n", "starts")
    placed = sized(placed, 64 + 4 * F.size("starts"))
    at = docs.join(placed, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
    # a shorter document is one window from its first word; the starts above hold 0 whenever it has enough shingles
    whole = (F.col("start") == 0) & (F.size("wh") < F.col("n"))
    cutouts = at.select("doc_id", "k1", "k2", "n", "wh", F.explode("starts").alias("start")).where((F.col("start") + F.col("n") <= F.size("wh")) | whole)
    cutouts = cutouts.select("doc_id", "k1", "k2", "n", "start", F.slice("wh", F.col("start") + 1, F.col("n")).alias("ww"))
    printed = cutouts.withColumn("fp", _simhash(F.col("ww")))
    probes = printed.select("*", F.explode(_blocks(F.col("fp"))).alias("block"))

    # the table holds fingerprints only; the shingles of an item join what it finds
    flips = [0] + [sum(1 << b for b in c) for k in range(1, BALL + 1) for c in combinations(range(BLOCK_BITS), k)]
    items = items.withColumn("ik", F.xxhash64("iw"))
    balls = (items.select("ik", "n", "iw").dropDuplicates(["ik"])
             .select("ik", F.col("n").alias("bn"), F.explode(_blocks(_simhash(F.col("iw")))).alias("block"))
             .select("ik", "bn", F.explode(F.transform(F.lit(flips).cast("array<long>"), lambda x: F.col("block").bitwiseXOR(x))).alias("entry")))
    entries = n_items * BLOCKS * len(flips)
    balls = F.broadcast(balls) if entries <= params.broadcast_balls else balls.hint("merge")
    found = probes.join(balls, (F.col("n") == F.col("bn")) & (F.col("block") == F.col("entry"))).select("doc_id", "k1", "k2", "start", "ww", "ik")
    near = found.join(items.select("item_id", "ik", "ish").distinct(), "ik")
    once = near.groupBy("doc_id", "k1", "k2", "item_id", "ik", "start").agg(F.first("ww").alias("ww"), F.first("ish").alias("ish"))
    once = once.withColumn("wsh", _shingles("ww", width))
    same = _common(F.col("wsh"), F.col("ish"))
    scored = once.withColumn("similarity", same / (F.size("wsh") + F.size("ish") - same)).where(F.col("similarity") >= params.similarity)
    best = scored.groupBy("doc_id", "k1", "k2", "item_id", "ik").agg(
        F.min_by("start", F.struct(-F.col("similarity"), "start")).alias("start"), F.max("similarity").alias("similarity"))
    return best.select("doc_id", "item_id", "start", "similarity", "k1", "k2")


def clean(docs: DataFrame, items: DataFrame, params: DecontaminationParams = DecontaminationParams(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that copy no item; all columns stay."""
    bad = matches(docs, items, params, text, doc_id).select(F.col("k1").alias("_b1"), F.col("k2").alias("_b2")).distinct()
    bad = sized(bad, F.lit(64))
    k1, k2 = hash128(doc_id, text)
    keyed = docs.select(F.struct("*").alias("_row"), k1.alias("_k1"), k2.alias("_k2"))
    return keyed.join(bad, (F.col("_k1") == F.col("_b1")) & (F.col("_k2") == F.col("_b2")), "left_anti").select("_row.*")
