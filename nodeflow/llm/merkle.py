"""A Merkle manifest of a dataset, its trees stored in van Emde Boas order.

Leaves are digests of rows. In each group the leaves ascend by id; runs of eight become the digest of
their concatenation, level by level, until one node remains: the root of the group. The roots of the groups,
in order of the group, go on in the same way to the root of the dataset.

A tree is stored as aligned subtrees of up to four levels of runs (4,096 leaves). A subtree is one row: the
digests of its nodes in van Emde Boas order, that is cut at half its height into a top and its bottoms,
the top first, each laid out by the same rule. So a path from a leaf upward touches few places whatever the
size of a memory block, and the place of a node follows from its level and number alone. The roots of
the subtrees are the leaves of the next tier, which is built alike.

Ids are ranked in ranges, so a group with most of all rows is spread over tasks; a task holds one subtree.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from nodeflow.operators.ranking import keyed_rank

ARITY, LEVELS = 8, 4  # nodes of a run; levels of runs in a stored subtree
SPAN = ARITY**LEVELS
SIZE = 32  # bytes of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BLOCK = "grp string, block long, n int, total long, nodes binary, root binary"
WAY = "grp string, block long, steps binary, subroot binary"


# ---- layout

@lru_cache(maxsize=None)
def layout(levels: int) -> tuple[np.ndarray, ...]:
    """Places of the nodes of a full tree with so many levels of nodes: one array per level, root first."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    top = levels // 2
    upper, lower = layout(top), layout(levels - top)
    above, below = sum(map(len, upper)), sum(map(len, lower))
    bottoms = above + below * np.arange(ARITY**top)
    return (*upper, *((bottoms[:, None] + x[None, :]).reshape(-1) for x in lower))


def height(n: int) -> int:
    """Levels of runs until one of ``n`` nodes remains."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def digest_of(digests: np.ndarray) -> bytes:
    """Digest of digests (rows of bytes), joined as hexadecimal text."""
    return hashlib.sha256(digests.tobytes().hex().encode()).digest()


def block_of(leaves: np.ndarray, levels: int) -> np.ndarray:
    """Nodes (rows of 32 bytes) of the tree over ``leaves`` in van Emde Boas order; missing nodes are zeros."""
    places = layout(levels + 1)
    nodes = np.zeros((sum(map(len, places)), SIZE), np.uint8)
    n = len(leaves)
    nodes[places[levels][:n]] = leaves
    for level in range(levels, 0, -1):
        m = -(-n // ARITY)
        for i in range(m):
            run = nodes[places[level][i * ARITY : min(n, (i + 1) * ARITY)]]
            nodes[places[level - 1][i]] = np.frombuffer(digest_of(run), np.uint8)
        n = m
    return nodes


def steps_of(nodes: np.ndarray, n: int, levels: int, leaf: int) -> bytes:
    """Way from a leaf to the root: for each level the place in the run, the size of the run and its siblings."""
    places, out, at = layout(levels + 1), [], leaf
    for level in range(levels, 0, -1):
        own, first = at % ARITY, at - at % ARITY
        run = nodes[places[level][first : min(n, first + ARITY)]].tobytes()
        out += (bytes((own, len(run) // SIZE)), run[: SIZE * own], run[SIZE * (own + 1) :])
        at, n = at // ARITY, -(-n // ARITY)
    return b"".join(out)


def siblings(steps: bytes) -> str:
    """The digests of all siblings on a way, left to right, as hexadecimal text."""
    out, at = [], 0
    while at < len(steps):
        end = at + 2 + SIZE * (steps[at + 1] - 1)
        out.append(steps[at + 2 : end].hex())
        at = end
    return "".join(out)


def folded(leaf: bytes, steps: bytes) -> bytes:
    """The root that follows from a leaf and the siblings on its way."""
    at = 0
    while at < len(steps):
        cut_, end = at + 2 + SIZE * steps[at], at + 2 + SIZE * (steps[at + 1] - 1)
        leaf = hashlib.sha256((steps[at + 2 : cut_] + leaf + steps[cut_:end]).hex().encode()).digest()
        at = end
    return leaf


@F.pandas_udf(T.BinaryType())
def proof_digest(steps: pd.Series) -> pd.Series:
    """Digest of all siblings on a way, which names the proof."""
    return pd.Series([hashlib.sha256(siblings(x).encode()).digest() for x in steps], dtype=object)


@F.pandas_udf(T.BinaryType())
def folded_root(leaf: pd.Series, steps: pd.Series) -> pd.Series:
    return pd.Series([folded(x, way) for x, way in zip(leaf, steps)], dtype=object)


# ---- trees

def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of fields in order: ``-`` for a null, else the length in UTF-8 bytes, a colon and the value."""
    def part(c):
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, fields)).cast("binary"), 256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _block(rank: str = "rank") -> Column:
    return F.floor(F.col(rank) / SPAN).cast("long")


def _close(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """One stored subtree from its leaves (rank, total, digest)."""
    pdf = pdf.sort_values("rank")
    total = int(pdf["total"].iloc[0])
    leaves = np.frombuffer(b"".join(pdf["digest"]), np.uint8).reshape(-1, SIZE)
    nodes = block_of(leaves, LEVELS if total > SPAN else height(total))
    return pd.DataFrame({"grp": [key[0]], "block": [key[1]], "n": [len(pdf)], "total": [total], "nodes": [nodes.tobytes()], "root": [nodes[0].tobytes()]})


def build_trees(spark: SparkSession, leaves: DataFrame, path: str) -> list[DataFrame]:
    """Write the trees of ``leaves(grp, rank, total, digest)``, one table of subtrees per tier, and read them.

    ``rank`` counts from 0 within a group, ``total`` is the size of the group. A group ends with the tier in
    which it has one subtree.
    """
    tiers = []
    while True:
        target = f"{path}/tier-{len(tiers)}"
        leaves.select("grp", _block().alias("block"), "rank", "total", "digest").groupBy("grp", "block").applyInPandas(_close, BLOCK).write.parquet(target)
        tiers.append(spark.read.parquet(target))
        open_groups = tiers[-1].where(F.col("total") > SPAN)
        if open_groups.isEmpty():
            return tiers
        leaves = open_groups.select("grp", F.col("block").alias("rank"), F.ceil(F.col("total") / SPAN).cast("long").alias("total"), F.col("root").alias("digest"))


def roots(tiers: list[DataFrame]) -> DataFrame:
    """(grp, root) of every group."""
    ends = [t.where(F.col("total") <= SPAN).select("grp", "root") for t in tiers]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


def _ways_of(key, blocks: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """Ways of all leaves of one subtree; ``above`` is the way of its root."""
    row, up = blocks.iloc[0], above.iloc[0]
    nodes, n = np.frombuffer(row["nodes"], np.uint8).reshape(-1, SIZE), int(row["n"])
    levels = LEVELS if row["total"] > SPAN else height(int(row["total"]))
    steps = [steps_of(nodes, n, levels, i) + up["steps"] for i in range(n)]
    return pd.DataFrame({"grp": key[0], "block": np.arange(n) + SPAN * key[1], "steps": steps, "subroot": [up["subroot"]] * n})


def ways(tiers: list[DataFrame], base: DataFrame) -> DataFrame:
    """(grp, block, steps, subroot): ways of the roots of the lowest subtrees.

    ``base(grp, steps, subroot)`` holds the ways of the roots of the groups. Tiers are walked from the top.
    """
    found = None
    for t in range(len(tiers) - 1, -1, -1):
        ending = tiers[t].where(F.col("total") <= SPAN).select(F.col("grp").alias("_grp"), (F.col("block") + 0).alias("block"))  # columns of its own
        ended = base.join(ending, F.col("grp") == F.col("_grp")).select("grp", "block", "steps", "subroot")
        above = ended if found is None else ended.unionByName(found)
        if t == 0:
            return above
        found = tiers[t].groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInPandas(_ways_of, WAY)


# ---- manifest

def manifest(docs: DataFrame, path: str, group: str = "lang", doc_id: str = "doc_id", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> DataFrame:
    """Write the manifest of ``docs`` below ``path``; returns one row per row with its proof.

    Result: doc_id, ``carry`` columns, leaf, subroot, root and steps (binary; ``folded_root`` of a leaf and
    its steps gives the root). Groups are the values of ``group``, null first, then bytewise. Within a group
    null ids come first and equal ids are ordered by their digest; repeated rows are leaves of their own. An
    empty table has no root and gives no row. Other columns of ``docs`` are never read. Written tables:
    ``leaves``, ``trees/tier-*`` per group, ``top/tier-*`` over the roots of the groups.
    """
    spark, carry = docs.sparkSession, carry or {}
    grp = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))  # sorts like the group, null first
    extra = F.struct(F.col(doc_id).alias("doc_id"), *[c.alias(name) for name, c in carry.items()])
    docs.select(grp.alias("grp"), F.col(doc_id).alias("id"), leaf_digest(*map(F.col, fields)).alias("digest"), extra.alias("extra")).write.parquet(f"{path}/hashed")
    ranked = keyed_rank(spark.read.parquet(f"{path}/hashed"), ["grp"], "id", "digest")
    ranked.select("grp", (F.col("rank") - 1).alias("rank"), F.col("n").alias("total"), "digest", "extra").write.parquet(f"{path}/leaves")
    leaves = spark.read.parquet(f"{path}/leaves")
    tiers = build_trees(spark, leaves, f"{path}/trees")

    heads = keyed_rank(roots(tiers), [], "grp").select(F.lit("").alias("top"), "grp", (F.col("rank") - 1).alias("rank"), F.col("n").alias("total"), F.col("root").alias("digest"))
    heads.write.parquet(f"{path}/groups")
    heads = spark.read.parquet(f"{path}/groups")
    top = build_trees(spark, heads.select(F.col("top").alias("grp"), "rank", "total", "digest"), f"{path}/top")
    root = roots(top).first()
    start = spark.range(1).select(F.lit("").alias("grp"), F.lit(b"").alias("steps"), F.lit(b"").alias("subroot"))
    above = leaf_ways(heads.select(F.col("top").alias("grp"), "rank", "digest", F.struct("grp").alias("extra")), top, start, "struct<grp:string>")
    base = above.select("extra.grp", "steps", F.col("digest").alias("subroot"))
    kind = leaves.schema["extra"].dataType.simpleString()
    found = leaf_ways(leaves, tiers, base, kind)
    return found.select("extra.*", F.col("digest").alias("leaf"), "subroot", F.lit(root["root"] if root else None).cast("binary").alias("root"), "steps")


def leaf_ways(leaves: DataFrame, tiers: list[DataFrame], base: DataFrame, kind: str) -> DataFrame:
    """(digest, extra, subroot, steps) for ``leaves(grp, rank, digest, extra)``; ``kind`` is the type of extra."""
    def climb(key, rows, block):
        row = block.iloc[0]
        nodes, n = np.frombuffer(row["nodes"], np.uint8).reshape(-1, SIZE), int(row["n"])
        levels = LEVELS if row["total"] > SPAN else height(int(row["total"]))
        steps = [steps_of(nodes, n, levels, i) + row["steps"] for i in (rows["rank"] % SPAN).tolist()]
        return pd.DataFrame({"digest": rows["digest"], "extra": rows["extra"], "subroot": [row["subroot"]] * len(rows), "steps": steps})

    above = ways(tiers, base).select(F.col("grp").alias("_grp"), F.col("block").alias("_block"), "steps", "subroot")
    blocks = tiers[0].join(above, (F.col("grp") == F.col("_grp")) & (F.col("block") == F.col("_block"))).select("grp", "block", "n", "total", "nodes", "steps", "subroot")
    keyed = leaves.select("grp", _block().alias("block"), "rank", "digest", "extra")
    return keyed.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInPandas(climb, f"digest binary, extra {kind}, subroot binary, steps binary")
