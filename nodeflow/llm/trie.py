"""Prefix trie of conversations, built from sorted shards and a skeleton of their splitters.

A conversation is the path of the digests of its turns. Paths are dealt into ranges between splitters and
sorted there, so the members of a node lie side by side. A node can reach beyond one shard only if it is a
prefix of a splitter. These nodes form the skeleton: the trie of the splitter paths, small enough for every
task. A shard finishes all other nodes in one pass over its sorted rows, with no more than the open path
in memory, and sends partial counts for the skeleton nodes; these are added up per node and rolled up along
the skeleton. Equal conversations are split over shards as well, since splitters compare the id last.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeflow.session import scratch_path

TURN = 16  # bytes of the digest of a turn
ROOT = 0

LOCAL, PARTIAL, PIECE = 0, 1, 2  # kinds of rows a shard sends
SENT = ("kind int, skeleton int, place long, size long, parent_place long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string, piece binary")
PIECE_BYTES = 1 << 16  # from which a list of ids of a skeleton node is sent on
WAITING = 1000  # finished children that wait for the smallest member of their parent; more look it up later
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, digests, sizes): digests of the turns in order and the UTF-8 bytes of their texts.

    Turns are ordered by ``turn``, null first, equal ones by their digest. A null role or text is empty.
    Rows without a conv_id belong to no conversation. One row holds one conversation, 20 bytes a turn.
    """
    said, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, what).cast("binary")))
    one = F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(what).alias("size"))
    listed = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), one.alias("one"))
    listed = listed.groupBy("conv_id").agg(F.array_sort(F.collect_list("one"), _by_turn).alias("turns"))
    return listed.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))


def _by_turn(a: Column, b: Column) -> Column:
    """Null turns first; equal turns by digest."""
    def least(x, y):
        return F.when(x < y, -1).when(x > y, 1)

    nulls = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    return F.coalesce(nulls, least(a["turn"], b["turn"]), least(a["digest"], b["digest"]), F.lit(0))


def _path(digests: Column) -> Column:
    """Binary of all digests in order."""
    return F.unhex(F.array_join(F.transform(digests, F.hex), ""))


def paths_of(convs: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) from (conv_id, digests, sizes)."""
    return convs.select("conv_id", _path(F.col("digests")).alias("path"), "sizes")


def rebased(convs: DataFrame, base: Column, shared: Column, shared_max: int) -> DataFrame:
    """(conv_id, digests, sizes): the first ``shared`` turns of conversation ``base``, then the own turns after
    as many. ``shared`` is at most ``shared_max``; a missing base gives no turns."""
    heads = convs.select(F.col("conv_id").alias("_base"), *[F.slice(c, 1, shared_max).alias(f"_{c}") for c in ("digests", "sizes")])
    met = convs.select("*", base.alias("_wanted"), shared.cast("int").alias("_h")).join(heads, F.col("_wanted") == F.col("_base"), "left")

    def one(c):
        own = F.when(F.size(c) > F.col("_h"), F.slice(c, F.col("_h") + 1, F.size(c))).otherwise(F.slice(c, 1, 0))
        return F.concat(F.coalesce(F.slice(f"_{c}", F.lit(1), F.col("_h")), F.slice(c, 1, 0)), own).alias(c)

    return met.select("conv_id", one("digests"), one("sizes"))


# ---- skeleton

class Skeleton:
    """Trie of the splitter paths: node -> children by turn, depths and parents. Node 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.children: list[dict[bytes, int]] = [{}]
        self.parent, self.depth = [-1], [0]
        for path, _ in splitters:
            at = ROOT
            for i in range(0, len(path), TURN):
                digest = path[i : i + TURN]
                if digest not in self.children[at]:
                    self.children[at][digest] = len(self.parent)
                    self.children.append({})
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                at = self.children[at][digest]


def splitters_of(paths: DataFrame, shards: int, per_shard: int = 32, turns: int = 64) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 bounds (path, conv_id), ascending, from the rows with the smallest hashes.

    The draw decides only how even the shards are. A bound is cut to ``turns`` turns, so the skeleton has at
    most shards x turns nodes.
    """
    drawn = paths.select(F.xxhash64("conv_id").alias("h"), "conv_id", F.substring("path", 1, turns * TURN).alias("path"), (F.octet_length("path") > turns * TURN).alias("cut"))
    rows = drawn.orderBy("h", "conv_id").limit(shards * per_shard).collect()
    bounds = sorted((bytes(r["path"]), -(2**63) if r["cut"] else r["conv_id"]) for r in rows)
    picked = [bounds[len(bounds) * k // shards] for k in range(1, shards)] if bounds else []
    return sorted(set(picked))


class _Open:
    """A node whose members are still coming."""

    __slots__ = ("place", "first", "skeleton", "size", "convs", "children", "leaves", "saved", "ends", "waiting", "overfull", "held", "held_from", "held_bytes")

    def __init__(self, place: int, conv: int, skeleton: int, size: int):
        self.place, self.first, self.skeleton, self.size = place, conv, skeleton, size
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends, self.waiting, self.overfull = None, [], False
        self.held, self.held_from, self.held_bytes = [], 0, 0


class _Shard:
    """One pass over the sorted conversations of a shard; finished nodes and partials gather in ``out``."""

    def __init__(self, shard: int, children: list[dict[bytes, int]]):
        self.trie, self.out, self.stack, self.path, self.places = children, [], [], b"", shard << 40

    def _open(self, conv: int, skeleton: int, size: int) -> None:
        self.stack.append(_Open(self.places, conv, skeleton, size))
        self.places += 1

    def add(self, conv: int, path: bytes, sizes: list[int]) -> None:
        if self.stack:
            self._close(_shared(self.path, path) + 1)
        else:
            self._open(conv, ROOT, 0)
        for d in range(len(self.stack) - 1, len(path) // TURN):
            up = self.stack[d].skeleton
            self._open(conv, self.trie[up].get(path[d * TURN : (d + 1) * TURN], -1) if up >= 0 else -1, sizes[d])
        for node in self.stack:
            node.convs += 1
            node.first = min(node.first, conv)
        self._ends(self.stack[-1], conv)
        self.path = path

    def _ends(self, node: _Open, conv: int) -> None:
        text = str(conv).encode()
        if node.skeleton < 0:
            if node.ends is None:
                node.ends = hashlib.sha256(text)
            else:
                node.ends.update(b"," + text)
            return
        if not node.held:
            node.held_from = conv
        node.held.append(text)
        node.held_bytes += len(text) + 1
        if node.held_bytes >= PIECE_BYTES:
            self._send_piece(node)

    def _send_piece(self, node: _Open) -> None:
        if node.held:
            self.out.append((PIECE, node.skeleton, None, None, None, node.held_from, *[None] * 7, b",".join(node.held)))
            node.held, node.held_bytes = [], 0

    def _close(self, depth: int) -> None:
        """Finish the open nodes from ``depth`` on, the deepest first."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            d = len(self.stack)
            if node.skeleton >= 0:
                self._send_piece(node)
                self.out.append((PARTIAL, node.skeleton, None, node.size, None, node.first, d, None, node.convs, node.children, node.leaves, node.saved, None, None))
                continue
            for row in node.waiting:
                self.out.append((*row[:7], node.first, *row[8:]))
            up = self.stack[-1]
            leaves, saved = node.leaves + (node.children == 0), node.saved + (node.convs - 1) * node.size
            up.children += 1
            up.leaves += leaves
            up.saved += saved
            row = (LOCAL, up.skeleton if up.skeleton >= 0 else None, node.place if node.overfull else None, None, up.place, node.first, d, None, node.convs, node.children, leaves, saved,
                   (node.ends or hashlib.sha256()).hexdigest(), None)
            if up.skeleton >= 0:
                self.out.append((*row[:4], None, *row[5:]))
            elif len(up.waiting) < WAITING:
                up.waiting.append((*row[:4], None, *row[5:]))
            else:
                up.overfull = True
                self.out.append(row)

    def rows(self, end: bool = False) -> pd.DataFrame:
        if end:
            self._close(0)
        done, self.out = self.out, []
        names = [c.split()[0] for c in SENT.split(", ")]
        out = pd.DataFrame(done, columns=names)
        return out.astype({c: "Int64" for c in names if c not in ("ends_sha256", "piece")})


def _shared(a: bytes, b: bytes) -> int:
    """Number of leading turns that two paths share."""
    n = min(len(a), len(b)) // TURN
    if a[: n * TURN] == b[: n * TURN]:
        return n
    for i in range(n):
        if a[i * TURN : (i + 1) * TURN] != b[i * TURN : (i + 1) * TURN]:
            return i
    return n


def _pass(children):
    """One pass over partitions sorted by (shard, path, conv_id)."""
    def run(batches):
        shard, number = None, None
        for pdf in batches:
            for n, conv, path, sizes in zip(pdf["shard"].tolist(), pdf["conv_id"].tolist(), pdf["path"], pdf["sizes"]):
                if n != number:
                    if shard is not None:
                        yield shard.rows(end=True)
                    shard, number = _Shard(n, children.value), n
                shard.add(conv, path, sizes.tolist())
                if len(shard.out) >= 10_000:
                    yield shard.rows()
        if shard is not None:
            yield shard.rows(end=True)

    return run


def _joined_ends(batches):
    """SHA-256 of all ids of a skeleton node from its pieces, sorted by (skeleton, first id)."""
    node, ends = None, None
    for pdf in batches:
        done = []
        for n, piece in zip(pdf["skeleton"].tolist(), pdf["piece"]):
            if n != node:
                if node is not None:
                    done.append((node, ends.hexdigest()))
                node, ends = n, hashlib.sha256(piece)
            else:
                ends.update(b",")
                ends.update(piece)
        yield pd.DataFrame(done, columns=["skeleton", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(node, ends.hexdigest())], columns=["skeleton", "ends_sha256"])


def _roll_up(trie: Skeleton):
    """Totals of the skeleton nodes from their own partials: the deepest first, each node adds to its parent."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("depth", ascending=False, kind="stable").reset_index(drop=True)
        at = {s: i for i, s in enumerate(pdf["skeleton"].tolist())}
        children, leaves, saved = (pdf[c].tolist() for c in ("n_children", "n_leaves", "saved_tokens"))
        first, convs, size = (pdf[c].tolist() for c in ("conv_id", "n_convs", "size"))
        parents = []
        for s, i in at.items():
            leaves[i] += children[i] == 0
            saved[i] += (convs[i] - 1) * size[i]
            up = at.get(trie.parent[s])
            if up is not None:
                children[up] += 1
                leaves[up] += leaves[i]
                saved[up] += saved[i]
            parents.append(None if up is None else first[up])
        return pdf[["skeleton", "conv_id", "depth", "n_convs"]].assign(
            parent_conv_id=pd.array(parents, "Int64"), n_children=children, n_leaves=leaves, saved_tokens=saved)

    return run


def prefix_trie(convs: DataFrame, shards: int | None = None, convs_per_shard: int = 500_000) -> DataFrame:
    """Nodes of the trie of ``convs(conv_id, digests, sizes)``: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A member of a node is a conversation that starts with its turns; conversations without turns end in the
    root, which has no text. ``ends_sha256`` digests the ids of those that end in the node, ascending. ids are
    distinct and not null. No conversations give no node, not even a root. Without ``shards`` there are as
    many as shuffle partitions, or more if a shard would hold over ``convs_per_shard`` conversations.
    """
    spark = convs.sparkSession
    target = scratch_path(spark, "conversation-paths")
    paths_of(convs).write.parquet(target)
    paths = spark.read.parquet(target)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-paths.count() // convs_per_shard))
    bounds = splitters_of(paths, shards)
    trie = Skeleton(bounds)
    known = spark.sparkContext.broadcast(bounds)

    def deal(batches):
        for pdf in batches:
            at = [bisect_right(known.value, key) for key in zip(pdf["path"], pdf["conv_id"].tolist())]
            yield pdf.assign(shard=np.array(at, np.int32))

    dealt = paths.mapInPandas(deal, "conv_id long, path binary, sizes array<int>, shard int").repartition(shards, "shard")
    ordered = dealt.sortWithinPartitions("shard", "path", "conv_id")
    target = scratch_path(spark, "conversation-nodes")
    ordered.mapInPandas(_pass(spark.sparkContext.broadcast(trie.children)), SENT).write.parquet(target)
    sent = spark.read.parquet(target)

    partial = sent.where(F.col("kind") == PARTIAL).groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("size").alias("size"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    # one row per skeleton node: at most shards x turns of a splitter
    totals = "skeleton int, conv_id long, depth long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"
    rolled = partial.groupBy().applyInPandas(_roll_up(trie), totals)
    pieces = sent.where(F.col("kind") == PIECE).select("skeleton", "conv_id", "piece").repartition("skeleton").sortWithinPartitions("skeleton", "conv_id")
    ends = pieces.mapInPandas(_joined_ends, "skeleton int, ends_sha256 string")
    nothing = hashlib.sha256().hexdigest()
    skeleton = rolled.join(ends.withColumnRenamed("skeleton", "_s"), F.col("skeleton") == F.col("_s"), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
    target = scratch_path(spark, "conversation-skeleton")
    skeleton.select("skeleton", *RESULT).write.parquet(target)
    skeleton = spark.read.parquet(target)

    local = sent.where(F.col("kind") == LOCAL)
    tops = skeleton.select(F.col("skeleton").alias("_s"), F.col("conv_id").alias("_sconv"))
    wide = sent.where((F.col("kind") == LOCAL) & F.col("place").isNotNull()).select(F.col("place").alias("_p"), F.col("conv_id").alias("_pconv"))
    settled = local.where("parent_place IS NULL").join(F.broadcast(tops), F.col("skeleton") == F.col("_s"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_sconv"))
    # children of a node with over WAITING children; all of them lie in one shard
    late = local.where("parent_place IS NOT NULL").join(wide, F.col("parent_place") == F.col("_p")).withColumn("parent_conv_id", F.col("_pconv"))
    return skeleton.select(*RESULT).unionByName(settled.select(*RESULT)).unionByName(late.select(*RESULT))
