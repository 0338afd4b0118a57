"""The conversation trie against plain dictionaries."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nodeflow.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, depth int, place long, skeleton int, one string, size int"


def _turns():
    r = random.Random(5)
    says = ["", "hi", "Été", None, "long " * 50, "\n", "日本"]
    rows = []
    for c in range(300):
        if c % 7 == 3 or c % 10 == 5:
            continue  # absent, some of them bases of others
        for t in range(r.choice([1, 2, 3, 4, 5, 12])):
            first = t == 0 and c % 3 == 0  # a third starts alike
            rows.append((c, t if r.random() < 0.97 else None, r.choice(["user", "assistant", None]) if not first else "user", r.choice(says) if not first else "common"))
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(200) for t in range(3)]  # equal conversations
    rows += [(2000 + c, t, "user", "wide" if t < 9 else f"own {c}") for c in range(150) for t in range(10)]  # a node with many children
    rows += [(None, 1, "user", "x"), (7, None, None, None), (7, None, None, None), (10**15, 0, "u", "far"), (5000, 3, "user", "z"), (5000, 3, "user", "a")]
    rows += [(6000, t, "user", f"deep {t}") for t in range(200)]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, 3, "o", 4) for r in rows], SCHEMA).repartition(4)


def _model(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((t is not None, t or 0, key, (role, text)))
    convs = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in convs.items()}
    members = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path)))
    kids, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    first = {p: min(c for c, _ in m) for p, m in members.items()}
    return Counter((first[p], len(p), first[p[:-1]] if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(c for c, n in m if n == len(p))).encode()).hexdigest()) for p, m in members.items())


def _nodes(spark, rows, **kwargs):
    convs = trie.conversations(_frame(spark, rows))
    convs = trie.rebased(convs, F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string")) % 9, 8)
    return Counter(tuple(r[c] for c in trie.RESULT) for r in trie.prefix_trie(convs, **kwargs).collect())


@pytest.mark.parametrize("shards,waiting,piece", [(1, 1000, 1 << 16), (4, 3, 20), (40, 0, 1)])
def test_trie(spark, monkeypatch, shards, waiting, piece):
    monkeypatch.setattr(trie, "WAITING", waiting)
    monkeypatch.setattr(trie, "PIECE_BYTES", piece)
    rows = _turns()
    assert _nodes(spark, rows, shards=shards) == _model(rows)


def test_none_and_turnless(spark):
    assert _nodes(spark, []) == Counter()
    alone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(alone, 0, "user", "x")]  # its base is absent and its only turn is replaced
    assert _nodes(spark, rows) == _model(rows) and len(_model(rows)) == 1


def test_skeleton_is_bounded(spark):
    rows = _turns()
    paths = trie.paths_of(trie.conversations(_frame(spark, rows))).cache()
    for shards in (1, 3, 50):
        bounds = trie.splitters_of(paths, shards, turns=4)
        assert bounds == sorted(bounds) and len(bounds) < shards and len(trie.Skeleton(bounds).parent) <= 1 + 4 * shards
        assert all(len(p) <= 4 * trie.TURN for p, _ in bounds)
    assert len({c for p, c in trie.splitters_of(paths, 50) if p == max(x["path"] for x in paths.where("conv_id = 1000").collect())}) > 1  # equal conversations are split by id
