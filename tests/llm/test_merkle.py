"""The manifest against plain hashing of whole lists."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeflow.llm import merkle
from tests.llm.common import tricky_rows


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def _way(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 8 * 8
        out.append((level[first:at], level[at + 1 : first + 8]))
        at //= 8
    return out


def model(rows):
    """rows(doc_id, text, lang, source, n_chars) -> the columns of the query."""
    groups = {}
    for d, text, lang, source, n in rows:
        bad = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        lower = "".join(c.lower() if c.isascii() else c for c in text) if text is not None else None
        groups.setdefault(lang, []).append((d, _leaf((d, source, lang, n, text)), _leaf((d, source, lang, n, lower if bad else text))))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = _tree([x[1] for x in groups[g]])
    top = _tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, (d, leaf, claimed) in enumerate(groups[g]):
            way = _way(trees[g], at) + _way(top, k)
            folded = claimed
            for left, right in way:
                folded = H(*left, folded, *right)
            out.append((d, leaf, trees[g][-1][0], top[-1][0], H(*[x for left, right in way for x in left + right]), folded, folded == top[-1][0]))
    return Counter(out)


def _run(spark, docs, tmp_path):
    fields = [merkle.lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_digest(*fields))
    proofs = merkle.manifest(docs, str(tmp_path / "m"), carry={"tampered": tampered})
    judged = proofs.select("*", merkle.proof_digest(F.col("steps")).alias("p"), merkle.folded_root(F.coalesce("tampered", "leaf"), F.col("steps")).alias("f"))
    return Counter((r["doc_id"], *[bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "p", "f")], r["f"] == r["root"]) for r in judged.collect())


@pytest.mark.parametrize("levels", range(1, 8))
def test_layout(levels):
    places = merkle.layout(levels)
    assert [len(x) for x in places] == [8**k for k in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range((8**levels - 1) // 7))
    top = levels // 2
    if top:
        low = merkle.layout(levels - top)
        size, first = sum(map(len, low)), (8**top - 1) // 7
        for j in range(8**top):  # each bottom is stored whole and laid out by the same rule
            for k, x in enumerate(low):
                assert (places[top + k][j * 8**k : (j + 1) * 8**k] == first + j * size + x).all()


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 511, 513])
def test_subtree(n):
    nodes = [H(str(i)) for i in range(n)]
    levels = _tree(nodes)
    block = merkle.block_of(np.frombuffer(bytes.fromhex("".join(nodes)), np.uint8).reshape(-1, 32), merkle.height(n))
    assert block[0].tobytes().hex() == levels[-1][0]
    for i in {0, n // 2, n - 1}:
        steps = merkle.steps_of(block, n, merkle.height(n), i)
        assert merkle.siblings(steps) == "".join(x for left, right in _way(levels, i) for x in left + right)
        assert merkle.folded(bytes.fromhex(nodes[i]), steps).hex() == levels[-1][0]
        assert merkle.folded(b"x" * 32, steps).hex() != levels[-1][0] or n == 0


@pytest.mark.parametrize("levels", [4, 1])
def test_manifest(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)  # with one level, trees need several tiers
    monkeypatch.setattr(merkle, "SPAN", 8**levels)
    rows = [r[:5] for r in tricky_rows()] + [(k, f"T{k}" * (k % 5), ["en", "é", "", "z"][k % 4 if k % 3 else 0], None if k % 5 else "S", k) for k in range(1000, 1300)]
    rows += [(5000 + k, None, f"l{k}", "s", None) for k in range(20)] + [(7, "A b", "en", "s", 3)] * 3
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rank int, grp string, n int").repartition(7)
    assert _run(spark, docs, tmp_path) == model(rows)


def test_one_row_and_none(spark, tmp_path):
    rows = [(3, "Ab", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert _run(spark, docs, tmp_path / "a") == model(rows)
    assert _run(spark, docs.limit(0), tmp_path / "b") == Counter()


def test_query(spark, sf):
    from nodeflow.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    got = QUERIES["op12_merkle_manifest"](spark, sf).collect()
    assert Counter(tuple(r) for r in got) == model([tuple(r) for r in docs])
