"""Repeated runs of words, found with fixed-block anchors.

Every document is a reference: its non-overlapping blocks of half a window are indexed. Every rolling run
of that many words probes the index. A window of ``2 * block`` words that occurs twice holds a whole block
of one occurrence at the same place in the other, so both occurrences hold a hit at the same offset. Hits
are extended to all windows around them; equal windows meet by a hash of all their words, and the windows
found merge into maximal repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeflow.llm.base import NO_ID, cover, mixed, runs, windows
from nodeflow.llm.packed import ASK, HASH_BITS, REPLY, Hashes, grouped, joined, opened, packed, parted, repeated, sizes, unpacked

RESULT = "doc_id long, n_words long, n_removed long, n_runs long, kept_sha256 string"


LONG = 256  # bytes from which a word is hashed by itself


def _eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one integer; zeros follow the end."""
    x = np.concatenate((b, np.zeros(8, np.uint8))).astype(np.uint64)
    for k, shift in ((1, 8), (2, 16), (4, 32)):
        x[:-k] |= x[k:] << np.uint64(shift)
    return x[: len(b)]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after the other, and the number of words of each text.

    A word is hashed from its length and its bytes, eight at a time, for all words at once.
    """
    import xxhash

    raw = b" ".join(texts)
    b = np.frombuffer(raw, np.uint8)
    space = np.concatenate(([True], (b == 32) | ((b >= 9) & (b <= 13)), [True]))
    edge = np.diff(space.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = ends - starts
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    with np.errstate(over="ignore"):
        h = mixed(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        eight, at, left = _eights(b), np.flatnonzero(sizes <= LONG), None
        step = 0
        while len(at):
            left = sizes[at] - step
            bits = (np.uint64(8) * np.minimum(left, 8).astype(np.uint64)) % np.uint64(64)
            mask = np.where(left >= 8, np.uint64(2**64 - 1), (np.uint64(1) << bits) - np.uint64(1))
            h[at] = mixed(h[at] ^ (eight[starts[at] + step] & mask))
            at, step = at[left > 8], step + 8
    for k in np.flatnonzero(sizes > LONG).tolist():
        h[k] = xxhash.xxh64_intdigest(raw[starts[k] : ends[k]])
    return h, counts


def _windows_at(values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """As ``windows``, for some starts only."""
    total, factor = np.zeros(len(starts), np.uint64), 1
    for k in range(width):
        total += values[starts + k] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % 2**64
    return mixed(total)


class _Group:
    """Words, block hashes and window hashes of a group of documents."""

    def __init__(self, pdf: pd.DataFrame, block: int, bits: int):
        self.docs = opened(pdf)
        self.flat, counts = word_hashes([text for _, text in self.docs])
        self.ends = np.cumsum(counts)
        self.begins = self.ends - counts
        with np.errstate(over="ignore"):
            every = windows(self.flat, block) >> np.uint64(64 - HASH_BITS)
        self.rolling = [every[a : max(a, e - block + 1)] for a, e in zip(self.begins.tolist(), self.ends.tolist())]
        self.keys = Hashes(self.rolling, bits)
        self.block, self.bits = block, bits

    def flags(self) -> np.ndarray:
        indexed = np.concatenate([np.arange(len(r)) % self.block == 0 for r in self.rolling]) if self.rolling else np.zeros(0, bool)
        return (self.keys.counts > 1) | (np.bincount(self.keys.inverse, indexed, len(self.keys.keys)) > 0).astype(np.int64) << 1

    def candidates(self, replies: pd.DataFrame) -> list[np.ndarray]:
        """For each document the starts of the windows that hold a hit."""
        hit, at, out = self.keys.live(replies)[self.keys.inverse], 0, []
        for size, r in zip((self.ends - self.begins).tolist(), self.rolling):
            mine = hit[at : at + len(r)]
            at += len(r)
            n = size - 2 * self.block + 1
            if n <= 0 or not mine.any():
                out.append(np.zeros(0, np.int64))
                continue
            seen = np.concatenate(([0], np.cumsum(mine)))
            out.append(np.flatnonzero(seen[self.block + 1 : self.block + 1 + n] > seen[:n]))
        return out

    def found(self, replies: pd.DataFrame):
        """Starts by document, distinct windows (two hashes, ascending), the window of each start, and the
        smallest document of each window."""
        each = self.candidates(replies)
        lens = [len(x) for x in each]
        starts = np.concatenate(each) + np.repeat(self.begins, lens) if each else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            first = _windows_at(self.flat, starts, 2 * self.block)
            second = _windows_at(self.flat ^ np.uint64(0x5851F42D4C957F2D), starts, 2 * self.block)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        pairs = np.stack((first[new], second[new]), 1)
        owner = np.repeat(np.array([d for d, _ in self.docs], np.int64), lens)
        least = np.full(len(pairs), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, owner)
        return each, pairs, inverse, least


def _runs_of(part: np.ndarray):
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return ((int(part[a]), np.arange(a, b)) for a, b in zip(starts, np.append(starts[1:], len(part))))


def _earliest(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest document of each window asked about, where it is smaller than the group's own."""
    bodies = [parted(b) for b in pdf["body"]]
    pairs = np.concatenate([np.stack((np.cumsum(unpacked(a, np.uint64)), unpacked(b, np.uint64)), 1) for a, b, _ in bodies])
    own = [np.cumsum(unpacked(c)) for *_, c in bodies]
    docs = np.concatenate(own)
    _, inverse = np.unique(pairs, axis=0, return_inverse=True)
    least = np.full(inverse.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, inverse.reshape(-1), docs)
    least, out, end = least[inverse.reshape(-1)], [], 0
    for q, mine in zip(pdf["q"], own):
        better = np.flatnonzero(least[end : end + len(mine)] < mine)
        if len(better):
            out.append((q, joined(packed(np.diff(better, prepend=0)), packed(np.diff(least[end + better], prepend=0)))))
        end += len(mine)
    return pd.DataFrame({"q": [q for q, _ in out], "part": key[0], "body": [b for _, b in out]}).astype({"q": "int64", "part": "int64"})


def drop_repeats(docs: DataFrame, window: int = 20, group_bytes: int = 4_000_000, text: str = "text", doc_id: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """One row per document without the words of windows that occur earlier.

    A window of ``window`` (even) words is earlier in a document with a smaller doc_id, or in the same row
    at an earlier start. Returns doc_id, n_words, n_removed, n_runs (maximal removed runs), kept_sha256 of
    the kept words joined by a space, and with ``keep_text`` those words as ``kept``. Words are what lies
    between ASCII white space. A null or empty text has no words. A null doc_id is smaller than any other
    and equal to other nulls; rows with the same doc_id never come before each other.
    """
    if window % 2:
        raise ValueError("blocks are half a window")
    block = window // 2
    groups, bits = sizes(docs, text, group_bytes)
    dealt = grouped(docs, groups, text, doc_id)

    def ask(key, pdf):
        g = _Group(pdf, block, bits)
        return g.keys.ask(key[0], g.flags())

    live = dealt.groupBy("q").applyInPandas(ask, ASK).groupBy("part").applyInPandas(repeated, REPLY)

    def tell(key, pdf, replies):
        g = _Group(pdf, block, bits)
        _, pairs, _, least = g.found(replies)
        out = [(p, joined(packed(np.diff(pairs[x, 0], prepend=np.uint64(0))), packed(pairs[x, 1].copy()), packed(np.diff(least[x], prepend=0)))) for p, x in _runs_of((pairs[:, 0] >> np.uint64(64 - bits)).astype(np.int64))] if len(pairs) else []
        return pd.DataFrame({"part": [p for p, _ in out], "q": key[0] if len(key) else 0, "body": [b for _, b in out]}).astype({"part": "int64", "q": "int64"})

    told = dealt.groupBy("q").cogroup(live.groupBy("q")).applyInPandas(tell, ASK).groupBy("part").applyInPandas(_earliest, REPLY)

    def finish(key, pdf, replies):
        live_, better = replies[replies["kind"] == 0], replies[replies["kind"] == 1]
        g = _Group(pdf, block, bits)
        each, pairs, inverse, least = g.found(live_)
        if len(pairs):
            at = {p: int(x[0]) for p, x in _runs_of((pairs[:, 0] >> np.uint64(64 - bits)).astype(np.int64))}
            for part, body in zip(better["part"], better["body"]):
                places, docs_ = (np.cumsum(unpacked(b)) for b in parted(body))
                least[at[part] + places] = docs_
        rows, end = [], 0
        for (doc, text_), starts, n_words in zip(g.docs, each, (g.ends - g.begins).tolist()):
            mine = inverse[end : end + len(starts)]
            end += len(starts)
            later = np.ones(len(starts), bool)
            later[np.unique(mine, return_index=True)[1]] = False  # first start of each window in the document
            words = text_.split()
            gone = cover(n_words, starts[later | (least[mine] < doc)], window)
            kept = [w for w, x in zip(words, gone.tolist()) if not x] if gone.any() else words
            body = b" ".join(kept)
            rows.append((None if doc == NO_ID else doc, n_words, int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(body).hexdigest(), body.decode("utf-8", "replace")))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "n_runs", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})
        return out if keep_text else out.drop(columns="kept")

    both = live.withColumn("kind", F.lit(0)).unionByName(told.withColumn("kind", F.lit(1)))
    return dealt.groupBy("q").cogroup(both.groupBy("q")).applyInPandas(finish, RESULT + (", kept string" if keep_text else ""))
