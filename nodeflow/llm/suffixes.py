"""Repeated byte strings, found with difference-cover suffix arrays spread over content.

Sorting every suffix of a corpus would shuffle many times its size, so only places that can hold a repeat
reach a suffix array. Each window of ``window`` bytes has one anchor, the smallest hash of its runs of
``gram`` bytes (the first of equals): equal windows have equal anchors at equal offsets. Anchors that occur
once in the corpus drop out. The bytes around the others travel to the part of the hash space of their
anchor, each distinct string of a group of documents once with its smallest doc_id. Strings overlap: where
everything repeats they hold several times the text. So their volume is counted first, and the parts are
served in rounds of bounded volume; the files of a round go before the next one starts.

A part joins its strings into one text and builds its suffix array with the difference cover of period
three: the suffixes at two of three places are named by their sorted triples, a recursion on the names
ranks them, the third kind is sorted by (byte, rank of the next suffix) and merged in. Adjacent suffixes
that agree in ``window`` bytes form a class; all strings of the class that come later than its smallest
document learn so. A suffix array covers some anchors at a time, which bounds its memory.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeflow.llm.base import NO_ID, mixed, runs
from nodeflow.llm.packed import ASK, HASH_BITS, REPLY, Hashes, closed, joined, opened, packed, parted, repeated, sizes, unpacked
from nodeflow.session import written

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PIECE = 1 << 16  # bytes of a group's texts read at a time; pieces overlap by a window
ROUND = 1.8  # bytes of strings that travel in one round for each byte of text
ARRAY_BYTES = 1 << 21  # of strings in one suffix array; the strings of one anchor stay together


# ---- suffix array

def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks (from 0) of rows compared column by column; values are not negative."""
    key = columns[0]
    for c in columns[1:]:
        width = int(c.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * width >= 2**63:
            key = np.unique(key, return_inverse=True)[1].reshape(-1)
        key = key.astype(np.int64) * width + c
    return np.unique(key, return_inverse=True)[1].reshape(-1)


def suffix_array(text: np.ndarray, depth: int | None = None, step: int = 1) -> np.ndarray:
    """Suffixes of a text of positive integers in ascending order (difference cover of period three).

    With ``depth``, suffixes that agree in so many letters may come in any order: names that cover them
    are not told apart by a further recursion. ``step`` is what a letter of the recursion covers.
    """
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate((text.astype(np.int64), np.zeros(3, np.int64)))
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a place past the end keeps the first kind apart
    sampled = np.concatenate((one, two))
    names = _ranks(s[sampled], s[sampled + 1], s[sampled + 2])
    if int(names.max()) + 1 < len(names) and (depth is None or 3 * step < depth):
        order = suffix_array(names + 1, depth, 3 * step)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
    else:
        order = np.argsort(names)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = place + 1
    by_rank = sampled[order]
    by_rank = by_rank[by_rank < n]

    # the remaining suffixes: first letter, then the rank of the next suffix
    zero = np.arange(0, n, 3)
    m = n + 3
    key = s[zero] * m + rank[zero + 1]
    by = np.argsort(key, kind="stable")
    zero, key = zero[by], key[by]
    # merge: how many sampled suffixes of each kind come before (never fewer than before a smaller one)
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    before = np.maximum.accumulate(np.searchsorted(s[ones] * m + rank[ones + 1], key))
    both, width = np.concatenate((twos, zero)), int(s.max()) + 1
    pairs = s[both] * width + s[both + 1] if width * width * m < 2**63 else _ranks(s[both], s[both + 1])
    pairs = pairs * m + rank[both + 2]
    before = before + np.maximum.accumulate(np.searchsorted(pairs[: len(twos)], pairs[len(twos):]))
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + before
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = zero, by_rank
    return out


def _words8(b: bytes) -> np.ndarray:
    """The eight bytes at every place as one integer; zeros follow the end."""
    return np.ndarray(len(b), "<u8", bytes(b) + bytes(8), strides=(1,))


def classes(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of the window at each place of the strings joined, and the places that hold a whole window."""
    lens = np.array([len(x) for x in strings], np.int64)
    raw = b"\0".join(strings) + b"\0"
    text = np.frombuffer(raw, np.uint8).astype(np.int64) + 2
    ends = np.cumsum(lens + 1) - 1
    text[ends] = 1
    whole = np.zeros(len(text), bool)
    starts = ends - lens
    counts = np.maximum(lens - window + 1, 0)
    places = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    whole[places] = True
    order = suffix_array(text, window)
    order = order[whole[order]]
    eight = _words8(raw)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in [*range(0, window - 7, 8), window - 8]:
        x = eight[order + k]
        same &= x[1:] == x[:-1]
    label = np.zeros(len(text), np.int64)
    label[order] = np.concatenate(([0], np.cumsum(~same))) if len(order) else order
    return label, places


# ---- anchors of windows

def _anchors(text: bytes, begins: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Anchors of runs of windows inside the documents of a text: (first start, last start, hash, place after the
    first start) in order, over pieces of the text."""
    span = window - gram + 1
    for at in range(0, max(0, len(text) - window + 1), PIECE):
        b = text[at : at + PIECE + window - 1]
        eight = _words8(b)
        n = len(b) - gram + 1
        h = np.zeros(n, np.uint64)
        for k in range(0, gram, 8):
            h = mixed(h ^ eight[k : k + n])
        low = (h >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        some = slice(int(np.searchsorted(ends, at, "right")), int(np.searchsorted(begins, at + len(low))))
        x, y = (np.clip(e - at, 0, len(low)) for e in (begins[some], ends[some] - window + 1))
        step = np.zeros(len(low) + 1, np.int8)
        step[x[y > x]] += 1
        step[y[y > x]] -= 1
        whole = np.cumsum(step[:-1], dtype=np.int8) > 0  # the window lies in one document
        new = (low[1:] != low[:-1]) | ~whole[1:] | ~whole[:-1]
        first, last = (np.flatnonzero(whole & edge) for edge in (np.append(True, new), np.append(new, True)))
        place = (low[first] & np.uint64(0xFFFFFF)).astype(np.int64)
        yield at + first, at + last, _named(h[place]), place - first


def _named(h: np.ndarray) -> np.ndarray:
    """Smallest hashes crowd near zero, so they are mixed again before they name a part."""
    return mixed(h) >> np.uint64(64 - HASH_BITS)


class _Group:
    def __init__(self, pdf: pd.DataFrame, window: int, gram: int, bits: int):
        self.docs, self.window, self.bits = opened(pdf), window, bits
        self.text = b"".join(text for _, text in self.docs)
        ends = np.cumsum([len(text) for _, text in self.docs], dtype=np.int64)
        self.begins = np.append(0, ends[:-1])
        found = [*_anchors(self.text, self.begins, ends, window, gram)]
        self.first, self.last, h, self.inside = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.uint64 if k == 2 else np.int64)]) for k in range(4))
        self.keys = Hashes([h], bits)

    def strings(self, replies: pd.DataFrame):
        """Distinct strings around repeated anchors by part and first document, their parts, the places of their
        anchors, how often each string occurs, and the document and start of every occurrence in the order of
        the strings."""
        mine = np.flatnonzero(self.keys.live(replies)[self.keys.inverse])
        if not len(mine):
            return [], *(np.zeros(0, np.int64) for _ in range(5))
        index, text, starts = {}, self.text, self.first[mine]
        place = index.setdefault
        which = np.array([place(text[x:y], len(index)) for x, y in zip(starts.tolist(), (self.last[mine] + self.window).tolist())], np.int64)
        part, inside = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
        part[which] = self.keys.flat[mine] >> np.uint64(HASH_BITS - self.bits)  # a string has one anchor
        inside[which] = self.inside[mine]
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by = np.argsort(rank[which], kind="stable")
        known, starts = list(index), starts[by]
        docs = np.searchsorted(self.begins, starts, "right") - 1
        return [known[i] for i in order.tolist()], part[order], inside[order], np.bincount(rank[which]), docs, starts


def _repeated(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """As ``repeated``, with the number of their occurrences in the group (the flags from bit 2 on) as n."""
    live, sent = repeated(key, pdf), dict(zip(pdf["q"], pdf["body"]))
    live["n"] = [int((unpacked(parted(sent[q])[1]) >> 2)[np.cumsum(unpacked(b))].sum()) for q, b in zip(live["q"], live["body"])]
    return live.astype({"n": "int64"})


def _rounds(found: int, text_bytes: int, window: int, gram: int) -> int:
    """Rounds in which the strings around ``found`` anchors travel: an anchor has some half a span of windows."""
    return max(1, -(-found * (window - 1 + (window - gram + 2) // 2) // max(1, int(ROUND * text_bytes))))


def _asked(strings, part, inside, count, d, at, docs, q, window):
    rows = []
    if strings:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        least = np.minimum.reduceat(np.array([i for i, _ in docs], np.int64)[d], np.cumsum(count) - count)
        edge = np.flatnonzero(np.diff(part, prepend=-1))
        for x, y in zip(edge.tolist(), np.append(edge[1:], len(part)).tolist()):
            rows.append((int(part[x]), q, joined(packed(size[x:y]), packed(inside[x:y]), press.compress(b"".join(strings[x:y])), packed(np.diff(least[x:y], prepend=0)))))
        # what the group needs of its strings when the answers come: a part of its own brings it back
        rows.append((-1 - q, q, joined(*map(packed, (part, size - window + 1, count, np.diff(at, prepend=0))))))
    return pd.DataFrame(rows, columns=["part", "q", "body"]).astype({"part": "int64", "q": "int64"})


def _least(strings: list[bytes], anchor: np.ndarray, windows: np.ndarray, every: np.ndarray, window: int):
    """Smallest document of each window of the strings that share their anchor with another string, one string
    after the other, and where those of each string begin (-1: the string is alone)."""
    _, inverse, times = np.unique(anchor, return_inverse=True, return_counts=True)
    # equal windows lie in strings of one anchor, so a string alone under its anchor meets no other
    shared = np.flatnonzero(times[inverse] > 1)
    shared = shared[np.argsort(inverse[shared], kind="stable")]
    start, n = np.full(len(strings), -1), windows[shared]
    ends = np.cumsum(n)
    start[shared] = ends - n
    smallest = np.zeros(int(n.sum()), np.int64)
    # whole anchors, up to so many bytes in one suffix array
    last = np.flatnonzero(np.diff(inverse[shared], append=-1)) + 1
    size = np.cumsum(n + window)
    x = 0
    while x < len(shared):
        y = max(int(last[np.searchsorted(last, x, "right")]), int(last[last <= np.searchsorted(size, (size[x - 1] if x else 0) + ARRAY_BYTES, "right")].max(initial=0)))
        label, places = classes([strings[i] for i in shared[x:y].tolist()], window)
        least = np.full(int(label.max(initial=0)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, label[places], np.repeat(every[shared[x:y]], n[x:y]))
        smallest[ends[x] - n[x] : ends[y - 1]] = least[label[places]]
        x = y
    return smallest, start


def _earliest(key, pdf: pd.DataFrame, window: int, gram: int) -> pd.DataFrame:
    """Runs of windows of the strings asked about that also lie in a document smaller than the string's own."""
    import zstandard

    if key[0] < 0:
        return pdf[["q", "part", "body"]]
    sent, index = [], {}
    place = index.setdefault
    for q, body in zip(pdf["q"], pdf["body"]):
        lens, inside, data, least = parted(body)
        lens = unpacked(lens)
        data, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum(lens)
        mine = [place(data[x:y], len(index)) for x, y in zip((ends - lens).tolist(), ends.tolist())]
        eight, at, h = _words8(data), ends - lens + unpacked(inside), np.zeros(len(lens), np.uint64)
        for k in range(0, gram, 8):
            h = mixed(h ^ eight[at + k])
        sent.append((q, np.array(mine, np.int64), _named(h).astype(np.int64), np.cumsum(unpacked(least))))
    strings = list(index)
    windows = np.fromiter(map(len, strings), np.int64, len(strings)) - window + 1
    every, anchor = np.full(len(strings), np.iinfo(np.int64).max), np.zeros(len(strings), np.int64)
    for _, mine, h, own in sent:
        np.minimum.at(every, mine, own)
        anchor[mine] = h
    smallest, start = _least(strings, anchor, windows, every, window)
    out = []
    for q, mine, _, own in sent:
        n, meets = windows[mine], start[mine] >= 0
        base, i = np.cumsum(n) - n, np.flatnonzero(meets)
        better = np.repeat(~meets & (every[mine] < own), n)
        if len(i):
            inside = np.arange(n[i].sum()) - np.repeat(np.cumsum(n[i]) - n[i], n[i])
            better[np.repeat(base[i], n[i]) + inside] = smallest[np.repeat(start[mine[i]], n[i]) + inside] < np.repeat(own[i], n[i])
        x, y = runs(better)
        if len(x):
            out.append((q, joined(packed(np.diff(x, prepend=0)), packed(y - x))))
    return pd.DataFrame({"q": [q for q, _ in out], "part": key[0], "body": [b for _, b in out]}).astype({"q": "int64", "part": "int64"})


def drop_repeats(docs: DataFrame, window: int = 50, gram: int = 24, group_bytes: int = 4_000_000, text: str = "text", doc_id: str = "doc_id", keep_bytes: bool = False) -> DataFrame:
    """One row per document without the bytes of strings that also start in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the kept bytes, and
    with ``keep_bytes`` those bytes as ``kept``. Matches stay inside documents; strings are judged on the
    input. A null text is empty. A null doc_id is smaller than any other and equal to other nulls; rows
    with the same doc_id never come before each other. ``gram`` is a multiple of 8, at most ``window``.
    """
    if gram % 8 or not 8 <= gram <= window:
        raise ValueError("gram is a multiple of 8 up to the window")
    groups, bits = sizes(docs, text, group_bytes)
    dealt = written(closed(docs, groups, text, doc_id), "texts").repartition(groups, "q")

    def ask(key, pdf):
        g = _Group(pdf, window, gram, bits)
        return g.keys.ask(key[0], (g.keys.counts > 1) | np.full(len(g.keys.keys), 2) | g.keys.counts << 2)

    live = written(dealt.groupBy("q").applyInPandas(ask, ASK).groupBy("part").applyInPandas(_repeated, REPLY + ", n long"), "repeats")
    rounds = min(2**bits, _rounds(live.agg(F.sum("n")).first()[0] or 0, groups * group_bytes, window, gram))

    def tell(key, pdf, replies):
        g = _Group(pdf, window, gram, bits)
        return _asked(*g.strings(replies), g.docs, key[0], window)

    def serve(k: int) -> DataFrame:
        mine = live.where(F.col("part") % rounds == k).groupBy("q")
        return written(dealt.groupBy("q").cogroup(mine).applyInPandas(tell, ASK).groupBy("part").applyInPandas(lambda key, pdf: _earliest(key, pdf, window, gram), REPLY), "answers")

    told = functools.reduce(DataFrame.unionByName, [serve(k) for k in range(rounds)])

    def finish(key, pdf, replies):
        docs = opened(pdf)
        ids, size = (np.array(x, np.int64) for x in zip(*((i, len(x)) for i, x in docs)))
        base = np.cumsum(size) - size
        gone, touched = np.zeros(int(size.sum()) + 1, np.int32), np.zeros(len(docs), bool)
        for body in replies.loc[replies["part"] < 0, "body"]:
            part, n, count, at = (unpacked(x) for x in parted(body))
            at = np.cumsum(at)
            d = np.searchsorted(base, at, "right") - 1
            before = np.cumsum(n) - n
            least = np.repeat(np.minimum.reduceat(ids[d], np.cumsum(count) - count), n)
            better = np.zeros(len(least) + 1, np.int8)
            for p, told_ in zip(replies["part"], replies["body"]):
                k = int(np.searchsorted(part, p))
                if p >= 0 and k < len(part) and part[k] == p:  # of the same round
                    first, length = (unpacked(x) for x in parted(told_))
                    first = before[k] + np.cumsum(first)
                    better[first] += 1
                    better[first + length] -= 1
            least[np.cumsum(better[:-1], dtype=np.int8) > 0] = NO_ID  # smaller than any document here that holds the window
            low, high = (f.reduceat(least, before) for f in (np.minimum, np.maximum))
            k, own = np.repeat(np.arange(len(n)), count), ids[d]
            full = high[k] < own  # windows that start in [at, at + n)
            starts, ends = [at[full]], [at[full] + n[k[full]]]
            touched[d[full]] = True
            some = np.flatnonzero(~full & (low[k] < own))
            each = n[k[some]]
            inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            lost = least[np.repeat(before[k[some]], each) + inside] < np.repeat(own[some], each)
            starts.append((np.repeat(at[some], each) + inside)[lost])
            ends.append(starts[-1] + 1)
            touched[d[some]] = True
            np.add.at(gone, np.concatenate(starts), 1)
            np.add.at(gone, np.concatenate(ends) - 1 + window, -1)
        gone = np.cumsum(gone[:-1]) > 0
        rows = []
        for i, ((doc, body), at) in enumerate(zip(docs, base.tolist())):
            lost = gone[at : at + len(body)]
            kept = np.frombuffer(body, np.uint8)[~lost].tobytes() if touched[i] else body
            spans = len(runs(lost)[0]) if touched[i] else 0
            rows.append((None if doc == NO_ID else doc, len(body), len(body) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})
        return out if keep_bytes else out.drop(columns="kept")

    return dealt.groupBy("q").cogroup(told.groupBy("q")).applyInPandas(finish, RESULT + (", kept binary" if keep_bytes else ""))
