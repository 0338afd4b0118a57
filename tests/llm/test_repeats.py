"""Repeated windows against all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from nodeflow.llm import anchors, suffixes
from tests.llm.common import empty, tricky, tricky_rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = -(2**63)


def _rows():
    r = random.Random(7)
    words = [f"w{k}" for k in range(4000)]
    shared = [[r.choice(words) for _ in range(r.randint(15, 70))] for _ in range(8)]
    rows = list(tricky_rows())
    for k in range(60):
        own = [r.choice(words) for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(own))
            own[at:at] = r.choice(shared)[r.randint(0, 6):]
        rows.append((900 - k, " ".join(own) + "\n", "en", "s", 1, 1, "b", 5, "s", "x"))
    rows.append((5000, "same " * 90, "en", "s", 1, 1, "b", 5, "s", "x"))
    return rows


def _words_model(rows, width=20):
    texts = [(LOW if r[0] is None else r[0], WORD.findall((r[1] or "").encode())) for r in rows]
    least, out = {}, []
    for d, w in texts:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            least[k] = min(least.get(k, d), d)
    for d, w in texts:
        gone, seen = np.zeros(len(w), bool), set()
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            if least[k] < d or k in seen:
                gone[s : s + width] = True
            seen.add(k)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("group_bytes", [4_000_000, 3000])
def test_words(spark, group_bytes):
    rows = _rows()
    got = anchors.drop_repeats(tricky(spark, rows), group_bytes=group_bytes, keep_text=True).collect()
    assert Counter((LOW if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == _words_model(rows)
    assert all(len(r["kept"].split()) == r["n_words"] - r["n_removed"] for r in got if r["kept"].isascii())
    assert anchors.drop_repeats(empty(spark)).count() == 0


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(0)
    for n in [*range(0, 40), 300]:
        for top in (1, 2, 5, 200):
            t = rng.integers(1, top + 1, n)
            assert suffixes.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def _bytes_model(rows, width=50):
    texts = [(LOW if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    least, out = {}, []
    for d, t in texts:
        for s in range(len(t) - width + 1):
            k = t[s : s + width]
            least[k] = min(least.get(k, d), d)
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - width + 1):
            if least[t[s : s + width]] < d:
                gone[s : s + width] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("group_bytes,piece", [(4_000_000, 1 << 22), (3000, 100)])
def test_bytes(spark, group_bytes, piece, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", piece)
    rows = _rows()
    got = suffixes.drop_repeats(tricky(spark, rows), group_bytes=group_bytes, keep_bytes=True).collect()
    assert Counter((LOW if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == _bytes_model(rows)
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)
    assert suffixes.drop_repeats(empty(spark)).count() == 0


def _shuffled(spark):
    """Bytes of the block manager's files."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()))


def test_rounds_of_strings(spark, monkeypatch):
    names, write = [], suffixes.written
    monkeypatch.setattr(suffixes, "written", lambda df, name: names.append(name) or write(df, name))
    monkeypatch.setattr(suffixes, "ROUND", 0.05)
    rows = _rows()
    got = suffixes.drop_repeats(tricky(spark, rows), group_bytes=3000).collect()
    assert names.count("answers") > 5
    assert Counter((LOW if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == _bytes_model(rows)


def test_copies_do_not_pile_up_on_disk(spark):
    r = random.Random(11)
    texts = ["".join(r.choices("abcdefghijklmnop", k=4000)) for _ in range(100)]
    docs = spark.createDataFrame([(100 * copy + k, t) for copy in range(4) for k, t in enumerate(texts)], "doc_id long, text string")
    before = _shuffled(spark)
    out = suffixes.drop_repeats(docs, group_bytes=200_000)
    out.write.format("noop").mode("overwrite").save()
    # 0.64 times the texts; 3.6 times where one plan keeps hashes, strings and answers to its end
    assert _shuffled(spark) - before < 1.2 * 400 * 4000
    assert [tuple(x) for x in out.groupBy((out.doc_id >= 100).alias("copy")).sum("n_removed").orderBy("copy").collect()] == [(False, 0), (True, 300 * 4000)]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_round_holds_a_bounded_share():
    import pandas as pd
    import zstandard

    from nodeflow.llm.packed import packed

    r = random.Random(5)
    texts = ["".join(r.choices("abcdefghijklmnop ", k=r.randint(0, 9000))).encode() for _ in range(60)]
    g = suffixes._Group(pd.DataFrame({"doc_id": range(60), "body": [zstandard.ZstdCompressor().compress(t) for t in texts]}), 50, 24, 4)
    live = pd.DataFrame({"part": g.keys.parts, "body": [packed(np.diff(np.arange(y - x), prepend=0)) for x, y in zip(g.keys.starts, g.keys.ends)]})
    rounds = suffixes._rounds(int(g.keys.counts.sum()), len(g.text), 50, 24)
    for k in range(rounds):
        strings, part, inside, count, docs, starts = g.strings(live[live["part"] % rounds == k])
        assert set(part % rounds) <= {k} and sum(map(len, strings)) < 1.3 * suffixes.ROUND * len(g.text)
        owner = [docs[i] for i in np.cumsum(count) - count]
        assert all(x in texts[d] for x, d in zip(strings, owner))
    assert rounds > 1


@pytest.mark.parametrize("window,gram", [(50, 24), (20, 8), (16, 16)])
def test_anchors_of_joined_texts(window, gram, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 37)
    r = random.Random(window)
    texts = ["".join(r.choices("ab ", k=k)).encode() for k in (0, 5, 0, 0, window, window - 1, 400, 0, 61, window + 1, 0)]
    texts += [texts[6], b""]
    ends = np.cumsum([len(t) for t in texts])
    begins, text = np.append(0, ends[:-1]), b"".join(texts)
    named, at = {}, []
    for first, last, key, inside in suffixes._anchors(text, begins, ends, window, gram):
        for x, y, k, i in zip(first.tolist(), last.tolist(), key.tolist(), inside.tolist()):
            at += range(x, y + 1)
            for w in range(x, y + 1):
                named.setdefault(text[w : w + window], set()).add((k, x + i - w, text[x + i : x + i + gram]))
    assert at == [b + k for b, t in zip(begins.tolist(), texts) for k in range(len(t) - window + 1)]
    assert all(len(x) == 1 for x in named.values())


def test_suffix_arrays_of_some_anchors(monkeypatch):
    r = random.Random(9)
    strings, anchor = [], []
    for a in range(40):
        phrase = bytes(r.choices(b"abcdefgh", k=50))
        mine = {bytes(r.choices(b"abcdefgh", k=r.randint(0, 12))) + phrase + bytes(r.choices(b"xy", k=r.randint(0, 3))) for _ in range(r.choice([1, 2, 9]))}
        strings += mine
        anchor += [a] * len(mine)
    mixed_up = r.sample(range(len(strings)), len(strings))
    strings, anchor = [strings[i] for i in mixed_up], np.array([anchor[i] for i in mixed_up])
    n, every = np.array([len(x) - 49 for x in strings]), np.array(r.sample(range(1000), len(strings)))
    sizes, classes = [], suffixes.classes
    monkeypatch.setattr(suffixes, "classes", lambda some, window: sizes.append(len(some)) or classes(some, window))
    monkeypatch.setattr(suffixes, "ARRAY_BYTES", 700)
    smallest, start = suffixes._least(strings, anchor, n, every, 50)
    assert len(sizes) > 5 and sum(sizes) == int((start >= 0).sum())
    least = {}
    for x, d in zip(strings, every.tolist()):
        for k in range(len(x) - 49):
            least[x[k : k + 50]] = min(least.get(x[k : k + 50], d), d)
    for i, x in enumerate(strings):
        alone = int((anchor == anchor[i]).sum()) == 1
        assert (start[i] < 0) == alone
        assert alone or smallest[start[i] : start[i] + n[i]].tolist() == [least[x[k : k + 50]] for k in range(n[i])]


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_window_classes_of_bounded_depth(letters):
    rng = np.random.default_rng(letters)
    for n, window in ((40, 8), (300, 12), (1500, 50), (4000, 50)):
        strings = [bytes(rng.integers(97, 97 + letters, rng.integers(window, 3 * window)).tolist()) for _ in range(n // window + 1)]
        strings = list(dict.fromkeys(strings + [s[:5] + s for s in strings[::2]] + [s + s for s in strings[::3]]))
        label, places = suffixes.classes(strings, window)
        text = b"\0".join(strings) + b"\0"
        by_label, by_window = {}, {}
        for p in places.tolist():
            by_label.setdefault(int(label[p]), set()).add(text[p : p + window])
            by_window.setdefault(text[p : p + window], set()).add(int(label[p]))
        assert all(len(x) == 1 for x in by_label.values()) and all(len(x) == 1 for x in by_window.values())


def test_word_hashes():
    r = random.Random(3)
    words = [bytes(r.choice(b"ab\0\xff") for _ in range(r.choice([1, 2, 7, 8, 9, 16, 17, 255, 256, 257, 600]))) for _ in range(3000)] + [b"x" * 5000]
    texts = [b"", b" ", b"\t\n", *[b" ".join(r.choices(words, k=r.randint(0, 40))) + r.choice([b"", b"\x0b", b" \r\n"]) for _ in range(200)], b" ".join(words)]
    h, counts = anchors.word_hashes(texts)
    every = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(h) == len(every)
    assert len({(w, x) for w, x in zip(every, h.tolist())}) == len(set(every)) == len(set(h.tolist()))
    assert [len(x) for x in anchors.word_hashes([])] == [0, 0]


def test_parts_follow_the_bytes(spark):
    from nodeflow.llm import packed

    for total, most in ((10**6, 2**8), (30 * 10**9, 2**9), (10**12, 2**14)):
        groups, bits = packed.sizes(_Sized(total), "text", 4_000_000)
        assert groups == max(1, -(-total // 4_000_000)) and 2**bits <= most


class _Sized:
    """Stands for a table of so many bytes."""

    def __init__(self, total):
        self.total = total

    def agg(self, *_):
        return self

    def first(self):
        return (self.total,)
