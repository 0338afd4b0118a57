"""Binary token table: exact round trip and plain models."""

import heapq
import json
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nodeflow.llm import huffman
from tests.llm.common import empty, tricky, tricky_rows

WORDS = public_tokenizers.path("word_bpe_49k.json")


def _huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    return total


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = rng.integers(0, 50, rng.integers(2, 40))
        counts[:2] = 1
        got = huffman.code_lengths(counts, 18)
        assert int((got * counts).sum()) == _huffman_cost(counts)
        assert sum(2.0 ** -b for b in got if b) <= 1
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    short = huffman.code_lengths(fib, 4)
    assert short.max() <= 4 and sum(2.0 ** -b for b in short) <= 1
    assert huffman.code_lengths(np.array([0, 7]), 5).tolist() == [0, 1] and huffman.code_lengths(np.zeros(0, int), 5).tolist() == []
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, int), 2)


@pytest.mark.parametrize("n", [0, 1, 5, 128, 129, 5000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 60000)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1), 18)
    words = huffman.canonical(lengths)
    bits, marks = huffman.encode(ids, lengths, words, 128)
    got = huffman.decode(bits, marks, n, 128, huffman.look_up(lengths, words, 18), 18)
    assert (got == ids).all() and len(bits) == -(-int(lengths[ids].sum()) // 8)


def test_words_give_the_ids_of_whole_texts():
    tok, enc = Tokenizer.from_file(WORDS), huffman.Encoder(WORDS, 2, 50)
    assert enc.by_word
    texts = [r[1] for r in tricky_rows()] + ["Don't STOP., now,, a.b é É. x<|endoftext|>y <|EndOfText|> İ \x1cq\x85r\xa0s ẖ H̱, Σας ΟΔΟΣ. ﬁn", "a." * 9 + " b,\nc.\td. "]
    texts += [f"a{chr(c)}B{chr(c)}, {chr(c)}." for c in [*range(0x2100), *range(0xF900, 0xFFF0)]]
    for chars in (100, 10**7):
        got = list(enc.texts(texts, chars))
        bad = [t for t, g in zip(texts, got) if g.tolist() != tok.encode(t or "", add_special_tokens=False).ids + [2]]
        assert bad == []


def _without_lower(d):
    d["normalizer"] = None


def _no_lowercase(d):
    d["normalizer"]["normalizers"].pop()


def _token_with_marks(d):
    d["added_tokens"].append({**d["added_tokens"][-1], "id": 49408, "content": "now,, a.b"})


def _token_takes_space(d):
    d["added_tokens"][-1]["rstrip"] = True


def _letters_by_one(d):
    split = d["pre_tokenizer"]["pretokenizers"][0]
    split["pattern"]["Regex"] = split["pattern"]["Regex"].replace("[\\p{L}]+", "[\\p{L}]")


def _short(d):
    d["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}


@pytest.mark.parametrize("change, words", [(_without_lower, False), (_no_lowercase, False), (_token_with_marks, False),
                                           (_token_takes_space, False), (_letters_by_one, False), (_short, True)])
def test_other_vocabularies_give_the_ids_of_the_library(tmp_path, change, words):
    with open(WORDS, encoding="utf-8") as f:
        described = json.load(f)
    change(described)
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(described, f)
    tok, enc = Tokenizer.from_file(path), huffman.Encoder(path, 2, 50)
    tok.no_truncation()
    assert enc.by_word is words
    texts = [r[1] for r in tricky_rows()] + ["Hello WORLD foo", "x now,, a.b y<|endoftext|>  Z. É"]
    assert [g.tolist() for g in enc.texts(texts)] == [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


@pytest.mark.parametrize("params", [huffman.HuffmanParams(), huffman.HuffmanParams(block_ids=500, mark_ids=16, shard_ids=3000)])
def test_table_round_trip(spark, params):
    tok, rows = Tokenizer.from_file(WORDS), tricky_rows()
    target = tempfile.mkdtemp(prefix="nodeflow-ids-") + "/t"
    huffman.write_ids(tricky(spark), target, WORDS, 2, params)
    got = sorted(huffman.read_documents(spark, target, params).collect(), key=lambda r: r["start"])
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == sorted(-1 if r[0] is None else r[0] for r in rows)
    start = 0
    want = sorted((-1 if r[0] is None else r[0], zlib.crc32(np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in rows)
    for r in got:
        assert r["start"] == start and len(r["ids"]) == 4 * r["n_tokens"]
        start += r["n_tokens"]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], zlib.crc32(r["ids"])) for r in got) == want
    none = tempfile.mkdtemp(prefix="nodeflow-ids-") + "/t"
    huffman.write_ids(empty(spark), none, WORDS, 2, params)
    assert huffman.read_documents(spark, none, params).count() == 0
