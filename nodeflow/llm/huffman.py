"""Token ids as a Huffman-coded binary table, in document order.

The table is a folder of Parquet files with one row per block:

    shard int, seq long       place of the block: shards ascend, blocks ascend inside a shard
    n_ids long                ids of the block
    docs binary, lens binary  int64 doc_ids and int64 numbers of ids, little-endian, one per document
    nulls binary              one byte per document: 1 where the doc_id is null
    bits binary               canonical code words, most significant bit first
    marks binary              int64 bit offset of every ``mark_ids``-th id

and a folder ``code`` with the code length of every id that occurs. Lengths alone define the canonical
code: words ascend with (length, id). A block needs nothing but the code, so blocks are decoded alone, and
the marks let many places of a block be decoded side by side with one look-up per id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeflow.llm.base import NO_ID
from nodeflow.session import scratch_path


@dataclass(frozen=True)
class HuffmanParams:
    max_bits: int = 18  # longest code word; 2 ** max_bits must hold all ids that occur
    block_ids: int = 262_144  # a block closes at so many ids, at the end of a document
    mark_ids: int = 128
    shard_ids: int = 8_000_000  # ids of a shard, on average
    known_words: int = 400_000  # words whose ids a task remembers at once


# ---- code

def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    n, out = len(used), np.zeros(len(counts), np.int64)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    if n > 2**max_bits:
        raise ValueError(f"{n} ids need more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    level, single = weights, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate((weights, pairs))
        place = np.argsort(merged, kind="stable")
        level = merged[place]
        single.append(place < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for mask in reversed(single):
        own = int(mask[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code word of each id with a length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    words, word, last = np.zeros(len(lengths), np.uint32), 0, 0
    for i, bits in zip(order.tolist(), lengths[order].tolist()):
        word <<= bits - last
        words[i], last = word, bits
        word += 1
    return words


def look_up(lengths: np.ndarray, words: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for every run of ``max_bits`` bits."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = np.left_shift(1, max_bits - lengths[order])
    ids, bits = np.zeros(2**max_bits, np.uint32), np.zeros(2**max_bits, np.int64)
    filled = int(spans.sum())
    ids[:filled], bits[:filled] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, bits


def encode(ids: np.ndarray, lengths: np.ndarray, words: np.ndarray, mark_ids: int) -> tuple[bytes, np.ndarray]:
    bits = lengths[ids]
    ends = np.cumsum(bits)
    starts = ends - bits
    size = int(ends[-1] + 7) // 8 if len(ids) else 0
    at = starts >> 3
    shifted = words[ids].astype(np.uint64) << (np.uint64(40) - (starts & 7).astype(np.uint64) - bits.astype(np.uint64))
    out = np.zeros(size + 5)
    for k in range(5):
        out += np.bincount(at + k, ((shifted >> np.uint64(32 - 8 * k)) & np.uint64(255)).astype(np.float64), size + 5)
    return out[:size].astype(np.uint8).tobytes(), starts[::mark_ids]


def decode(bits: bytes, marks: np.ndarray, n_ids: int, mark_ids: int, table: tuple[np.ndarray, np.ndarray], max_bits: int) -> np.ndarray:
    """All places named by the marks go forward together, one id a step."""
    ids, lens = table
    data = np.concatenate((np.frombuffer(bits, np.uint8), np.zeros(8 + mark_ids * 4, np.uint8))).astype(np.uint32)
    wide = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    out, place = np.zeros((mark_ids, len(marks)), np.uint32), marks.astype(np.int64)
    for step in range(min(mark_ids, n_ids)):
        here = (wide[np.minimum(place >> 3, len(wide) - 1)] >> (32 - max_bits - (place & 7)).astype(np.uint32)) & np.uint32(2**max_bits - 1)
        out[step] = ids[here]
        place = place + lens[here]
    return out.T.reshape(-1)[:n_ids]


# ---- ids of texts

class _Words(dict):
    """Index of each word; new words wait for their ids."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word):
        k = self[word] = len(self)
        self.new.append(word)
        return k


# fixed values: settings of a vocabulary file under which words between white space can be encoded on their own
_LOWER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_APART = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_PUNCTUATION = rb"[!-&(-/:;=?@\[-`{}~]"  # ASCII, without quotes and the signs around special tokens


def words_apart(described: dict) -> bool:
    """Whether texts of this vocabulary (its file as read) can be cut into words that are encoded alone."""
    import re

    def inside(token) -> bool:  # no cut falls into the token, and it takes nothing from beside it
        content = token["content"].encode()
        return not (token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"]
                    or re.search(_PUNCTUATION, content) or content.split() != [content])

    model = described["model"]
    return (described["normalizer"] == _LOWER and described["pre_tokenizer"] == _APART and model["type"] == "BPE"
            and not model.get("dropout") and all(map(inside, described["added_tokens"])))


class Encoder:
    """Ids of whole texts with a vocabulary that drops white space between words.

    Each distinct word between ASCII white space is encoded once; a vocabulary of another kind (see
    ``words_apart``) encodes whole texts. A truncation or padding the file asks for is not made.
    """

    def __init__(self, path: str, end_id: int | None, known_words: int):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        from tokenizers import Tokenizer

        self.vocabulary, self.end, self.limit = Tokenizer.from_file(path), end_id, known_words
        self.vocabulary.no_truncation()
        self.vocabulary.no_padding()
        with open(path, encoding="utf-8") as f:
            self.by_word = words_apart(json.load(f))
        self.dtype = np.dtype("<u2" if max(self.vocabulary.get_vocab_size(), (end_id or 0) + 1) <= 65536 else "<u4")
        self._forget()

    def _forget(self):
        self.words, self.ids, self.starts, self.lens, self.size = _Words(), [], [], [], 0

    def _learn(self):
        todo, self.words.new = self.words.new, []
        one = self.vocabulary.model.tokenize
        plain = [w.isalpha() for w in todo]  # ASCII letters only: one pre-token, lower case is its normal form
        rest = iter(self.vocabulary.encode_batch_fast([w.decode() for w, p in zip(todo, plain) if not p], add_special_tokens=False))
        memo: dict[bytes, list[int]] = {}
        for w, p in zip(todo, plain):
            if p:
                low = w.lower()
                got = memo.get(low)
                if got is None:
                    got = memo[low] = [t.id for t in one(low.decode())]
            else:
                got = next(rest).ids
            self.starts.append(self.size)
            self.lens.append(len(got))
            self.ids.extend(got)
            self.size += len(got)

    def texts(self, texts: list[str | None], chars: int = 8_000_000):
        """The ids of each text, as arrays."""
        if not self.by_word:
            for t in texts:
                yield self._ended(np.array(self.vocabulary.encode(t or "", add_special_tokens=False).ids, np.int64))
            return
        block, size = [], 0
        for t in texts:
            block.append(t)
            size += len(t or "")
            if size >= chars:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, texts):
        import re

        if len(self.words) > self.limit:
            self._forget()
        # a run of ASCII punctuation between a Latin letter and white space is a pre-token of its own
        split = re.compile(_PUNCTUATION + rb"(?:(?<=[a-zA-Z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))" + _PUNCTUATION + rb"*(?![^ \n])")
        at, ends = [], []
        for t in texts:
            if t:
                at.extend(map(self.words.__getitem__, split.sub(rb" \g<0>", t.encode()).split()))
            ends.append(len(at))
        self._learn()
        starts, lens, ids = np.array(self.starts, np.int64), np.array(self.lens, np.int64), np.array(self.ids, np.int64)
        where, ends = np.array(at, np.int64), np.array(ends, np.int64)
        n = lens[where]
        before = np.concatenate(([0], np.cumsum(n)))
        flat = ids[np.repeat(starts[where] - before[:-1], n) + np.arange(before[-1])] if len(where) else np.zeros(0, np.int64)
        cuts = before[ends]
        for a, b in zip(np.concatenate(([0], cuts[:-1])), cuts):
            yield self._ended(flat[a:b])

    def _ended(self, ids):
        return (ids if self.end is None else np.append(ids, self.end)).astype(self.dtype)


# ---- the table

def write_ids(docs: DataFrame, target: str, path: str, end_id: int | None = 2, params: HuffmanParams = HuffmanParams(), text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every text with the vocabulary file ``path`` and write the table to ``target``.

    Documents ascend by doc_id, null ids first; equal ids are ordered by a hash of their ids. A null or
    empty text has only the end id. An empty table has no blocks. Other columns are not looked at.
    """
    spark = docs.sparkSession
    plain = scratch_path(spark, "ids")
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def tokenize(batches):
        import zstandard

        encoder, pack = Encoder(path, end_id, params.known_words), zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            out = [(len(x), pack.compress(x.astype("<u4" if encoder.dtype.itemsize == 4 else "<u2").tobytes())) for x in encoder.texts(pdf["text"].tolist())]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": [n for n, _ in out], "size": encoder.dtype.itemsize, "ids": [b for _, b in out]})

    given.mapInPandas(tokenize, "doc_id long, n long, size int, ids binary").write.parquet(plain)
    stored = spark.read.parquet(plain)

    def tally(batches):
        total = np.zeros(0, np.int64)
        for pdf in batches:
            for x in _unpacked(pdf):
                c = np.bincount(x, minlength=len(total))
                c[: len(total)] += total
                total = c
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "count": total[at]})

    counts = stored.select("size", "ids").mapInPandas(tally, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).toPandas()
    histogram = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 0, np.int64)
    histogram[counts["id"].to_numpy()] = counts["count"].to_numpy()
    lengths = code_lengths(histogram, params.max_bits)
    words = canonical(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pd.DataFrame({"id": used, "bits": lengths[used]}), "id long, bits int").coalesce(1).write.parquet(f"{target}/code")
    sent = spark.sparkContext.broadcast((lengths, words))
    shards = max(1, -(-int(histogram.sum()) // params.shard_ids))

    def blocks(batches):
        from pyspark import TaskContext

        shard, seq, ids, docs_, held = TaskContext.get().partitionId(), 0, [], [], 0
        lens_, words_ = sent.value
        for pdf in batches:
            for d, x in zip(pdf["doc_id"].astype("Int64").tolist(), _unpacked(pdf)):
                ids.append(x)
                docs_.append(d)
                held += len(x)
                if held >= params.block_ids:
                    yield _block(shard, seq, docs_, ids, lens_, words_, params)
                    seq, ids, docs_, held = seq + 1, [], [], 0
        if docs_:
            yield _block(shard, seq, docs_, ids, lens_, words_, params)

    ordered = stored.withColumn("tie", F.xxhash64("ids")).repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.col("tie"))
    sorted_ = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "size", "ids")
    sorted_.mapInPandas(blocks, "shard int, seq long, n_ids long, docs binary, lens binary, nulls binary, bits binary, marks binary").write.parquet(f"{target}/blocks")


def _unpacked(pdf):
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    return (np.frombuffer(open_(b), "<u2" if s == 2 else "<u4").astype(np.int64) for s, b in zip(pdf["size"].tolist(), pdf["ids"].tolist()))


def _block(shard, seq, docs, ids, lengths, words, params):
    none = [d is None or d is pd.NA for d in docs]
    flat = np.concatenate(ids)
    bits, marks = encode(flat, lengths, words, params.mark_ids)
    return pd.DataFrame({"shard": [shard], "seq": [seq], "n_ids": [len(flat)], "docs": [np.array([NO_ID if z else d for d, z in zip(docs, none)], "<i8").tobytes()],
                         "lens": [np.array([len(x) for x in ids], "<i8").tobytes()], "nulls": [np.array(none, np.uint8).tobytes()],
                         "bits": [bits], "marks": [marks.astype("<i8").tobytes()]})


def read_documents(spark, target: str, params: HuffmanParams = HuffmanParams()) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the table; ``start`` counts the ids before it and
    ``ids`` holds its ids as little-endian unsigned 32-bit integers."""
    blocks = spark.read.parquet(f"{target}/blocks")
    code = spark.read.parquet(f"{target}/code").toPandas()  # at most one row per id of the vocabulary
    lengths = np.zeros(int(code["id"].max()) + 1 if len(code) else 0, np.int64)
    lengths[code["id"].to_numpy()] = code["bits"].to_numpy()
    sent = spark.sparkContext.broadcast(lengths)

    # ids before each block: a running sum over shards (few), then inside each shard
    from pyspark.sql import Window

    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("shard", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    placed = offsets.join(base, "shard").select(F.col("shard").alias("s"), F.col("seq").alias("q"), (F.col("inside") + F.col("base")).alias("start"))
    whole = blocks.join(placed, (F.col("shard") == F.col("s")) & (F.col("seq") == F.col("q"))).drop("s", "q")

    def documents(batches):
        lens_ = sent.value
        table = look_up(lens_, canonical(lens_), params.max_bits)
        for pdf in batches:
            for r in pdf.itertuples():
                flat = decode(r.bits, np.frombuffer(r.marks, "<i8"), r.n_ids, params.mark_ids, table, params.max_bits)
                n = np.frombuffer(r.lens, "<i8")
                ends = np.cumsum(n)
                ids = pd.array(np.frombuffer(r.docs, "<i8"), "Int64")
                ids[np.frombuffer(r.nulls, np.uint8) == 1] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": r.start + ends - n, "n_tokens": n, "ids": [flat[a:b].astype("<u4").tobytes() for a, b in zip(ends - n, ends)]})

    return whole.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids binary")


