"""Questions about hashes between groups of documents, in packed rows.

Documents are dealt into groups of bounded size by a hash of the row. A group asks about its own sorted,
distinct hashes: it sends one packed row to each part of the hash space. A part sees what all groups sent
and replies to each group by position. Copies inside a group are merged before anything moves, so a hash
that a third of all rows hold is one entry per group. Texts travel once, compressed; hashes travel as
byte planes of differences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeflow.llm.base import NO_ID

HASH_BITS = 48  # of a hash in a question; a false meeting only makes a candidate
ASK = "part long, q long, body binary"
REPLY = "q long, part long, body binary"


def packed(x: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    import zstandard

    x = np.ascontiguousarray(x, np.uint64 if x.dtype.kind == "u" else np.int64)
    return len(x).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(b: bytes, dtype=np.int64) -> np.ndarray:
    import zstandard

    n = int.from_bytes(b[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[8:], max_output_size=8 * n + 1), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view(dtype)


def joined(*arrays: bytes) -> bytes:
    return b"".join(len(a).to_bytes(8, "little") + a for a in arrays)


def parted(b: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 8], "little")
        out.append(b[at + 8 : at + 8 + n])
        at += 8 + n
    return out


PART_BYTES = 64_000_000  # of text whose hashes meet in one part
PARTS = 256  # up to which there are as many parts as groups


def sizes(docs: DataFrame, text: str, group_bytes: int) -> tuple[int, int]:
    """Number of groups, and bits that number the parts of the hash space.

    An exchange moves groups x parts packed rows, so beyond ``PARTS`` the parts follow the bytes: 30 GB in
    groups of 4 MB are 7,500 x 512 rows.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    parts = max(min(groups, PARTS), -(-total // PART_BYTES))
    return groups, min(30, max(1, int(parts - 1).bit_length()))


def closed(docs: DataFrame, groups: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(q, doc_id, body): rows with their group, texts compressed."""
    q = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(groups))
    given = docs.select(q.alias("q"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def close(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            yield pd.DataFrame({"q": pdf["q"], "doc_id": pdf["doc_id"].astype("Int64"), "body": [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in pdf["text"]]})

    return given.mapInPandas(close, "q long, doc_id long, body binary")


def grouped(docs: DataFrame, groups: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(q, doc_id, body): rows by group, texts compressed."""
    return closed(docs, groups, text, doc_id).repartition(groups, "q")


def opened(pdf: pd.DataFrame) -> list[tuple[int, bytes]]:
    """(doc_id, text) of a group in an order that does not depend on how the rows came."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    ids = [NO_ID if x is None or x is pd.NA or x != x else int(x) for x in pdf["doc_id"].astype("Int64").tolist()]
    return sorted((d, press.decompress(b)) for d, b in zip(ids, pdf["body"]))


class Hashes:
    """Distinct hashes of a group, ascending, cut into parts."""

    def __init__(self, per_doc: list[np.ndarray], bits: int):
        self.flat = np.concatenate(per_doc) if per_doc else np.zeros(0, np.uint64)
        self.keys, self.inverse, self.counts = np.unique(self.flat, return_inverse=True, return_counts=True)
        part = (self.keys >> np.uint64(HASH_BITS - bits)).astype(np.int64)
        self.starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        self.parts = part[self.starts]
        self.ends = np.append(self.starts[1:], len(part)) if len(part) else self.starts

    def ask(self, q: int, flags: np.ndarray) -> pd.DataFrame:
        bodies = [joined(packed(np.diff(self.keys[a:b], prepend=np.uint64(0))), packed(flags[a:b].astype(np.int64))) for a, b in zip(self.starts, self.ends)]
        return pd.DataFrame({"part": self.parts, "q": q, "body": bodies})

    def live(self, replies: pd.DataFrame) -> np.ndarray:
        """Which keys the replies name."""
        out, at = np.zeros(len(self.keys), bool), dict(zip(self.parts.tolist(), self.starts.tolist()))
        for part, body in zip(replies["part"], replies["body"]):
            out[at[part] + np.cumsum(unpacked(body))] = True
        return out


def repeated(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the hashes asked about in one part, those that occur at least twice and are indexed somewhere.

    Flags: 1 occurs more than once in the group, 2 is indexed there."""
    bodies = [parted(b) for b in pdf["body"]]
    keys = [np.cumsum(unpacked(a, np.uint64)) for a, _ in bodies]
    flags = np.concatenate([unpacked(b) for _, b in bodies])
    _, inverse, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    times = times + np.bincount(inverse, flags & 1)
    live = ((times > 1) & (np.bincount(inverse, flags >> 1) > 0))[inverse]
    ends = np.cumsum([len(k) for k in keys])
    out = [(q, np.flatnonzero(live[e - len(k) : e])) for q, k, e in zip(pdf["q"], keys, ends)]
    out = [(q, packed(np.diff(x, prepend=0))) for q, x in out if len(x)]
    return pd.DataFrame({"q": [q for q, _ in out], "part": key[0], "body": [b for _, b in out]}).astype({"q": "int64", "part": "int64"})
