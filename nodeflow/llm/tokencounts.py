"""Token counts of byte-level BPE without making ids of texts.

BPE never merges across pre-tokens, so the tokens of a text are the sum over its pre-tokens. Texts are
taken in blocks: the frequencies of each document's pre-tokens point into the block's list of distinct
pre-tokens, the vocabulary counts the pieces of each distinct one once, and a join of the two by index
sums them per document. A block-wise join moves no row between machines; one over the whole corpus would
shuffle every pair of document and pre-token, which is more than the texts themselves.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed value: the pre-token pattern of byte-level BPE vocabularies
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _pieces(vocabulary, distinct: list[str]) -> np.ndarray:
    """Pieces of each pre-token: its byte-level form goes to the model alone."""
    pre, model = vocabulary.pre_tokenizer.pre_tokenize_str, vocabulary.model.tokenize
    return np.fromiter((sum(len(model(x)) for x, _ in pre(p)) for p in distinct), np.int64, len(distinct))


def block_counts(texts: list[str | None], vocabulary, pattern, special) -> np.ndarray:
    """Tokens of each text of a block. Strings of added tokens count as one token each."""
    index: dict[str, int] = {}
    at: list[int] = []
    ends = np.zeros(len(texts), np.int64)
    extra = np.zeros(len(texts), np.int64)
    find, place = pattern.findall, index.setdefault
    for k, t in enumerate(texts):
        if t:
            parts = special.split(t) if special else [t]
            extra[k] = len(parts) - 1
            for part in parts:
                at.extend([place(p, len(index)) for p in find(part)])
        ends[k] = len(at)
    pieces = _pieces(vocabulary, list(index))
    total = np.concatenate(([0], np.cumsum(pieces[np.array(at, np.int64)]))) if at else np.zeros(1, np.int64)
    return np.diff(total[ends], prepend=0) + extra


def token_counts(rows: DataFrame, path: str, text: str = "text", limit: int = 512, block_chars: int = 32_000_000) -> DataFrame:
    """All columns of ``rows`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    ``path`` names the file of a byte-level BPE vocabulary of the tokenizers library, present on every
    executor. Begin and end tokens are not added; nothing is truncated. A null or empty text has no bytes
    and no tokens. Columns of the three new names are replaced. Rows keep their order and number. A block
    closes at ``block_chars`` characters or at the end of an Arrow batch; this never changes a count.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    kept = rows.select(*[c for c in rows.columns if c not in new])

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import json
        import re

        import regex
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        kind = described["pre_tokenizer"]
        if described["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
            raise ValueError("a byte-level vocabulary without normalizer and prefix space is needed")
        added = sorted((x["content"] for x in described["added_tokens"]), key=len, reverse=True)
        special = re.compile("|".join(map(re.escape, added))) if added else None
        pattern = regex.compile(PRE_TOKEN)
        for texts in batches:
            counts, block, size = [], [], 0
            for t in texts:
                block.append(t)
                size += len(t or "")
                if size >= block_chars:
                    counts.append(block_counts(block, vocabulary, pattern, special))
                    block, size = [], 0
            counts.append(block_counts(block, vocabulary, pattern, special))
            yield pd.Series(np.concatenate(counts))

    tokens = count(F.col(text))
    counted = kept.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("n_tokens", tokens)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
