"""Language of a text: nearest of several centroids per language over TF-IDF character n-grams.

Every text becomes a unit vector of hashed n-gram weights (count times inverse document frequency).
Each language is split into a few spherical k-means clusters. A text gets the language of the centroid
with the largest cosine. A fifth of the sample is left out of the fit; a language rejects texts that lie
farther from it, by a margin, than nearly all of its left-out texts cut to a like length. Clusters of one
row are dropped. Texts shorter than the first cut say too little to be rejected;
those without a letter are rejected.

Only the model is fitted on a bounded sample (``sample_rows`` labelled rows in expectation, spread evenly
over the languages, chosen by a hash among distinct texts); prediction covers every row and whole texts.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    sizes: tuple[int, ...] = (1, 2, 3)
    dims: int = 8192
    clusters: int = 3
    sample_rows: int = 4000  # bound of the training sample; languages share it evenly
    languages_max: int = 500  # those with the most distinct texts are learned
    rounds: int = 8
    margin: float = 0.5  # rejected below this share of the smallest training cosine of the centroid, where few rows are left out
    cuts: tuple[int, ...] = (8, 32, 128, 512, 2048)  # characters of a text from which each floor holds
    low: float = 0.1  # quantile of the left-out cosines
    slack: float = 0.5  # rejected below this share of that quantile
    left_min: int = 20  # left-out texts that a floor of its own takes


def _letters() -> np.ndarray:
    """Lower-case letter of every code point of the basic plane, a space for all else."""
    chars = [chr(c) for c in range(0x10000)]
    return np.array([ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in chars], np.uint32)


def ngram_counts(text: str | None, table: np.ndarray, sizes: tuple[int, ...], dims: int, step: int = 1 << 20):
    """Hashed n-gram counts of a whole text, read in pieces; None if it holds no letter."""
    if not text:
        return None
    total, some, longest = np.zeros(dims, np.int64), False, max(sizes)
    for at in range(0, len(text), step):
        before = max(0, at - longest + 1) if at else 0
        points = np.frombuffer(text[before : at + step].encode("utf-32-le", "surrogatepass"), np.uint32)
        if points.max() >= 0x10000:
            far = np.unique(points[points >= 0x10000])
            is_letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in far])
            points = np.where(np.isin(points, far[~is_letter]), 32, points)
        low = np.where(points < 0x10000, table[np.minimum(points, 0xFFFF)], points)
        if before == 0 and at == 0:
            low = np.concatenate(([32], low))
        if at + step >= len(text):
            low = np.concatenate((low, [32]))
        low = low.astype(np.uint32)
        some = some or bool((low != 32).any())
        for n in sizes:
            skip = max(0, (at - before) - n + 1) if at else 0  # counted with the piece before
            part = low[skip:]
            k = len(part) - n + 1
            if k <= 0:
                continue
            h, seen = np.full(k, n, np.uint32), np.zeros(k, bool)
            for j in range(n):
                h = (h ^ part[j : j + k]) * np.uint32(0x9E3779B1)
                seen |= part[j : j + k] != 32
            total += np.bincount((h[seen] >> np.uint32(7)) % np.uint32(dims), minlength=dims)
    return total if some else None


@dataclass(frozen=True)
class LanguageModel:
    params: LanguageParams
    labels: tuple[str, ...]  # of each centroid
    centroids: np.ndarray  # centroid x dims, unit rows
    floors: np.ndarray  # smallest accepted cosine of each centroid, by the length of the text
    idf: np.ndarray

    def scores(self, counts: np.ndarray) -> np.ndarray:
        v = counts * self.idf
        return np.clip(self.centroids @ (v / np.linalg.norm(v, axis=-1, keepdims=True)).T, 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


Sparse = list[tuple[np.ndarray, np.ndarray]]  # places and weights of each row


def _pieces(rows: Sparse, dims: int, step: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """The rows as dense pieces, each with the number of its first row; only one piece is held at a time."""
    for at in range(0, len(rows), step):
        part = np.zeros((min(step, len(rows) - at), dims), np.float32)
        for k, (i, w) in enumerate(rows[at : at + step]):
            part[k, i] = w
        yield at, part


def _cosines(rows: Sparse, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([part @ centres.T for _, part in _pieces(rows, centres.shape[1])])


def _sums(rows: Sparse, near: np.ndarray, k: int, dims: int) -> np.ndarray:
    total = np.zeros((k, dims), np.float32)
    for at, part in _pieces(rows, dims):
        total += (near[at : at + len(part)] == np.arange(k)[:, None]).astype(np.float32) @ part
    return total


def _clusters(rows: Sparse, k: int, rounds: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, started from far-apart rows: unit centres and the cosine of each row to each."""
    middle = _unit(_sums(rows, np.zeros(len(rows), int), 1, dims))
    picked = [int(np.argmax(_cosines(rows, middle)))]
    dense = lambda r: next(_pieces([rows[r]], dims))[1]
    nearest = _cosines(rows, dense(picked[0]))[:, 0]
    while len(picked) < min(k, len(rows)):
        picked.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, _cosines(rows, dense(picked[-1]))[:, 0])
    centres = np.concatenate([dense(r) for r in picked])
    for _ in range(rounds):
        near = np.argmax(_cosines(rows, centres), axis=1)
        some = np.isin(np.arange(len(centres)), near)[:, None]
        centres = np.where(some, _unit(_sums(rows, near, len(centres), dims)), centres)
    return centres, _cosines(rows, centres)


def _learn(got: list[tuple[str, bytes, bytes]], params: LanguageParams, left: list[tuple[str, bytes, bytes, int]] = []) -> LanguageModel:
    """The model of labelled rows of n-gram counts (places, counts), which stay sparse. ``left`` are rows left
    out of the fit, each with the place of its length in ``cuts``."""
    got = sorted(got)
    known = np.zeros(params.dims, np.int64)
    for _, i, _ in got:
        known[np.frombuffer(i, "<u4")] += 1
    idf = (np.log((1 + len(got)) / (1 + known)) + 1).astype(np.float32)
    labels, centres, floors = [], [], []
    for name in sorted({x for x, _, _ in got}):
        def weighted(i, c):
            at = np.frombuffer(i, "<u4")
            w = np.frombuffer(c, "<f4") * idf[at]
            return at, w / np.linalg.norm(w)

        own = [weighted(i, c) for x, i, c in got if x == name]
        c, cosines = _clusters(own, params.clusters, params.rounds, params.dims)
        sizes = np.bincount(np.argmax(cosines, axis=1), minlength=len(c))
        if (sizes > 1).any():
            c, cosines = c[sizes > 1], cosines[:, sizes > 1]
        near, closest = np.argmax(cosines, axis=1), cosines.max(axis=1)
        floor = {}
        for k in range(len(params.cuts)):
            apart = [weighted(i, n) for x, i, n, at in left if x == name and at == k]
            if len(apart) >= params.left_min:
                floor[k] = params.slack * float(np.quantile(_cosines(apart, c).max(axis=1), params.low, method="lower"))
        for k in range(len(c)):
            labels.append(name)
            centres.append(c[k])
            widest = params.margin * float(closest[near == k].min()) if (near == k).any() else 0.0
            floors.append([0.0 if floor else widest, *[floor.get(j, widest) for j in range(len(params.cuts))]])
    stacked = np.stack(centres) if centres else np.zeros((0, params.dims), np.float32)
    return LanguageModel(params, tuple(labels), stacked, np.array(floors), idf)


def fit(rows: DataFrame, params: LanguageParams = LanguageParams(), text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from rows with a non-null language and a text with a letter.

    No such rows give a model that rejects everything. The sample is drawn by a hash of text and language
    against the number of distinct texts with a letter of the language, so repeated texts count once and
    retries draw the same rows. Every language keeps at least the text with its smallest hash. Of more than
    ``languages_max`` languages those with the fewest distinct texts are not learned.
    """
    labelled = rows.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t IS NOT NULL AND l IS NOT NULL").where(F.col("t").rlike(r"\p{L}"))
    labelled = labelled.withColumn("h", F.xxhash64("l", "t"))
    counts = labelled.select("l", "h").distinct().groupBy("l").agg(F.count("*").alias("texts"), F.min("h").alias("first")).orderBy(F.desc("texts"), "l").limit(params.languages_max).collect()
    if not counts:
        return LanguageModel(params, (), np.zeros((0, params.dims), np.float32), np.zeros((0, len(params.cuts) + 1)), np.ones(params.dims))
    each = max(1, params.sample_rows // len(counts))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(1.0, each / r["texts"]))])
    first = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], r["first"])])
    place = F.pmod("h", F.lit(1 << 30)) / F.lit(1 << 30)
    drawn = (place < F.coalesce(share[F.col("l")], F.lit(0.0))) | (F.col("h") == F.coalesce(first[F.col("l")], F.col("h") + 1))
    sample = labelled.where(drawn).dropDuplicates(["l", "t"])

    def features(batches):
        table = _letters()
        for pdf in batches:
            out = []
            for x, t, h in zip(pdf["l"], pdf["t"], pdf["h"]):
                apart = (h >> 30) % 5 == 0
                heads = [(k, t[:n]) for k, n in enumerate(params.cuts) if len(t) >= n] if apart else []
                out += [(x, at, c) for at, piece in [(-1 - apart, t), *heads] if (c := ngram_counts(piece, table, params.sizes, params.dims)) is not None]
            nz = [np.flatnonzero(c) for *_, c in out]
            yield pd.DataFrame({"l": [x for x, *_ in out], "at": [at for _, at, _ in out], "i": [i.astype("<u4").tobytes() for i in nz],
                                "c": [c[i].astype("<f4").tobytes() for (*_, c), i in zip(out, nz)]})

    got = [(r["l"], bytes(r["i"]), bytes(r["c"]), r["at"]) for r in sample.mapInPandas(features, "l string, at int, i binary, c binary").collect()]
    return _split(got, params)


def _split(got: list[tuple[str, bytes, bytes, int]], params: LanguageParams) -> LanguageModel:
    """Fit on the rows of place -1; those of place -2 and the heads of their texts are left out, but languages
    with too few of them are fitted on all rows."""
    apart = Counter(x for x, *_, at in got if at == -2)
    spared = {x for x, n in apart.items() if n >= params.left_min}
    fitted = [(x, i, c) for x, i, c, at in got if at == -1 or at == -2 and x not in spared]
    return _learn(fitted, params, [r for r in got if r[3] >= 0 and r[0] in spared])


def predict(rows: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of ``rows`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected`` appended.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. A text beyond the
    distance of its nearest centroid keeps that language and is marked as rejected. Ties go to the
    language that sorts first. Columns of the same three names are replaced.
    """
    new = ("lang_pred", "score", "rejected")
    kept = rows.select(*[c for c in rows.columns if c not in new])
    sent = kept.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, table = sent.value, _letters()
        for texts in batches:
            out = []
            for t in texts:
                c = ngram_counts(t, table, m.params.sizes, m.params.dims) if len(m.labels) else None
                if c is None:
                    out.append((UNKNOWN, 0.0, True))
                    continue
                s = m.scores(c.astype(np.float32))
                best = int(np.argmax(s))
                out.append((m.labels[best], float(s[best]), bool(s[best] < m.floors[best, bisect_right(m.params.cuts, len(t))])))
            yield pd.DataFrame(out, columns=list(new))

    return kept.withColumn("_judged", judge(F.col(text))).select(*kept.columns, *[F.col(f"_judged.{c}").alias(c) for c in new])


def held_out(doc_id: Column) -> Column:
    """Rows set apart for measuring: crc32 of the id as text leaves 2 when divided by 4; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
