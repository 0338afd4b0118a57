"""Lines repeated across sites are boilerplate and leave every document.

The spread of a line is its number of distinct sites. Sketches of the sites are merged per line hash; only
lines whose estimate lies near the threshold get an exact distinct count. Everything is DataFrame code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeflow.llm.base import hash128
from nodeflow.session import cut


@dataclass(frozen=True)
class LineParams:
    min_sites: int = 10  # distinct sites from which a line is boilerplate
    log_k: int = 12  # sketch size; relative error about 0.8 / sqrt(2 ** log_k)
    band: float = 0.15  # estimates this close to the threshold are counted exactly
    broadcast_lines: int = 1_000_000  # boilerplate lines up to which all are broadcast (24 bytes each)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(rows: DataFrame, params: LineParams = LineParams(), text: str = "text", site: str = "source") -> DataFrame:
    """Hashes (l1, l2) of the lines that occur on at least ``min_sites`` distinct sites, and their number n.

    Blank lines are never boilerplate. A null site is no site. A line is hot when many rows hold it, so
    its partial sketches (of bounded size) are merged before and after the shuffle.
    """
    lines = rows.where(F.col(text).isNotNull()).select(F.col(site).cast("string").alias("site"), F.explode(_lines(F.col(text))).alias("line"))
    l1, l2 = hash128("line")
    lines = lines.where((F.trim("line") != "") & F.col("site").isNotNull()).select(l1.alias("l1"), l2.alias("l2"), "site")
    spread = lines.groupBy("l1", "l2").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", params.log_k).alias("sketch"))
    near = spread.where(F.col("n") >= params.min_sites).select("l1", "l2", "n", F.hll_sketch_estimate("sketch").alias("sites"))
    low, high = params.min_sites * (1 - params.band), params.min_sites * (1 + params.band)
    sure = near.where(F.col("sites") > high).select("l1", "l2", "n")
    unsure = near.where(F.col("sites").between(low, high)).select(F.col("l1").alias("u1"), F.col("l2").alias("u2"))
    counted = (lines.join(unsure, (F.col("l1") == F.col("u1")) & (F.col("l2") == F.col("u2")), "left_semi")
               .groupBy("l1", "l2", "site").agg(F.count("*").alias("n"))
               .groupBy("l1", "l2").agg(F.count("*").alias("sites"), F.sum("n").alias("n")).where(F.col("sites") >= params.min_sites).select("l1", "l2", "n"))
    return sure.unionByName(counted)


def drop_boilerplate(rows: DataFrame, params: LineParams = LineParams(), text: str = "text", site: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``rows`` with ``text`` cleaned of boilerplate lines, and ``n_lines`` and ``n_removed`` appended.

    Kept lines stay in order, joined by line feeds; a text of which nothing stays is empty. A null text has
    no lines and stays null. Repeated rows are all cleaned and kept. Columns of the new names are replaced.
    """
    new = ("n_lines", "n_removed", "_gone")
    kept = rows.select(*[c for c in rows.columns if c not in new])
    k1, k2 = hash128(doc_id, text)
    common = cut(boilerplate(rows, params, text, site).select(F.col("l1").alias("b1"), F.col("l2").alias("b2"), "n"))
    l1, l2 = hash128("line")
    places = (rows.where(F.col(text).isNotNull()).select(k1.alias("d1"), k2.alias("d2"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
              .where(F.trim("line") != "").select("d1", "d2", "pos", l1.alias("l1"), l2.alias("l2")))
    same = (F.col("l1") == F.col("b1")) & (F.col("l2") == F.col("b2"))
    if common.count() <= params.broadcast_lines:
        met = places.join(F.broadcast(common), same, "left_semi")
    else:  # the lines of most rows are broadcast, so no other line holds over 1 / 1,000 of all
        hot = F.broadcast(common.orderBy(F.desc("n"), "b1", "b2").limit(1000))
        met = places.join(hot, same, "left_semi").unionByName(places.join(hot, same, "left_anti").join(common.hint("merge"), same, "left_semi"))
    gone = met.groupBy("d1", "d2").agg(F.collect_set("pos").alias("_gone"))
    # rows travel as one column, so their names cannot clash
    keyed = kept.select(F.struct("*").alias("_row"), k1.alias("_d1"), k2.alias("_d2"))
    marked = keyed.join(gone, (F.col("_d1") == F.col("d1")) & (F.col("_d2") == F.col("d2")), "left").select("_row.*", "_gone")
    lines = _lines(F.col(text))
    # positions that stay, found with a hash set, then looked up: one pass over the lines
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    clean = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda p: lines[p]), "\n"))
    return marked.select(*[clean.alias(text) if c == text else F.col(c) for c in kept.columns],
                         F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                         F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long").alias("n_removed"))
