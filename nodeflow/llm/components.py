"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeflow.session import cut


def components(links: DataFrame, a: str = "a", b: str = "b", rounds_max: int = 60) -> DataFrame:
    """(node, root): every linked node with the smallest node it reaches. Null ends and loops are ignored.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): in each, nodes point to the
    smallest neighbour they know, so the rounds grow with the logarithm of the longest chain. Minima are
    aggregated before the shuffle; each round is cut with a checkpoint.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, mark = cut(edges), None
    for _ in range(rounds_max):
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        edges = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v"))).distinct()
