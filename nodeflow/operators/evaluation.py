"""Evaluation of trained nodes from losses and stored metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeflow.operators.provenance import latest_by
from nodeflow.operators.ranking import keyed_rank, sliced
from nodeflow.params import Params
from nodeflow.session import cut

METRICS = ("perplexity", "validation_loss", "thematic_coherence")


def validation_split(texts: DataFrame, params: Params, key: str, order: str, *ties: str) -> DataFrame:
    """Last part of each key's texts; all of them when there are too few to split."""
    if params.validation_split <= 0:
        return texts
    start = F.floor(F.col("n") * (1 - params.validation_split))
    keep = (F.col("n") <= params.eval_min_texts) | (F.col("rank") > start)
    return keyed_rank(texts, [key], order, *ties).where(keep).drop("rank", "n")


def perplexity_rollup(losses: DataFrame, params: Params, key: str, order: str, *ties: str, asked: DataFrame | None = None) -> DataFrame:
    """losses(key, order, loss): mean over batches of the batch means, and its exponential.

    With ``asked(key)`` the result has one row for each of its keys; a key without batches has infinite values.
    """
    batch = F.floor((F.col("rank") - 1) / params.eval_batch_size)
    per_batch = keyed_rank(losses, [key], order, *ties).groupBy(key, batch.alias("_batch")).agg(
        F.avg("loss").alias("_loss"))
    out = per_batch.groupBy(key).agg(
        F.avg("_loss").alias("validation_loss"), F.exp(F.avg("_loss")).alias("perplexity"),
        F.count("*").alias("n_batches"))
    if asked is None:
        return out
    keys = asked.select(F.col(key).alias("_asked")).distinct()
    return keys.join(out, F.col("_asked").eqNullSafe(F.col(key)), "left").select(
        F.col("_asked").alias(key), without_batches(F.col("validation_loss")).alias("validation_loss"),
        without_batches(F.col("perplexity")).alias("perplexity"), F.coalesce("n_batches", F.lit(0)).alias("n_batches"))


def without_batches(value: Column) -> Column:
    return F.coalesce(value, F.lit(float("inf")))


def confidence(step_scores: Column) -> Column:
    """array<array<double>> of scores per step -> mean of the largest softmax share; 0 without steps."""
    def top(scores: Column) -> Column:
        m = F.array_max(scores)
        return 1.0 / F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))

    total = F.aggregate(F.transform(step_scores, top), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(step_scores) > 0, total / F.size(step_scores)).otherwise(F.lit(0.0))


def eval_summary(metrics: DataFrame, by: str = "metric_name", value: str = "metric_value") -> DataFrame:
    """min, max, mean and upper median per metric."""
    base = metrics.where(F.col(value).isNotNull())
    stats = base.groupBy(by).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"),
                                 F.avg(value).alias("avg_value"), F.count("*").alias("n"))
    medians = upper_median(base, by, value).withColumnRenamed(by, "_by")
    return stats.join(medians, F.col(by).eqNullSafe(F.col("_by"))).select(
        by, "n", "min_value", "max_value", "avg_value", "median_value")


def upper_median(table: DataFrame, by: str, value: str, slices: int | None = None) -> DataFrame:
    """sorted(values)[n // 2] per key, exact; infinite values count, NaN is the largest, a null key is a key.

    Equal values are counted first, so copies cannot pile up. The counts lie in slices of the
    value; sums per slice name the one that holds the middle, and only that slice is ordered.
    """
    counts = cut(table.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c")))
    parts = sliced(counts, value, slices)
    per_slice = parts.groupBy(by, "_slice").agg(F.sum("_c").alias("_s"))
    upto = F.sum("_s").over(W.partitionBy(by).orderBy("_slice"))
    want = F.floor(F.sum("_s").over(W.partitionBy(by)) / 2)
    middle = per_slice.withColumns({"_upto": upto, "_want": want}).where("_upto > _want AND _upto - _s <= _want").select(
        F.col(by).alias("_by"), F.col("_slice").alias("_at"), (F.col("_want") - F.col("_upto") + F.col("_s")).alias("_want"))
    inside = parts.join(middle, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_slice") == F.col("_at")))
    running = F.sum("_c").over(W.partitionBy(by).orderBy(value))
    return inside.withColumn("_run", running).where("_run > _want").groupBy(by).agg(F.min(value).alias("median_value"))


def top_adapters(metrics: DataFrame, n: int = 5) -> DataFrame:
    """Lowest perplexity first; a missing one counts as infinite."""
    return metrics.withColumn("perplexity", F.coalesce("perplexity", F.lit(float("inf")))).orderBy(
        "perplexity", "node_id").limit(n)


def eval_outcomes(nodes: DataFrame, params: Params) -> DataFrame:
    """nodes(is_trained, n_texts, error): evaluated / failed / skipped counts and the skip reasons."""
    untrained = ~F.col("is_trained")
    few = F.coalesce("n_texts", F.lit(0)) < params.eval_min_texts
    skipped = untrained | few
    failed = ~skipped & F.col("error").isNotNull()
    return nodes.agg(
        F.count("*").alias("total_nodes"), F.count_if(~skipped & ~failed).alias("evaluated"),
        F.count_if(failed).alias("failed"), F.count_if(skipped).alias("skipped"),
        F.count_if(untrained).alias("skipped_untrained"), F.count_if(~untrained & few).alias("skipped_few_texts"))


def metrics_melt(wide: DataFrame) -> DataFrame:
    """wide(node_id, status, n_texts, at, metrics) -> one row per metric of the successful evaluations."""
    meta = F.to_json(F.struct(F.col("n_texts").alias("num_texts")))
    long = wide.where("status = 'success'").select("node_id", "at", meta.alias("metadata"), *METRICS).unpivot(
        ["node_id", "at", "metadata"], list(METRICS), "metric_name", "metric_value")
    return long.where(F.col("metric_value").isNotNull()).select(
        "node_id", "metric_name", "metric_value", F.col("at").alias("evaluation_timestamp"), "metadata")


def latest_metrics(metrics: DataFrame) -> DataFrame:
    return latest_by(metrics, ["node_id", "metric_name"], [F.col("evaluation_timestamp"), F.col("metric_value")])


def forgetting_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two snapshots (node_id, perplexity) -> averages and the mean change of nodes in both."""
    both = before.select("node_id", F.col("perplexity").alias("b")).join(
        after.select("node_id", F.col("perplexity").alias("a")), "node_id")
    return both.agg(F.count("*").alias("n_nodes"), F.avg("b").alias("avg_before"), F.avg("a").alias("avg_after"),
                    F.avg(F.col("a") - F.col("b")).alias("avg_drift"))
