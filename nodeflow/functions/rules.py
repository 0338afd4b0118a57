"""Business rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nodeflow.params import Params


def feedback(confidence: Column, params: Params) -> Column:
    """struct<status, delta_mass, delta_variance> from a confidence; a missing one counts as 0."""
    c = F.coalesce(confidence, F.lit(0.0))
    low, high = c < params.feedback_low, c >= params.feedback_high
    return F.struct(
        F.when(low, "NEW_BUFFER").otherwise("OK").alias("status"),
        F.when(low, 0.0).when(high, 1.0).otherwise(0.5).alias("delta_mass"),
        F.when(low, 0.0).when(high, -params.feedback_eta * c).otherwise(params.feedback_eta * (1 - c))
        .alias("delta_variance"),
    )


def apply_feedback(mass: Column, variance: Column, delta_mass: Column, delta_variance: Column) -> Column:
    """One event: the mass is cut to a whole number, both stay at or above 0."""
    return F.struct(
        F.greatest((mass + delta_mass).cast("bigint"), F.lit(0).cast("bigint")).alias("mass"),
        F.greatest(F.coalesce(variance, F.lit(0.0)) + delta_variance, F.lit(0.0)).alias("variance"),
    )


def training_epochs(mass: Column, variance: Column, n_texts: Column, parent_similarity: Column) -> Column:
    """Epochs from 1 to 7; heavy and inheriting nodes need fewer, small or loose ones more.

    The factors and limits are fixed values.
    """
    v = F.greatest(F.coalesce(variance, F.lit(0.0)), F.lit(0.0))
    spread = F.when(v == 0, 0.8).when(v > 1.5, 1.2).otherwise(1.0)
    tiny = F.when(mass < 5, 1.3).otherwise(1.0)
    texts = F.when(n_texts < 20, 1.2).when(n_texts > 100, 0.8).otherwise(1.0)
    inherited = F.when(parent_similarity > 0, F.greatest(F.lit(0.5), F.least(F.lit(1.0), 1 - parent_similarity * 0.5)))
    work = F.log1p(mass) * (1 + v) * spread * tiny * texts * F.coalesce(inherited, F.lit(1.0))
    epochs = F.floor(F.greatest(F.lit(1.0), F.least(F.lit(7.0), work * 0.5)))
    volume = F.when(mass > 200, F.greatest(F.lit(1), F.floor(epochs * 0.7))).otherwise(epochs)
    return F.when(mass <= 0, F.lit(2)).otherwise(volume).cast("int")


def training_priority(mass: Column, variance: Column) -> Column:
    return mass / (1 + F.greatest(F.coalesce(variance, F.lit(0.0)), F.lit(0.0)))


def training_mark(mass: Column, is_trained: Column, last_training_mass: Column, params: Params) -> Column:
    """'FIRST', 'RETRAIN' or null."""
    last = F.coalesce(last_training_mass, F.lit(0))
    again = is_trained & (last > 0) & (mass >= last * params.training_delta)
    if params.training_delta <= 0:
        again = F.lit(False)
    return F.when(~is_trained & (mass >= params.training_threshold), "FIRST").when(again, "RETRAIN")


def l2_lambda(inherits: Column, similarity: Column, params: Params) -> Column:
    base = params.inheritance_l2_base * (1 + similarity)
    return F.when(inherits & (similarity > 0),
                  F.when(similarity < params.strict_similarity, base * params.inheritance_l2_boost).otherwise(base)
                  ).otherwise(F.lit(0.0))


def learning_rate(inherits: Column, batch_size: Column, params: Params) -> Column:
    rate = params.learning_rate_base * F.sqrt(batch_size / params.lr_reference_batch)
    return F.when(inherits, rate * params.inheritance_lr_multiplier).otherwise(rate)


def strict_abort(inherits: Column, similarity: Column, params: Params) -> Column:
    return F.coalesce(inherits & (similarity < params.strict_similarity), F.lit(False))


def hours_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / 3_600_000_000.0


def quarantine_status(forced_root: Column, count: Column, last_exit: Column, as_of: Column, params: Params) -> Column:
    n = F.greatest(F.coalesce(count, F.lit(0)), F.lit(0))
    limit = F.when(n == 1, params.quarantine_hours_first).otherwise(params.quarantine_hours_later)
    return (
        F.when(F.coalesce(forced_root, F.lit(False)), "FORCED_ROOT")
        .when(n == 0, "NO_QUARANTINE")
        .when(last_exit.isNull(), "IN_QUARANTINE")
        .when(hours_between(last_exit, as_of) < limit, "IN_QUARANTINE")
        .otherwise("QUARANTINE_EXPIRED")
    )


def should_increment(last_exit: Column, failure_type: Column, progress: Column, as_of: Column, params: Params) -> Column:
    """A failure soon after leaving quarantine, caused by inheritance, early in the training."""
    soon = hours_between(last_exit, as_of) < params.quarantine_hours_first
    known = F.when((progress >= 0) & (progress <= 1), progress)
    return F.coalesce(soon, F.lit(False)) & failure_type.isin("PARENT_FAILED", "LIFE_INSURANCE") & (
        known.isNull() | (known < 0.5))


def artifact_problems(fmt: Column, data: Column, checksum: Column, params: Params) -> Column:
    """Array of rule names a stored artifact breaks; empty when it is sound."""
    size = F.octet_length(data)
    return F.array_compact(F.array(
        F.when(~F.coalesce(fmt.isin(*params.artifact_formats), F.lit(False)), "FORMAT"),
        F.when(F.coalesce(size, F.lit(0)) == 0, "EMPTY"),
        F.when(size > params.artifact_max_bytes, "TOO_LARGE"),
        F.when(~F.coalesce(F.sha2(data, 256) == checksum, F.lit(False)), "CHECKSUM"),
    ))


def parent_key() -> Column:
    """What a node looks its parent up by: roots get a key of their own that matches nothing, so that
    they, the majority, do not meet in one task as nulls."""
    return F.coalesce("parent_node_id", F.concat(F.lit("\0"), "node_id"))
