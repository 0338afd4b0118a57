"""Structured Streaming entry points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nodeflow.operators.nodestats import node_stats
from nodeflow.operators.ranking import keyed_rank
from nodeflow.operators.state import StateStore
from nodeflow.params import Params
from nodeflow.plans.ingest import empty_state, process_batch
from nodeflow.session import cut

LOGS = {"nodes": ["node_id"], "buffers": ["buffer_id", "row_id"], "pointers": ["node_id", "source_id"]}
NOTES = "version bigint, rows bigint, refused bigint, nodes bigint, buffers bigint, waiting bigint, pointers bigint"


def current(spark: SparkSession, state_path: str, version: int | None = None) -> dict[str, DataFrame]:
    """Nodes, buffers and pointers as of a version (the last by default)."""
    store = StateStore(spark, state_path)
    if not store.versions():
        return empty_state(spark)
    return {name: store.read_log(name, keys, version) for name, keys in LOGS.items()}


def stream_ingest(rows: DataFrame, state_path: str, checkpoint: str, params: Params, every: str | None = None,
                  compact_every: int = 20, retain: int = 20) -> StreamingQuery:
    """Stream of (row_id, source_id, embedding, confidence) into a logged state.

    The batch id is the version: a batch that is run again finds its version and leaves. A batch writes the
    rows it touches, its decisions and its refused rows. Every ``compact_every`` versions the log is folded;
    the last ``retain`` versions stay readable.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = StateStore(spark, state_path)
        store.claim(_stream_id(spark, checkpoint))
        if store.committed(batch_id):
            return
        ranked = keyed_rank(batch, [], "row_id").drop("n")
        before = store.last_commit()
        out = process_batch(current(spark, state_path), ranked, params)
        pointers, added = _new_pointers(store, out["new_pointers"])

        def notes() -> dict:
            return {**out["counts"], "pointers": before.get("pointers", 0) + added.get["added"]}

        store.write(batch_id, {"refused": out["refused"], "decisions": out["decisions"].select(
            "row_id", "node_id", "decision", "score", "sim", "threshold")},
            {"nodes": (out["changed_nodes"], LOGS["nodes"]), "buffers": (out["changed_buffers"], LOGS["buffers"]),
             "pointers": (pointers, LOGS["pointers"])}, notes)
        if (batch_id + 1) % compact_every == 0:
            store.compact(LOGS, retain)

    return _start(rows, step, checkpoint, every)


def _new_pointers(store: StateStore, pointers: DataFrame) -> tuple[DataFrame, Observation]:
    """Pointers the state does not have, and their number once they are written. Only the buckets of the
    batch's nodes are read."""
    pointers, added = cut(pointers), Observation()
    buckets = [r[0] for r in pointers.select(store.bucket_of(F.col("node_id"))).distinct().collect()]  # at most store.buckets
    known = store.read_log("pointers", LOGS["pointers"], buckets=buckets)
    fresh = pointers if known is None else pointers.join(known, LOGS["pointers"], "left_anti")
    return fresh.observe(added, F.count(F.lit(1)).alias("added")), added


def stream_node_stats(rows: DataFrame, state_path: str, checkpoint: str, params: Params, every: str | None = None,
                      compact_every: int = 20, retain: int = 20) -> StreamingQuery:
    """Running statistics per node of a stream (node_id, embedding); read them with ``current_stats``.

    Spark's own aggregation state is used: it holds one mergeable moment per dimension and
    combines before the shuffle, so a node with most of the rows is no hot spot. A batch writes the nodes
    it changed.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        store = StateStore(batch.sparkSession, state_path)
        store.claim(_stream_id(batch.sparkSession, checkpoint))
        store.write(batch_id, changes={"stats": (batch, ["node_id"])})
        if (batch_id + 1) % compact_every == 0:
            store.compact({"stats": ["node_id"]}, retain)

    return (node_stats(rows, params).writeStream.outputMode("update").foreachBatch(step)
            .option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start())


def current_stats(spark: SparkSession, state_path: str, version: int | None = None) -> DataFrame | None:
    return StateStore(spark, state_path).read_log("stats", ["node_id"], version)


def stream_dedupe(rows: DataFrame, keys: list[str], out: str, checkpoint: str, event_time: str | None = None,
                  delay: str | None = None, every: str | None = None) -> StreamingQuery:
    """Rows of a stream, each key once. With an event time the state is bounded by the watermark."""
    if event_time is not None:
        once = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    else:
        once = rows.dropDuplicates(keys)
    return (once.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**_trigger(every)).start(out))


def holdback_step(state: dict[str, DataFrame], batch: DataFrame) -> dict[str, DataFrame]:
    """batch(seq, node_id, kind START|END|ROW): rows of nodes in training wait until it ends.

    A row waits when it comes after a START and no END of its node follows; where batches are cut does
    not matter as long as they follow ``seq``. Rows without a node never wait. Returns training (nodes in
    training), held (waiting rows) and ready (rows that may go on).
    """
    ends = batch.where("kind = 'END'").groupBy("node_id").agg(F.max("seq").alias("_end"))
    before = state["training"].join(ends, "node_id", "left_anti").select("node_id", F.lit(-2**63).cast("long").alias("since"))
    starts = batch.where("kind = 'START'").join(ends, "node_id", "left").where("_end IS NULL OR seq > _end").select(
        "node_id", F.col("seq").alias("since"))
    training = before.unionByName(starts).groupBy("node_id").agg(F.min("since").alias("since"))
    old = state["held"].select("seq", "node_id", F.lit(True).alias("_old"))
    rows = old.unionByName(batch.where("kind = 'ROW'").select("seq", "node_id", F.lit(False).alias("_old")))
    # what waited stays until an END, rows of this batch wait from the START on
    kept = rows.join(ends, "node_id", "left").join(training, "node_id", "left").withColumn("_held", F.coalesce(
        F.when(F.col("_old"), F.col("_end").isNull()).otherwise(F.col("seq") > F.col("since")), F.lit(False)))
    return {"training": training.select("node_id"), "held": kept.where("_held").select("seq", "node_id"),
            "ready": kept.where("NOT _held").select("seq", "node_id")}


def stream_holdback(rows: DataFrame, state_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Waiting rows live in state tables, not in one key's memory, so any number may wait for a node."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = StateStore(spark, state_path)
        store.claim(_stream_id(spark, checkpoint))
        if store.committed(batch_id):
            return
        if store.versions():
            state = {"training": store.read("training"), "held": store.read("held")}
        else:
            state = {"training": spark.createDataFrame([], "node_id string"),
                     "held": spark.createDataFrame([], "seq bigint, node_id string")}
        batch = batch.persist()
        store.write(batch_id, holdback_step(state, batch))
        batch.unpersist()

    return _start(rows, step, checkpoint, every)


def progress(spark: SparkSession, state_path: str) -> DataFrame:
    """What every batch noted: its rows and refused rows, and the nodes, buffers, waiting rows and pointers
    after it. One small row per batch is read, none of the state."""
    return StateStore(spark, state_path).commits(NOTES).withColumnRenamed("version", "batch")


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint keeps over restarts."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()[0]


def _trigger(every: str | None) -> dict:
    """Run on with a pause (such as "10 seconds") between batches, or take what is there and stop."""
    return {"processingTime": every} if every else {"availableNow": True}


def _start(rows: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()
