"""Rows of a stream, each key once, over a past without bounds.

The stream itself holds no state. Keys lie in a log beside one Bloom filter per block of keys (4 KB, built by
Spark's bitmap aggregates). A batch reads the filters of the blocks it touches; only keys the filter may have seen
are looked up in the log, so a filter can cost a look-up but never a row. A batch writes its new keys and the filters
it changed, and counts once its commit is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nodeflow.operators.state import StateStore
from nodeflow.session import cut

BITS = 32768  # of a filter: what Spark's bitmap aggregates build
_HASHES = 4  # 15 bits each of one 64-bit hash
LOGS = {"keys": ["block", "key"], "filters": ["block"]}
NOTES = "version bigint, new bigint, looked_up bigint, known bigint"


def _places(key: Column) -> Column:
    """Bit positions of a key in the filter of its block."""
    h = F.xxhash64(F.lit("place"), key)
    return F.array(*[F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BITS - 1)) for i in range(_HASHES)])


def _has(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def _same(a: str, b: str) -> Column:
    return (F.col(f"{a}.block") == F.col(f"{b}.block")) & F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key"))


def distinct_step(store: StateStore, version: int, batch: DataFrame, keys: list[str], blocks: int = 4096) -> None:
    """Write those rows of ``batch`` whose key no earlier version has, one per key.

    Null keys equal each other. Which of several rows of one batch stays is open, as for dropDuplicates.
    ``blocks`` has to stay the same for a state; a block holds some 3,000 keys before its filter lets
    more than a few percent of new keys through to the look-up.
    """
    if store.committed(version):
        return
    key = F.struct(*[F.col(k) for k in keys])
    once = cut(batch.dropDuplicates(keys).select(F.struct("*").alias("row"), key.alias("key")).withColumn(
        "block", F.pmod(F.xxhash64("key"), F.lit(blocks))))
    touched = [r[0] for r in once.select(store.bucket_of(F.col("block"))).distinct().collect()]  # at most store.buckets
    filters = store.read_log("filters", LOGS["filters"], buckets=touched)
    looked_up = known = 0
    fresh = once
    if filters is not None:
        seen = once.select("block").distinct()
        filters = cut(filters.join(seen, "block", "left_semi"))
        maybe = F.coalesce(F.forall(_places(F.col("key")), lambda p: _has(F.col("bitmap"), p)), F.lit(False))
        asked = cut(once.join(filters, "block", "left").withColumn("maybe", maybe).drop("bitmap"))
        doubtful = asked.where("maybe").select("block", "key")
        buckets = [r[0] for r in doubtful.select(store.bucket_of(F.col("block"))).distinct().collect()]
        fresh = asked.drop("maybe")
        if buckets:
            log = store.read_log("keys", LOGS["keys"], buckets=buckets, unchanging=True)
            # the batch's side is the small one: the log is only scanned
            old = cut(log.alias("l").join(doubtful.alias("d"), _same("l", "d"), "left_semi"))
            looked_up, known = doubtful.count(), old.count()
            fresh = asked.alias("a").join(old.alias("o"), _same("a", "o"), "left_anti").drop("maybe")
    fresh = cut(fresh)
    bitmap = fresh.select("block", F.explode(_places(F.col("key"))).alias("place")).groupBy("block").agg(
        F.bitmap_construct_agg("place").alias("bitmap"))
    if filters is not None:
        changed = filters.join(bitmap.select("block"), "block", "left_semi")
        bitmap = bitmap.unionByName(changed).groupBy("block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    added = Observation()
    out = fresh.observe(added, F.count(F.lit(1)).alias("new")).select("row.*")
    store.write(version, {"once": out}, {"keys": (fresh.select("block", "key"), LOGS["keys"]), "filters": (bitmap, LOGS["filters"])},
                lambda: {"new": added.get["new"], "looked_up": looked_up, "known": known})


def stream_distinct(rows: DataFrame, keys: list[str], state_path: str, checkpoint: str, every: str | None = None,
                    blocks: int = 4096, compact_every: int = 20, retain: int = 20) -> StreamingQuery:
    """Rows of a stream, each key once, however late it comes again. Read them with ``distinct_rows``."""
    from nodeflow.streaming.ingest import _start, _stream_id

    def step(batch: DataFrame, batch_id: int) -> None:
        store = StateStore(batch.sparkSession, state_path)
        store.claim(_stream_id(batch.sparkSession, checkpoint))
        distinct_step(store, batch_id, batch, keys, blocks)
        if (batch_id + 1) % compact_every == 0:
            store.compact(LOGS, retain)

    return _start(rows, step, checkpoint, every)


def distinct_rows(spark: SparkSession, state_path: str) -> DataFrame | None:
    """What all committed versions let through."""
    store = StateStore(spark, state_path)
    folders = [f"{store.root}/data/version={v}/once" for v in store.versions()]
    return spark.read.parquet(*folders) if folders else None


def distinct_progress(spark: SparkSession, state_path: str) -> DataFrame:
    """Per version: new keys, keys the filters sent to the look-up, and those of them that were known."""
    return StateStore(spark, state_path).commits(NOTES)
