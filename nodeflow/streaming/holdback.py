"""Hold-back as a stateful processor: rows wait in the state of their node while it trains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

READY = "seq bigint, node_id string, released string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HoldBack(StatefulProcessor):
    """Per node: whether it trains, and the numbers of the rows that wait (a list in the state store).

    Of the rows of a batch those after a START wait that no END follows, whatever batch the START came in.
    An END releases all that wait. With ``limit_ms`` a timer ends a training that never reports its end.
    """

    def __init__(self, limit_ms: int | None = None):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.training = handle.getValueState("training", "timer bigint")
        self.held = handle.getListState("held", "seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seqs, starts, end = [], [], None
        for pdf in rows:
            seq, kind = pdf["seq"].to_numpy(np.int64), pdf["kind"].to_numpy()
            seqs.append(seq[kind == "ROW"])
            starts.append(seq[kind == "START"])
            ends = seq[kind == "END"]
            if len(ends):
                end = max(int(ends.max()), end if end is not None else int(ends.max()))
        seqs, starts = np.sort(np.concatenate(seqs)), np.concatenate(starts)
        trains = self.training.exists()
        if end is not None:
            if trains:
                yield from self._release(key, "END")
            starts = starts[starts > end]
            trains = False
        # with a training from before, all rows wait; else those after the first START that goes on
        since = -(2**63) if trains else (int(starts.min()) if len(starts) else None)
        waits = np.zeros(len(seqs), bool) if since is None else seqs > since
        yield self._frame(key, seqs[~waits], "AT_ONCE")
        if since is not None:
            if not trains:
                self._begin(timerValues)
            if waits.any():
                self.held.appendList([(int(x),) for x in seqs[waits]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, "LIMIT", expired=True)

    def _begin(self, timer_values) -> None:
        at = -1
        if self.limit_ms is not None:
            at = timer_values.getCurrentProcessingTimeInMs() + self.limit_ms
            self.handle.registerTimer(at)
        self.training.update((at,))

    def _release(self, key, why: str, expired: bool = False) -> Iterator[pd.DataFrame]:
        at = self.training.get()[0] if self.training.exists() else -1
        if at >= 0 and not expired:
            self.handle.deleteTimer(at)
        self.training.clear()
        part = []
        for (seq,) in self.held.get() if self.held.exists() else ():
            part.append(seq)
            if len(part) == 10_000:
                yield self._frame(key, np.array(part, np.int64), why)
                part = []
        self.held.clear()
        yield self._frame(key, np.array(part, np.int64), why)

    def _frame(self, key, seqs: np.ndarray, why: str) -> pd.DataFrame:
        texts = {"node_id": key[0], "released": why}
        return pd.DataFrame({"seq": seqs, **{c: np.full(len(seqs), x, object) for c, x in texts.items()}}).astype({c: object for c in texts})

    def close(self) -> None:
        pass


def holdback(rows: DataFrame, limit_ms: int | None = None) -> DataFrame:
    """Stream (seq, node_id, kind START|END|ROW) -> rows that may go on (seq, node_id, released).

    With ``limit_ms`` use a trigger that runs on: as long as timers are set, a stream over what is there never
    ends. ``released`` says whether a row went on at once, with the END of a training or after ``limit_ms``. Rows
    without a node never wait. Needs the state store ``STATE_STORE``. Where most rows wait for one node, the
    table form (``stream_holdback`` of ``ingest``) spreads them over tasks; here a node's rows meet in one.
    """
    free = rows.where("node_id IS NULL AND kind = 'ROW'").select("seq", "node_id", F.lit("AT_ONCE").alias("released"))
    kept = rows.where("node_id IS NOT NULL").groupBy("node_id").transformWithStateInPandas(
        statefulProcessor=HoldBack(limit_ms), outputStructType=READY, outputMode="Append", timeMode="ProcessingTime" if limit_ms is not None else "None")
    return kept.unionByName(free)
