"""Per-host wait times as keyed state of a stateful streaming operator.

Responses arrive as Parquet files.  ``transformWithStateInPandas`` keeps, per
host, the wait of its last response (by ``fetched_at``) in the state store; a
micro-batch touches the hosts it brings and gives out those whose wait changed,
which are appended to a table of changes (newest wins at read).  Nothing stored
is rewritten.

With ``forget_after`` a timer drops a host's state that long after both its last
response and the end of its wait, in event time; responses that come later than
that after a newer one are then dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spindex.operators import politeness as po
from spindex.operators.responses import good_responses
from spindex.sources.log_table import LogTable
from spindex.sources.responses import RESPONSES_SCHEMA
from spindex.streaming.state import scratch_dir

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAIT = "next_allowed_us BIGINT, fetched_us BIGINT"
OUT = f"host_key STRING, {WAIT}"


class HostWaits(StatefulProcessor):
    """Value state: the wait of the host's last response, in microseconds."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wait = handle.getValueState("wait", WAIT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.wait.get() if self.wait.exists() else None
        best = None if before is None else (before[1], before[0])
        for part in rows:
            last = max(zip(part["fetched_us"], part["next_allowed_us"]))
            best = last if best is None else max(best, last)
        fetched, allowed = int(best[0]), int(best[1])
        if before is not None and (before[0], before[1]) == (allowed, fetched):
            return
        self.wait.update((allowed, fetched))
        if self.forget_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max(allowed, fetched) // 1000 + self.forget_ms)
        yield pd.DataFrame({"host_key": [key[0]], "next_allowed_us": [allowed], "fetched_us": [fetched]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.wait.clear()
        return iter([])

    def close(self) -> None:
        pass


def waits_log(spark: SparkSession, state_dir: str) -> LogTable:
    return LogTable(spark, f"{state_dir}/waits", OUT, "host_key", newest="fetched_us")


def load_waits(spark: SparkSession, state_dir: str) -> DataFrame:
    """``(host_key, next_allowed_at, fetched_at)``: the last wait of every host seen."""
    rows = waits_log(spark, state_dir).current()
    return rows.select("host_key", F.timestamp_micros("next_allowed_us").alias("next_allowed_at"),
                       F.timestamp_micros("fetched_us").alias("fetched_at"))


def run_wait_stream(spark: SparkSession, source_dir: str, rules: DataFrame, state_dir: str | None = None,
                    files_per_trigger: int = 1, forget_after: str | None = None) -> str:
    """Drain ``source_dir``; the waits are then in :func:`load_waits`.  Returns the state folder.

    ``forget_after`` is an interval (``"1 hour"``); a later call with the same folder goes on.
    """
    state_dir = state_dir or scratch_dir(spark, "wait-state")
    stream = (spark.readStream.schema(RESPONSES_SCHEMA)
              .option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir))
    forget_ms = None
    if forget_after:
        stream = stream.withWatermark("fetched_at", forget_after)
        forget_ms = int(pd.Timedelta(forget_after).total_seconds() * 1000)
    events = po.wait_events(good_responses(stream), rules)
    narrow = events.select("host_key", "fetched_at", F.unix_micros("next_allowed_at").alias("next_allowed_us"),
                           F.unix_micros("fetched_at").alias("fetched_us"))
    changed = narrow.groupBy("host_key").transformWithStateInPandas(
        statefulProcessor=HostWaits(forget_ms), outputStructType=OUT, outputMode="Update",
        timeMode="EventTime" if forget_after else "None")
    log = waits_log(spark, state_dir)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)  # read when the query starts
    try:
        q = (changed.writeStream.outputMode("update").foreachBatch(lambda rows, epoch: log.append(rows, epoch))
             .option("checkpointLocation", f"{state_dir}/_stream").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return state_dir
