"""Conversation state kept per key by the engine's own state store.

A batch reads and writes the state of the conversations it has messages of, and no other: a value
for the conversation and a map of the provider ids it has seen, which are forgotten after a time
to live. With changelog checkpoints the cost of a batch follows its messages, not the history. A
timer can tell when a conversation has gone quiet. The states are read back from the checkpoint, as of any
batch that it still holds; a run that ends or breaks off goes on from there.

A provider id counts once in its conversation, from the first delivery that arrives; copies that
come after the time to live count again. Messages without an id all count, messages without a
conversation none. The last message is the latest by time, then by id, whatever the order of
arrival: late ones are counted and don't overwrite.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
#: What a message is, what a conversation's state holds, and what an update says.
MESSAGE = "provider_id string, conversation string, ts timestamp, preview string"
_STATE = "last_us long, last_id string, preview string, unread long, timer_ms long"
UPDATE = "conversation string, kind string, last_us long, last_id string, preview string, unread long"
CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class Conversations(StatefulProcessor):
    """One conversation's messages into its state; updates of kind 'message', and of kind 'quiet' once nothing has come for quiet_ms."""

    def __init__(self, remember_ms: int = 7 * DAY_MS, quiet_ms: int | None = None):
        self.remember_ms, self.quiet_ms = remember_ms, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.seen = handle.getMapState("seen", "provider_id string", "first_us long", ttlDurationMs=self.remember_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, last_id, preview, unread, timer = self.state.get() if self.state.exists() else (None, "", None, 0, None)
        last = None if at is None else (at, last_id)
        for some in rows:
            # Within a batch the earliest copy of an id stands for it.
            some = some.sort_values("us", kind="stable")
            for us, provider_id, text in zip(some["us"].tolist(), some["provider_id"].tolist(), some["preview"].tolist()):
                if provider_id is not None:
                    if self.seen.containsKey((provider_id,)):
                        continue
                    self.seen.updateValue((provider_id,), (us,))
                unread += 1
                if last is None or (us, provider_id or "") > last:
                    last, preview = (us, provider_id or ""), text
        if last is None:
            return
        if self.quiet_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
            self.handle.registerTimer(timer)
        self.state.update((*last, preview, unread, timer))
        yield self._update(key, "message", last, preview, unread)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, last_id, preview, unread, _ = self.state.get()
        self.state.update((at, last_id, preview, unread, None))
        yield self._update(key, "quiet", (at, last_id), preview, unread)

    @staticmethod
    def _update(key: tuple, kind: str, last: tuple, preview: str | None, unread: int) -> pd.DataFrame:
        return pd.DataFrame({"conversation": [key[0]], "kind": [kind], "last_us": [last[0]], "last_id": [last[1]], "preview": [preview], "unread": [unread]})

    def close(self) -> None:
        pass


def updates(messages: DataFrame, remember_ms: int = 7 * DAY_MS, quiet_ms: int | None = None) -> DataFrame:
    """Updates of a stream of messages (provider_id, conversation, ts, preview): one a conversation and batch. Messages without a time or conversation go."""
    rows = messages.where("conversation is not null and ts is not null").select("provider_id", "conversation", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "preview")
    return rows.groupBy("conversation").transformWithStateInPandas(Conversations(remember_ms, quiet_ms), UPDATE, "Update", "ProcessingTime")


def start(messages: DataFrame, checkpoint: str, into: str | None = None, remember_ms: int = 7 * DAY_MS, quiet_ms: int | None = None):
    """Run a stream of messages until it has no more input. Updates go to a folder a batch below ``into``, overwritten if a batch runs again."""
    spark = messages.sparkSession
    # The state store is chosen when a query starts; a run until the input ends mustn't wait for timers.
    conf = CONF | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        writer = updates(messages, remember_ms, quiet_ms).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        if into is None:
            return writer.format("noop").start()
        return writer.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{into}/batch={number}")).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def states(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(conversation, last_at, last_id, preview, unread) as the state store of a checkpoint holds them after a batch, or after the last."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "state")
    held = (reader if batch is None else reader.option("batchId", batch)).load()
    return held.select(F.col("key.conversation").alias("conversation"), F.timestamp_micros("value.last_us").alias("last_at"), "value.last_id", "value.preview", "value.unread")


def seen(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(conversation, provider_id) of the ids that are remembered."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "seen").load()
    return held.select(F.col("key.conversation").alias("conversation"), F.col("user_map_key.provider_id").alias("provider_id"))
