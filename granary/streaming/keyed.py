"""Streams with state of their own for each key: first samples, event logs, leases.

State and timers are Spark's (``transformWithStateInPandas`` on RocksDB). Results go to tables, a folder for each
micro-batch that a repeated batch replaces, so a restart from the checkpoint neither loses nor doubles a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HOUR_MS = 3_600_000


def to_table(stream: DataFrame, folder: str, checkpoint: str, *, mode: str = "update", every: str | None = None) -> StreamingQuery:
    """Starts a stream into a table; without ``every`` it takes what is there now and ends."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(folder)

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class FirstSamples(StatefulProcessor):
    """For a volume and hour: passes a sample on if its event is the lowest seen of its minute. The state is one array of 60 events."""

    def __init__(self, late_ms: int):
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.least = handle, handle.getValueState("least", "ids array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(rows)
        firsts = arrived.sort_values("event_id").drop_duplicates("minute")
        if self.least.exists():
            known = list(self.least.get()[0])
        else:
            known = [None] * 60
            self.handle.registerTimer(int(key[1]) * _HOUR_MS + _HOUR_MS + self.late_ms)
        better = [known[m] is None or i < known[m] for m, i in zip(firsts["minute"], firsts["event_id"])]
        found = firsts[better]
        for m, i in zip(found["minute"], found["event_id"]):
            known[m] = int(i)
        if len(found):
            self.least.update((known,))
        yield found.drop(columns=["minute", "hour", "ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.least.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_samples(samples: DataFrame, late: str = "1 day", late_ms: int = 24 * _HOUR_MS) -> DataFrame:
    """A changelog of the first sample of each volume and minute, as samples arrive: of rows for one minute the one with the lowest event_id holds.

    Hours are keys of their own, so a volume of very many samples is not one key; state goes when the watermark
    has passed an hour by ``late``, as do samples that come later still.
    """
    seconds = F.unix_seconds("sample_time")
    keyed = samples.withWatermark("ts", late).withColumns({"hour": F.floor(seconds / 3600).cast("long"), "minute": F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("int")})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.schema if f.name != "ts")
    return keyed.groupBy("volume_id", "hour").transformWithStateInPandas(FirstSamples(late_ms), schema, "Update", "eventTime")


class EventLog(StatefulProcessor):
    """Numbers the events of a job in the order they arrive."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sequence long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(rows).sort_values("event_id")
        last = self.last.get()[0] if self.last.exists() else 0
        arrived["sequence"] = range(last + 1, last + 1 + len(arrived))
        self.last.update((last + len(arrived),))
        yield arrived

    def close(self) -> None:
        pass


def event_log(events: DataFrame) -> DataFrame:
    """events (job_id, event_id, type) with sequence: from 1 in each job, without gaps, across batches and restarts."""
    return events.select("job_id", "event_id", "type").groupBy("job_id").transformWithStateInPandas(EventLog(), "job_id long, event_id long, type string, sequence long", "Append", "None")


class Leases(StatefulProcessor):
    """A message that is claimed and neither sent nor claimed anew before its lease ends is free again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for at, action, lease_ms in pd.concat(rows).sort_values("at")[["at", "action", "lease_ms"]].itertuples(index=False):
            now = int(at.timestamp() * 1000)
            held = self.until.get()[0] if self.until.exists() else None
            if held is not None and held <= now:
                out.append((key[0], "expired", pd.Timestamp(held, unit="ms")))
                self._free(held)
                held = None
            if action == "claim" and held is None:
                self.until.update((now + int(lease_ms),))
                self.handle.registerTimer(now + int(lease_ms))
                out.append((key[0], "claimed", at))
            elif action == "sent" and held is not None:
                self._free(held)
                out.append((key[0], "sent", at))
            else:
                out.append((key[0], "refused", at))
        yield pd.DataFrame(out, columns=["id", "state", "at"])

    def _free(self, held: int) -> None:
        self.handle.deleteTimer(held)
        self.until.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.until.get()[0] if self.until.exists() else None
        if held != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.until.clear()
        yield pd.DataFrame([(key[0], "expired", pd.Timestamp(held, unit="ms"))], columns=["id", "state", "at"])

    def close(self) -> None:
        pass


def leases(actions: DataFrame, late: str = "0 seconds") -> DataFrame:
    """actions (id, at, action: claim or sent, lease_ms) as states: claimed, sent, refused, and expired at the end of a lease."""
    return actions.select("id", "at", "action", "lease_ms").withWatermark("at", late).groupBy("id").transformWithStateInPandas(Leases(), "id long, state string, at timestamp", "Update", "eventTime")
