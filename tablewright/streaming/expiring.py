"""Streams whose state ends: cooldown by event time, and the closed windows of a stream.

Decisions are taken in the order of event time, however alerts arrive within
the watermark's delay, and what can no longer matter leaves the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tablewright.session import fresh_folder, ship_package
from tablewright.streaming.events import _pick

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cooldown(StatefulProcessor):
    """Pending alerts of a rule in buckets of event time, and the time of the last one sent.

    A bucket is decided once the watermark has passed its end, as nothing can
    then be added to it. Buckets are read one at a time, so a hot rule holds one
    bucket in memory, not all it has pending. A rule's state goes when it has
    nothing pending and its cooldown has run out.
    """

    def __init__(self, cooldown_ms: int, bucket_ms: int) -> None:
        self.cooldown, self.bucket = cooldown_ms * 1000, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "bucket long", "times binary, ids binary")
        self.last = handle.getValueState("last", "sent long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            times = frame["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            ids = frame["alert_id"].to_numpy(dtype="int64")
            buckets = times // (self.bucket * 1000)
            for b in np.unique(buckets):
                mine, at = buckets == b, (int(b),)
                held = self.pending.getValue(at) if self.pending.containsKey(at) else (b"", b"")
                self.pending.updateValue(at, (bytes(held[0]) + times[mine].tobytes(), bytes(held[1]) + ids[mine].tobytes()))
                self.handle.registerTimer((int(b) + 1) * self.bucket)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        at = (now // self.bucket - 1,)
        last = self.last.get()[0] if self.last.exists() else None
        if self.pending.containsKey(at):
            held = self.pending.getValue(at)
            times, ids = (np.frombuffer(bytes(h), dtype="int64") for h in held)
            self.pending.removeKey(at)
            order = np.lexsort((ids, times))
            sent, final = _pick(times[order], self.cooldown, -np.inf if last is None else last)
            if len(sent):
                last = int(final)
                self.last.update((last,))
                chosen = order[sent]
                yield pd.DataFrame({"rule_id": [key[0]] * len(sent), "ts": pd.to_datetime(times[chosen], unit="us", utc=True), "alert_id": ids[chosen]})
        if last is None or next(iter(self.pending.keys()), None) is not None:
            return
        # What comes now is not older than the watermark, so a cooldown that ended before it decides nothing.
        ends = -(-(last + self.cooldown) // 1000)
        if ends <= timerValues.getCurrentWatermarkInMs():
            self.last.clear()
        else:
            self.handle.registerTimer(-(-ends // self.bucket) * self.bucket)


def cooldown_expiring(alerts: DataFrame, minutes: float, delay: str, bucket_seconds: float = 600.0) -> DataFrame:
    """Alerts of a stream that are sent: none of a rule within ``minutes`` of its last sent one, by event time.

    alerts(rule_id, ts, alert_id). Alerts may come in any order within
    ``delay``; later ones are dropped. Rows come out once the watermark has
    passed their bucket of ``bucket_seconds``, in the order of time and
    alert_id per rule, and are final. A null rule is a rule; alerts without a
    time or an id are left out. The session's streams then keep their state in
    RocksDB, which timers need.
    """
    spark = alerts.sparkSession
    ship_package(spark)
    spark.conf.set(PROVIDER, ROCKS)
    rows = alerts.select("rule_id", F.col("ts").cast("timestamp").alias("ts"), F.col("alert_id").cast("long").alias("alert_id")).dropna(subset=["ts", "alert_id"])
    return (
        rows.withWatermark("ts", delay)
        .groupBy("rule_id")
        .transformWithStateInPandas(
            statefulProcessor=Cooldown(round(minutes * 60_000), round(bucket_seconds * 1000)),
            outputStructType="rule_id string, ts timestamp, alert_id long",
            outputMode="append",
            timeMode="EventTime",
        )
    )


def replay(df: DataFrame, time: str, slices: int, folder: str | None = None) -> str:
    """A table as files that arrive one after the other, each a stretch of its time; returns their folder.

    Rows without a time come first. Each stretch is one filtered scan, written in
    the table's own partitions; a sorted or partitioned table reads only its part.
    """
    spark = df.sparkSession
    out = folder or fresh_folder(spark, "replay")
    at = F.col(time).cast("timestamp").cast("double")
    low, high = df.agg(F.min(at), F.max(at)).first()
    if low is None:
        low, high = 0.0, 0.0
    place = F.least(F.floor((at - low) / max(high - low, 1e-6) * slices), F.lit(slices - 1))
    for k in range(slices):
        df.filter(F.coalesce(place, F.lit(0)) == k).write.mode("append").parquet(out)
    return out
