"""Streaming forms of the monitoring operators, and their batch twins.

Every ``*_batch`` function returns the rows the stream ends up with when it has
read the same input to the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tablewright.operators.quality import quality_metrics, threshold_alerts
from tablewright.session import fresh_folder, stage


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 16, pattern: str | None = None) -> DataFrame:
    """Parquet files as they arrive; event times become timestamps for watermarks."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    raw = (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)
    casts = {f.name: F.col(f.name).cast("timestamp") for f in raw.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return raw.withColumns(casts) if casts else raw


def drain(stream: DataFrame, mode: str = "append", keys: Sequence[str] = (), folder: str | None = None, progress: list | None = None) -> DataFrame:
    """Run a stream over the input there is and return what it wrote.

    ``append`` output is final as it comes. ``update`` output repeats a key
    whenever its value changes, so the last version of each key is kept. The
    progress of the micro-batches is added to ``progress``.
    """
    spark = stream.sparkSession
    out = folder or fresh_folder(spark, "stream")
    schema = T.StructType([*stream.schema.fields, T.StructField("_epoch", T.LongType())])

    def write(batch: DataFrame, epoch: int) -> None:
        # A repeated epoch after a failure overwrites its own folder: exactly once.
        batch.withColumn("_epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", fresh_folder(spark, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    written = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    if mode == "append":
        return written.drop("_epoch")
    rest = [c for c in written.columns if c not in keys and c != "_epoch"]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_epoch").alias("_r")).select(*keys, "_r.*")


# --- windows -----------------------------------------------------------------------------


def window_counts(df: DataFrame, time: str, value: str, length: str, slide: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Tumbling or sliding window aggregates; works on streams and tables alike."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return (
        df.groupBy(w, *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "total", "low", "high")
    )


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str]) -> DataFrame:
    """Runs of events closer than ``gap``."""
    return (
        df.groupBy(F.session_window(time, gap), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")
    )


def late_tolerant(df: DataFrame, time: str, delay: str, dedupe: Sequence[str] = ()) -> DataFrame:
    """Watermark a stream and drop repeated keys that arrive within the delay."""
    marked = df.withWatermark(time, delay)
    return marked.dropDuplicatesWithinWatermark(list(dedupe)) if dedupe else marked


# --- quality of a stream ---------------------------------------------------------------------


def quality_windows(df: DataFrame, time: str, length: str, checks: dict[str, Column]) -> DataFrame:
    """Share of rows passing each check per window, as ``(window_start, metric, value)``."""
    w = F.window(time, length)
    row = df.groupBy(w).agg(*[F.avg(c.cast("double")).alias(n) for n, c in checks.items()])
    cells = F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in checks]))
    return row.select(F.col("window.start").alias("window_start"), cells)


def monitor(
    stream: DataFrame,
    on_alerts: Callable[[DataFrame, int], None],
    checkpoint: str,
    thresholds: Sequence[tuple[str, str, float]],
    constraints: dict[str, dict[str, Any]] | None = None,
):
    """Score every micro-batch and hand the broken thresholds to ``on_alerts``.

    Runs until the available input is used up; restart it with the same
    checkpoint to go on from there.
    """

    def check(batch: DataFrame, epoch: int) -> None:
        metrics = quality_metrics(batch, constraints)
        names = [n for n, _, _ in thresholds if n in metrics.columns]
        cells = F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in dict.fromkeys(names)]))
        on_alerts(threshold_alerts(metrics.select(F.lit(epoch).alias("epoch"), cells), thresholds), epoch)

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- cooldown -----------------------------------------------------------------------------------

_SENT = "rule_id string, ts timestamp, alert_id long"
_STATE = "last_sent double"


def _pick(times: np.ndarray, cooldown: float, last: float) -> tuple[np.ndarray, float]:
    """Positions sent from sorted times, and the time of the last one sent.

    Jumps from one sent alert to the first that is far enough behind it.
    """
    sent = []
    i = 0 if last == -np.inf else int(np.searchsorted(times, last + cooldown, side="left"))
    while i < len(times):
        sent.append(i)
        last = float(times[i])
        i = int(np.searchsorted(times, last + cooldown, side="left")) if cooldown > 0 else i + 1
    return np.asarray(sent, dtype=int), last


def _seconds(s: pd.Series) -> np.ndarray:
    return s.to_numpy().astype("datetime64[us]").astype("int64") / 1e6


def cooldown_stream(alerts: DataFrame, minutes: float) -> DataFrame:
    """Alerts of a stream that are really sent: none within ``minutes`` of the last sent.

    State per rule is one number. alerts(rule_id, ts, alert_id).
    """
    width = minutes * 60.0

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -np.inf
        rows = pd.concat(list(frames)).sort_values(["ts", "alert_id"])
        sent, last = _pick(_seconds(rows["ts"]), width, last)
        state.update((float(last),))
        yield rows.iloc[sent][["rule_id", "ts", "alert_id"]]

    return alerts.groupBy("rule_id").applyInPandasWithState(step, _SENT, _STATE, "append", GroupStateTimeout.NoTimeout)


def cooldown_batch(alerts: DataFrame, minutes: float) -> DataFrame:
    """The same decision over a finished table, however many alerts one rule has.

    Alerts are range-partitioned by rule and time and fixed by a checkpoint.
    Each partition is decided from the state the one before it ends in; rounds
    repeat only until no end state changes, as decisions soon coincide whatever
    they started from. A partition is read in Arrow batches.
    """
    spark = alerts.sparkSession
    width = minutes * 60.0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(
        alerts.select("rule_id", F.col("ts").cast("timestamp").alias("ts"), "alert_id")
        .repartitionByRange(parts, "rule_id", "ts", "alert_id")
        .sortWithinPartitions("rule_id", "ts", "alert_id")
        .withColumn("part", F.spark_partition_id())
    )

    def walk(frames: Iterator[pd.DataFrame], starts: dict[int, tuple[str, float]]) -> Iterator[tuple[pd.DataFrame, int, str, float]]:
        rule, last = None, -np.inf
        for frame in frames:
            if frame.empty:
                continue
            part = int(frame["part"].iloc[0])
            if rule is None:
                rule, last = starts.get(part, (None, -np.inf))
            keep = []
            # Batches are sorted by rule, so each rule is one run of rows.
            names = frame["rule_id"].to_numpy()
            cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(names)]):
                if names[lo] != rule:
                    rule, last = names[lo], -np.inf
                sent, last = _pick(_seconds(frame["ts"].iloc[lo:hi]), width, last)
                keep.append(sent + lo)
            yield frame.iloc[np.concatenate(keep)], part, rule, last

    def ends(starts):
        def run(frames):
            out = None
            for _, part, rule, last in walk(frames, starts):
                out = (part, rule, last)
            if out is not None:
                yield pd.DataFrame([out], columns=["part", "rule_id", "last"])

        # One row per partition comes to the driver.
        rows = placed.mapInPandas(run, "part int, rule_id string, last double").collect()
        return {r["part"]: (r["rule_id"], r["last"]) for r in rows}

    starts: dict[int, tuple[str, float]] = {}
    while True:
        final = ends(starts)
        order = sorted(final)
        following = {b: final[a] for a, b in zip(order, order[1:])}
        if following == starts:
            break
        starts = following

    def emit(frames):
        for chosen, *_ in walk(frames, starts):
            yield chosen[["rule_id", "ts", "alert_id"]]

    return placed.mapInPandas(emit, _SENT)
