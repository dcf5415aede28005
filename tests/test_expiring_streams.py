"""Streams by event time: order of arrival, late rows, and state that goes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.session import fresh_folder
from tablewright.streaming import events, expiring

ALERT = "rule_id string, ts timestamp, alert_id long"


def arrive(spark, batches):
    """Each list of (rule, second, id) is one file; they come in this order."""
    folder = fresh_folder(spark, "arrivals")
    for rows in batches:
        spark.createDataFrame(rows, "rule_id string, s long, alert_id long").select("rule_id", F.timestamp_seconds("s").alias("ts"), "alert_id").coalesce(1).write.mode("append").parquet(folder)
    return events.read_stream(spark, folder, ALERT, files_per_trigger=1)


def plain(rows, width):
    want, last = set(), {}
    for rule, s, a in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        if rule not in last or s - last[rule] >= width:
            want.add(a)
            last[rule] = s
    return want


@pytest.mark.parametrize("minutes", [0.5, 20])
def test_cooldown_by_event_time(spark, minutes):
    """Alerts up to ten minutes out of order, one hot rule and a null one; decisions are those of sorted time."""
    rng = np.random.default_rng(3)
    times = np.sort(rng.integers(0, 12_000, 1500))
    rows = [("hot" if i % 3 else (f"r{i % 7}" if i % 2 else None), int(s), i) for i, s in enumerate(times)]
    arrival = sorted(rows, key=lambda r: r[1] + int(rng.integers(0, 300)))
    batches = [arrival[k : k + 400] for k in range(0, 1500, 400)]
    closing = [("end", 40_000, -1)]
    progress = []
    got = events.drain(expiring.cooldown_expiring(arrive(spark, [*batches, closing]), minutes, "10 minutes", 60), progress=progress)
    assert {r["alert_id"] for r in got.collect()} == plain(rows, minutes * 60)
    # All that is left is the closing alert, which the watermark has not passed.
    assert progress[-1]["stateOperators"][0]["numRowsDroppedByWatermark"] == 0
    assert left_over(progress) <= 3 < max(p["stateOperators"][0]["numRowsTotal"] for p in progress)


def left_over(progress):
    return progress[-1]["stateOperators"][0]["numRowsTotal"]


def test_late_alerts_are_dropped(spark):
    progress = []
    # A batch is late by the watermark that the one before it began with.
    batches = [[("a", 1000, 1), ("a", 5000, 2)], [("b", 5001, 5)], [("a", 100, 3), ("a", 4990, 4)], [("z", 50_000, 9)]]
    got = events.drain(expiring.cooldown_expiring(arrive(spark, batches), 1, "60 seconds", 10), progress=progress)
    # 3 is over an hour late; 4 comes after 2 but before it in time, so 2 is within its cooldown.
    assert {r["alert_id"] for r in got.collect()} == {1, 4, 5}
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 1


def test_frames_of_a_rule_are_never_joined(spark, monkeypatch):
    """A hot rule's alerts pass in Arrow batches, and only one bucket of them is held at a time."""
    rows = [("hot", 1000 + s, s) for s in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = events.drain(expiring.cooldown_expiring(arrive(spark, [rows, [("z", 50_000, -1)]]), 1, "60 seconds", 60)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["alert_id"] for r in got} == set(range(0, 3000, 60))


def test_closed_windows_leave_the_state(spark):
    progress = []
    batches = [[("a", 3600 * h + s, s) for s in range(0, 3600, 600)] for h in range(8)]
    late = events.late_tolerant(arrive(spark, batches), "ts", "30 minutes")
    got = events.drain(events.window_counts(late, "ts", "alert_id", "1 hour", keys=["rule_id"]), progress=progress).collect()
    assert sorted(r["n"] for r in got) == [6] * 7
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1
    assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in progress) == 7


def test_replay_keeps_every_row(spark):
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else i * 7) for i in range(100)], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r["id"] for r in spark.read.parquet(expiring.replay(rows, "ts", 5)).collect()) == list(range(100))
    assert spark.read.parquet(expiring.replay(rows.limit(0), "ts", 3)).count() == 0
