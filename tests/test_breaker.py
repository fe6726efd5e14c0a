"""The circuit breaker: golden runs, random logs against one state after another, batch and stream."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.streaming import breaker


def log_of(spark, rows):
    frame = spark.createDataFrame(rows, "source string, started_at string, run_id long, status string")
    return frame.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


GOLDEN = [("s", f"2024-01-01 00:{m:02d}:00", m, st) for m, st in enumerate(["error", "empty", "error", "error", "error"])] + [
    ("s", "2024-01-01 01:02:59", 8, "error"), ("s", "2024-01-01 01:03:00", 9, "error"), ("s", "2024-01-01 01:04:00", 10, "success"), ("s", "2024-01-01 01:05:00", 11, "error"),
]
#: Opened at 00:03 and closed at 01:03, whatever fails meanwhile; the counter begins anew.
FOUND = {0: (0, False), 1: (1, False), 2: (1, False), 3: (2, False), 4: (3, True), 8: (4, True), 9: (0, False), 10: (1, False), 11: (0, False)}


@pytest.mark.parametrize("parts", [None, 1, 3, 7])
def test_golden_log(spark, parts):
    got = breaker.breaker_states(log_of(spark, GOLDEN), parts=parts).collect()
    assert {r.run_id: (r.failures, r.open) for r in got} == FOUND


def random_log(rng, n, sources=3):
    rows, minute = [], 0
    for i in range(n):
        minute += rng.choice([0, 1, 5, 20, 61])
        rows.append((rng.choice([None, "a", "b", "c"][: sources + 1]), minute * 60_000_000, i, rng.choices(["error", "success", "empty", None], [70, 8, 10, 2])[0]))
    return rows


def test_ranges_compose_to_the_whole():
    rng = random.Random(3)
    for _ in range(300):
        runs = [(us, status) for _, us, _, status in random_log(rng, rng.randint(1, 60), 0)]
        state = breaker.CLOSED
        cuts = sorted({0, len(runs), *(rng.randint(0, len(runs)) for _ in range(rng.randint(0, 6)))})
        for a, b in zip(cuts, cuts[1:], strict=False):
            us, status = zip(*runs[a:b], strict=True)
            pieces = breaker.Range(np.array(us), status, 3, 3600).pieces()
            assert len(pieces["us"]) <= sum(t < us[0] + 3_600_000_000 for t in us) + 1
            after = breaker.through(pieces, state, 3600)
            assert after == breaker.follow(state, us, status, 3, 3600)[1]
            state = after


def test_batch_equals_one_state_after_another(spark):
    rows = random_log(random.Random(4), 400)
    frame = spark.createDataFrame(rows, "source string, us long, run_id long, status string").withColumn("started_at", F.timestamp_micros("us").cast("timestamp_ntz"))
    want = {}
    for source in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == source]
        found, _ = breaker.follow(breaker.CLOSED, [r[1] for r in own], [r[3] for r in own], 3, 3600)
        want |= {r[2]: (f, o is not None) for r, (f, o) in zip(own, found, strict=True)}
    for parts in (1, 5):
        assert {r.run_id: (r.failures, r.open) for r in breaker.breaker_states(frame, parts=parts).collect()} == want
    assert breaker.breaker_states(frame.limit(0)).count() == 0


def test_stream_equals_batch_and_timers_close(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder = str(tmp_path / "log")
        timed = log_of(spark, GOLDEN + [("u", f"2024-01-01 00:0{m}:00", 12 + m, "error") for m in range(3)] + [("t", "2024-01-01 09:00:00", 20, "success")]).withColumn("started_at", F.col("started_at").cast("timestamp"))
        for some in (timed.where("run_id < 3 or run_id between 12 and 14"), timed.where("run_id between 3 and 8"), timed.where("run_id between 9 and 11"), timed.where("run_id > 19")):
            some.coalesce(1).write.mode("append").parquet(folder)
            stream = breaker.breaker_stream(spark.readStream.schema(timed.schema).parquet(folder), late="1 minute")
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination(180)
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert {r.run_id: (r.failures, r.open) for r in got if r.run_id is not None and r.source == "s"} == FOUND
        closed = [(str(r.started_at), r.failures, r.open) for r in got if r.run_id is None]
        assert closed == [("2024-01-01 01:02:00", 0, False)]  # nothing of source u ran after it opened
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
