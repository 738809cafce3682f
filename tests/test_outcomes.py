"""Breaker state machine (M1-M3): batch fold, and batch == streaming."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from corpuslint.operators.outcomes import breaker_states, final_states, recovery_events
from corpuslint.streaming.breaker import breaker_stream


def _outcomes(spark, seq):
    base = dt.datetime(2024, 1, 1)
    rows = [("k", i, int((base + dt.timedelta(seconds=s) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6), f)
            for i, (s, f) in enumerate(seq)]
    return spark.createDataFrame(rows, "key string, event_id long, ts_us long, failed boolean")


def test_open_block_half_open_close(spark):
    seq = [(0, True), (1, True), (5, False), (40, True), (80, False)]
    out = breaker_states(_outcomes(spark, seq), threshold=2, reset_seconds=30).orderBy("event_id").collect()
    assert [(r.allowed, r.status, r.consecutive_failures) for r in out] == [
        (True, "closed", 1), (True, "open", 2), (False, "open", 2), (True, "open", 3), (True, "closed", 0)]
    assert out[2].degraded and out[2].recovery_action == "fallback_skip_with_degraded_mode"
    ev = recovery_events(breaker_states(_outcomes(spark, seq), 2, 30)).count()
    assert ev == 4  # three allowed failures and one blocked call
    fin = final_states(breaker_states(_outcomes(spark, seq), 2, 30)).collect()[0]
    assert fin.status == "closed" and fin.consecutive_failures == 0


def test_threshold_one_blocks_next_call(spark):
    out = breaker_states(_outcomes(spark, [(0, True), (1, False)]), 1, 30).orderBy("event_id").collect()
    assert out[1].allowed is False and out[1].degraded


def test_batch_equals_streaming(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = events.select(F.col("user_id").cast("string").alias("key"), "event_id",
                        F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    d = tempfile.mkdtemp(prefix="corpuslint-stream-")
    # two input files, the second out of order; a far-future sentinel row moves the watermark past everything
    n = src.count()
    src.orderBy(F.desc("event_id")).limit(n // 2).write.parquet(os.path.join(d, "in", "b1"))
    src.orderBy("event_id").limit(n - n // 2).write.parquet(os.path.join(d, "in", "b2"))
    sentinel = spark.createDataFrame([("__sentinel__", -1, dt.datetime(2100, 1, 1), False)],
                                     "key string, event_id long, ts timestamp, failed boolean")
    sentinel.write.parquet(os.path.join(d, "in", "b3"))
    stream = spark.readStream.schema(src.schema).option("recursiveFileLookup", "true").parquet(os.path.join(d, "in"))
    q = (breaker_stream(stream, 2, 6 * 3600, delay="1 hour").writeStream.format("memory").queryName("bk")
         .option("checkpointLocation", os.path.join(d, "ck")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("bk").filter("key <> '__sentinel__'")
    batch = breaker_states(src.withColumn("ts_us", F.unix_micros("ts")).drop("ts"), 2, 6 * 3600)
    cols = ["key", "event_id", "allowed", "status", "consecutive_failures", "opened_at_us"]
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert len(b) == n and a == b
