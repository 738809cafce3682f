"""Breaker state per key over an ordered outcome stream (M1-M3, M6), batch form.

Per key, outcomes are applied in (ts, event_id) order:

* closed: a failure adds one to the consecutive count; reaching the threshold opens.
* open: a call within ``reset`` of the opening is blocked (degraded, no state
  change); the first call after it goes through half-open: success closes and
  resets the count, failure re-opens at its own time.

The transition depends on the whole prefix, so it is a per-key ordered fold:
rows are hash-partitioned by key, sorted inside partitions by (key, ts, id)
and streamed through ``mapInPandas`` with three scalars of state, so memory is
one Arrow batch whatever a key's size. The streaming form in
``corpuslint.streaming.breaker`` applies the same step function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OUTCOME_SCHEMA = (
    "key string, event_id bigint, ts_us bigint, failed boolean, allowed boolean, status string, "
    "consecutive_failures int, opened_at_us bigint, degraded boolean, recovery_action string"
)

BLOCK_ACTION = "fallback_skip_with_degraded_mode"
BLOCK_REASON = "circuit_breaker_open"
FAILURE_ACTION = "record_failure"


def step(state: tuple[str, int, int | None], ts: int, failed: bool, threshold: int, reset_us: int):
    """One outcome: returns (allowed, new_state). state = (status, count, opened_at)."""
    status, count, opened = state
    half_open = False
    if status == "open" and opened is not None:
        if ts - opened >= reset_us:
            half_open = True
        else:
            return False, state
    if failed:
        count += 1
        if count >= threshold or half_open:
            return True, ("open", count, ts)
        return True, ("closed", count, opened)
    return True, ("closed", 0, None)


def _fold(threshold: int, reset_us: int):
    def run(batches):
        group, state = None, ("closed", 0, None)
        for pdf in batches:
            n = len(pdf)
            keys = pdf["key"].to_numpy()
            segs = pdf["seg"].to_numpy() if "seg" in pdf.columns else None
            tss = pdf["ts_us"].to_numpy()
            fails = pdf["failed"].to_numpy()
            allowed = np.empty(n, dtype=bool)
            status = np.empty(n, dtype=object)
            count = np.empty(n, dtype=np.int32)
            opened = np.empty(n, dtype=object)
            for i in range(n):
                g = (keys[i], segs[i]) if segs is not None else keys[i]
                if g != group:  # every segment starts from the closed state
                    group, state = g, ("closed", 0, None)
                ok, state = step(state, int(tss[i]), bool(fails[i]), threshold, reset_us)
                allowed[i] = ok
                status[i], count[i], opened[i] = state
            yield pd.DataFrame({
                "key": pdf["key"], "event_id": pdf["event_id"], "ts_us": pdf["ts_us"], "failed": pdf["failed"],
                "allowed": allowed, "status": status, "consecutive_failures": count,
                "opened_at_us": pd.array(opened, dtype="Int64"),
                "degraded": ~allowed,
                "recovery_action": np.where(~allowed, BLOCK_ACTION, np.where(fails.astype(bool), FAILURE_ACTION, None)),
            })
    return run


def segments(outcomes: DataFrame, reset_us: int) -> DataFrame:
    """Cut each key's stream at "safe" successes so the pieces fold independently.

    A success is always allowed when no failure of its key precedes it within
    the reset window (the breaker can only have opened at a failure), and an
    allowed success closes the breaker, so every piece starts closed. Finding
    them needs only the latest earlier failure: inside a (key, reset-wide time
    bucket) window, or the previous bucket's latest failure - never pairs of
    events. Segment numbers are a two-level prefix count (within the bucket,
    then over per-bucket counts), so a hot key is spread over its buckets.
    """
    ev = outcomes.withColumn("bucket", F.floor(F.col("ts_us") / F.lit(reset_us)).cast("bigint"))
    in_bucket = Window.partitionBy("key", "bucket").orderBy("ts_us", "event_id").rowsBetween(
        Window.unboundedPreceding, -1)
    fail_ts = F.when(F.col("failed"), F.col("ts_us"))
    ev = ev.withColumn("last_fail_here", F.max(fail_ts).over(in_bucket))
    per_bucket = ev.groupBy("key", "bucket").agg(F.max(fail_ts).alias("bucket_last_fail"))
    prev = per_bucket.select("key", (F.col("bucket") + 1).alias("bucket"), F.col("bucket_last_fail").alias("prev_last_fail"))
    ev = ev.join(prev, ["key", "bucket"], "left")
    last_fail = F.greatest("last_fail_here", "prev_last_fail")
    safe = ~F.col("failed") & (last_fail.isNull() | (last_fail <= F.col("ts_us") - F.lit(reset_us)))
    ev = ev.withColumn("safe", safe.cast("int"))
    ev = ev.withColumn("safe_before_here", F.coalesce(F.sum("safe").over(in_bucket), F.lit(0)))
    counts = ev.groupBy("key", "bucket").agg(F.sum("safe").alias("n_safe"))
    over_buckets = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "bucket", F.coalesce(F.sum("n_safe").over(over_buckets), F.lit(0)).alias("safe_before"))
    ev = ev.join(counts, ["key", "bucket"])
    return ev.select("key", (F.col("safe_before") + F.col("safe_before_here")).cast("bigint").alias("seg"),
                     "event_id", "ts_us", "failed")


def breaker_states(outcomes: DataFrame, threshold: int, reset_seconds: int) -> DataFrame:
    """M1/M2: one row per outcome with the state after it. Input: key, event_id, ts_us, failed.

    Independent segments (see ``segments``) are folded in parallel: rows are
    hash-partitioned by (key, segment), sorted by time inside partitions and
    streamed through a small Python fold; a segment, not a whole key, is the unit.
    """
    reset_us = reset_seconds * 1_000_000
    base = outcomes.select(F.col("key").cast("string").alias("key"), "event_id", "ts_us", "failed")
    rows = (segments(base, reset_us).repartition("key", "seg")
            .sortWithinPartitions("key", "seg", "ts_us", "event_id"))
    return rows.mapInPandas(_fold(threshold, reset_us), OUTCOME_SCHEMA)


def recovery_events(states: DataFrame) -> DataFrame:
    """M3: a `record_failure` event per allowed failure, a skip event per blocked call."""
    ev = states.filter(~F.col("allowed") | F.col("failed"))
    return ev.select(
        "key", "event_id", "ts_us", F.lit("task").alias("scope"), F.col("key").alias("target"),
        F.when(~F.col("allowed"), F.lit(BLOCK_ACTION)).otherwise(F.lit(FAILURE_ACTION)).alias("action"),
        F.when(~F.col("allowed"), F.lit(BLOCK_REASON)).otherwise(F.lit("failed")).alias("reason"))


def final_states(states: DataFrame) -> DataFrame:
    """M6: last state per key (max by (ts, event_id)); partial aggregation map-side."""
    last = states.groupBy("key").agg(F.max_by(F.struct("status", "consecutive_failures", "opened_at_us"),
                                              F.struct("ts_us", "event_id")).alias("s"))
    return last.select("key", "s.*")


def events_as_outcomes(events: DataFrame) -> DataFrame:
    """Driver `events` as outcomes: key = user_id, failure = event_type 'error', time in epoch micros."""
    return events.select(
        F.col("user_id").cast("string").alias("key"), "event_id",
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("ts_us"),
        (F.col("event_type") == "error").alias("failed"))
