"""Breaker states over a stream of outcomes (M1, Structured Streaming form).

A stream delivers outcomes out of order, so each key buffers them in state and
folds only those the watermark has passed, in (ts, event_id) order - the same
order and step function as the batch fold, hence the same rows. Rows older than
the watermark on arrival are dropped by Spark (late data).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from corpuslint.operators.outcomes import BLOCK_ACTION, FAILURE_ACTION, OUTCOME_SCHEMA, step

STATE_SCHEMA = ("status string, consecutive_failures int, opened_at_us bigint, "
                "pending_ts array<bigint>, pending_id array<bigint>, pending_failed array<boolean>")


def _stateful(threshold: int, reset_us: int):
    def fn(key, pdfs, state):
        if state.exists:
            status, count, opened, p_ts, p_id, p_f = state.get
            pending = list(zip(p_ts or [], p_id or [], p_f or []))
        else:
            status, count, opened, pending = "closed", 0, None, []
        for pdf in pdfs:
            pending.extend(zip(pdf["ts_us"].tolist(), pdf["event_id"].tolist(), pdf["failed"].tolist()))
        wm_us = state.getCurrentWatermarkMs() * 1000
        pending.sort(key=lambda r: (r[0], r[1]))
        ready = [r for r in pending if r[0] <= wm_us]
        rest = [r for r in pending if r[0] > wm_us]
        cur = (status, count, opened)
        out = []
        for ts, eid, failed in ready:
            ok, cur = step(cur, int(ts), bool(failed), threshold, reset_us)
            out.append((key[0], int(eid), int(ts), bool(failed), ok, cur[0], cur[1], cur[2], not ok,
                        BLOCK_ACTION if not ok else (FAILURE_ACTION if failed else None)))
        state.update((cur[0], cur[1], cur[2], [r[0] for r in rest], [r[1] for r in rest], [r[2] for r in rest]))
        if rest:
            state.setTimeoutTimestamp(max(rest[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)
        cols = [c.split()[0] for c in OUTCOME_SCHEMA.split(", ")]
        frame = pd.DataFrame(out, columns=cols)
        frame["opened_at_us"] = frame["opened_at_us"].astype("Int64")
        yield frame
    return fn


def breaker_stream(outcomes: DataFrame, threshold: int, reset_seconds: int, delay: str = "1 hour") -> DataFrame:
    """Streaming M1. Input columns: key, event_id, ts (timestamp), failed."""
    s = (outcomes.withColumn("ts", F.col("ts").cast("timestamp"))
         .withColumn("ts_us", F.unix_micros("ts"))
         .withWatermark("ts", delay))
    return s.groupBy("key").applyInPandasWithState(
        _stateful(threshold, reset_seconds * 1_000_000), OUTCOME_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)
