"""Flows over packet streams: session statistics, first packets, interval joins.

State is bounded by watermarks; every operator gives the rows of its batch form
once all packets of a flow are in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(packets: DataFrame, keys, ts: str = "ts", gap: str = "5 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Active periods: sessions that a gap above ``gap`` ends (JVM-side state only). Works on batches too."""
    w = packets.withWatermark(ts, lateness) if packets.isStreaming else packets
    g = w.groupBy(*keys, F.session_window(ts, gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("packets"), F.sum("len").alias("bytes"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("w")


def nearby(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, span: str = "60 seconds") -> DataFrame:
    """Pairs of equal key at most ``span`` apart, of two streams (or batches)."""
    if left.isStreaming:
        left, right = left.withWatermark(left_ts, span), right.withWatermark(right_ts, span)
    r = right.withColumnRenamed(key, "_key")
    near = F.expr(f"`{right_ts}` >= `{left_ts}` - interval {span} and `{right_ts}` <= `{left_ts}` + interval {span}")
    return left.join(r, (F.col(key) == F.col("_key")) & near).drop("_key")


_STATE = "pkts long, bytes double, first double, last double, syn long, fin long, rst long, mean double, m2 double"
_OUT = "flow_id string, packets long, bytes double, ts_start double, ts_end double, syn long, fin long, rst long, len_mean double, len_std double, reason string"


def running_flows(packets: DataFrame, key: str = "flow_id", idle: float = 5.0, lateness: str = "10 seconds") -> DataFrame:
    """Flow statistics from running state, given out when a flow closes.

    A flow closes when it is reset or finished, when its next packet comes
    more than ``idle`` seconds later (that packet opens a new flow), or when
    the watermark passes its last packet by ``idle``.  ``packets`` has the key,
    ``event_time`` (timestamp), ``ts`` (seconds), ``len`` and 0/1 ``syn fin rst``.
    """

    def fold(key_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []

        def close(s, why):
            out.append((key_[0], s[0], s[1], s[2], s[3], s[4], s[5], s[6], s[7], (s[8] / s[0]) ** 0.5 if s[0] else 0.0, why))

        if state.hasTimedOut:
            close(state.get, "idle")
            state.remove()
        else:
            s = list(state.get) if state.exists else None
            rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
            for r in rows.itertuples(index=False):
                if s is not None and r.ts - s[3] > idle:
                    close(s, "idle")
                    s = None
                if s is None:
                    s = [0, 0.0, r.ts, r.ts, 0, 0, 0, 0.0, 0.0]
                s[0] += 1
                s[1] += float(r.len)
                s[3] = max(s[3], r.ts)
                s[4], s[5], s[6] = s[4] + int(r.syn), s[5] + int(r.fin), s[6] + int(r.rst)
                d = float(r.len) - s[7]
                s[7] += d / s[0]
                s[8] += d * (float(r.len) - s[7])
                if r.fin or r.rst:
                    close(s, "reset" if r.rst else "finished")
                    s = None
            if s is None:
                if state.exists:
                    state.remove()
            else:
                state.update(tuple(s))
                state.setTimeoutTimestamp(max(int((s[3] + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["flow_id", "packets", "bytes", "ts_start", "ts_end", "syn", "fin", "rst", "len_mean", "len_std", "reason"])

    slim = packets.select(F.col(key).cast("string").alias("flow_id"), "event_time", "ts", F.col("len").cast("double").alias("len"), *[F.col(c).cast("int").alias(c) for c in ("syn", "fin", "rst")])
    return slim.withWatermark("event_time", lateness).groupBy("flow_id").applyInPandasWithState(fold, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
