"""Flows over a packet stream with bounded state: closed when done or idle, the oldest evicted when there are too many.

Flows are dealt into shards; a shard's state is a map from flow to its running
statistics, a count, and the event time of its next timer.  A batch's packets
are folded column by column into stretches of one flow, and each flow's first
stretch is joined with its state, so Python touches flows, not packets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .flows import _OUT

_FLOW = "packets long, bytes double, first double, last double, syn long, fin long, rst long, mean double, m2 double"
_COLUMNS = ["flow_id", "packets", "bytes", "ts_start", "ts_end", "syn", "fin", "rst", "len_mean", "len_std", "reason"]


def stretches(flow: np.ndarray, ts: np.ndarray, length: np.ndarray, flags: np.ndarray, idle: float) -> pd.DataFrame:
    """One row per stretch of packets that belong together, in order of flow and time.

    ``flags`` has a column each for syn, fin and rst.  A stretch ends behind a
    packet with fin or rst, and before one more than ``idle`` after the packet
    before it.  ``lead`` says whether it may continue the flow's state.
    """
    order = np.lexsort((ts, flow))
    flow, ts, length, flags = flow[order], ts[order], length[order], flags[order]
    n = len(ts)
    other = np.ones(n, bool)
    other[1:] = flow[1:] != flow[:-1]
    done = (flags[:, 1] > 0) | (flags[:, 2] > 0)
    new = other.copy()
    new[1:] |= done[:-1] | (ts[1:] - ts[:-1] > idle)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, n))
    total = np.add.reduceat(length, at)
    mean = total / count
    m2 = np.add.reduceat((length - np.repeat(mean, count)) ** 2, at)
    sums = np.add.reduceat(flags, at, axis=0)
    last = at + count - 1
    return pd.DataFrame({"flow_id": flow[at], "packets": count, "bytes": total, "first": ts[at], "last": ts[last], "syn": sums[:, 0], "fin": sums[:, 1], "rst": sums[:, 2], "mean": mean, "m2": m2, "lead": other[at], "done": done[last]})


def joined(a: tuple, b: tuple) -> tuple:
    """Statistics of two stretches of a flow as one (counts, sums, mean and squared deviations)."""
    n = a[0] + b[0]
    step = b[7] - a[7]
    return (n, a[1] + b[1], min(a[2], b[2]), max(a[3], b[3]), a[4] + b[4], a[5] + b[5], a[6] + b[6], a[7] + step * b[0] / n, a[8] + b[8] + step * step * a[0] * b[0] / n)


class Evicting(StatefulProcessor):
    def __init__(self, idle: float, most: int):
        self.idle, self.most = idle, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "flow_id string", _FLOW)
        self.held = handle.getValueState("held", "n long, timer long")

    def _close(self, out: list, flow: str, s: tuple, why: str) -> None:
        out.append((flow, s[0], s[1], s[2], s[3], s[4], s[5], s[6], s[7], (s[8] / s[0]) ** 0.5, why))

    def _counts(self) -> tuple[int, int]:
        return tuple(self.held.get()) if self.held.exists() else (0, 0)

    def _wake(self, timer: int, at: int) -> int:
        """The shard's one timer stands at the earliest time any flow may be idle."""
        if timer and timer <= at:
            return timer
        if timer:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)
        return at

    def _expiry(self, last: float, now: int) -> int:
        return max(int(np.ceil((last + self.idle) * 1000)), now + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, out = pd.concat(list(rows)), []
        n, timer = self._counts()
        now = timerValues.getCurrentWatermarkInMs()
        found = stretches(batch["flow_id"].to_numpy(object).astype(str), batch["ts"].to_numpy(np.float64), batch["len"].to_numpy(np.float64), batch[["syn", "fin", "rst"]].to_numpy(np.int64), self.idle)
        # the store is asked once for a flow and told once what is left of it, however often it closed in between
        left, stored = {}, set()
        for r in found.itertuples(index=False):
            s = (int(r.packets), float(r.bytes), float(r.first), float(r.last), int(r.syn), int(r.fin), int(r.rst), float(r.mean), float(r.m2))
            if r.flow_id in left:
                before = left[r.flow_id]
            elif n and self.open.containsKey((r.flow_id,)):
                before = tuple(self.open.getValue((r.flow_id,)))
                stored.add(r.flow_id)
            else:
                before = None
            if before is not None:
                if r.lead and s[2] - before[3] <= self.idle:
                    s = joined(before, s)
                else:
                    self._close(out, r.flow_id, before, "idle")
            if r.done:
                self._close(out, r.flow_id, s, "reset" if s[6] else "finished")
            left[r.flow_id] = None if r.done else s
        ends = []
        for flow, s in left.items():
            if s is not None:
                self.open.updateValue((flow,), s)
                n += flow not in stored
                ends.append(self._expiry(s[3], now))
            elif flow in stored:
                self.open.removeKey((flow,))
                n -= 1
        if ends:
            timer = self._wake(timer, min(ends))
        if n > self.most:
            oldest = sorted(((tuple(v)[2], tuple(v)[3], k[0], tuple(v)) for k, v in self.open.iterator()), key=lambda x: x[:3])
            for _, _, flow, s in oldest[: n - self.most]:
                self.open.removeKey((flow,))
                self._close(out, flow, s, "forced")
            n = self.most
        self.held.update((n, timer))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, nearest = timerValues.getCurrentWatermarkInMs(), [], None
        n, _ = self._counts()
        for k, v in list(self.open.iterator()):
            s = tuple(v)
            if s[3] + self.idle < now / 1000:
                self.open.removeKey(k)
                n -= 1
                self._close(out, k[0], s, "idle")
            else:
                at = self._expiry(s[3], now)
                nearest = at if nearest is None else min(nearest, at)
        if nearest is not None:
            self.handle.registerTimer(nearest)
        self.held.update((n, nearest or 0))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def evicting_flows(packets: DataFrame, key: str = "flow_id", idle: float = 5.0, lateness: str = "10 seconds", shards: int = 64, most: int = 100_000) -> DataFrame:
    """Closed flows with their statistics and ``reason``: reset, finished, idle, or forced.

    A flow closes behind a packet with fin or rst, before one more than ``idle``
    seconds after the last, when the watermark has passed its last packet by
    ``idle``, and when its shard holds more than ``most`` open flows and it is
    among those that started first.  ``packets`` has the key, ``event_time``
    (timestamp), ``ts`` (seconds), ``len`` and 0/1 ``syn fin rst``; rows without
    key or time are left out.  The state store must keep maps
    (RocksDB: ``spark.sql.streaming.stateStore.providerClass``).
    """
    slim = packets.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(F.col(key).cast("string").alias("flow_id"), "event_time", "ts", F.col("len").cast("double").alias("len"), *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in ("syn", "fin", "rst")])
    dealt = slim.withColumn("shard", F.pmod(F.xxhash64("flow_id"), F.lit(shards)).cast("int"))
    return dealt.withWatermark("event_time", lateness).groupBy("shard").transformWithStateInPandas(Evicting(idle, most), _OUT, "Append", "EventTime")
