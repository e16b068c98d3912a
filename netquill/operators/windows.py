"""Features of a connection from all connections of its file within a time span.

Frames run over short stretches of time instead of whole files: every row goes
to the stretch it lies in and, near an edge, also to the neighbour whose frames
reach it, so one large file is dealt over many tasks.  With stretches of 16
spans an eighth of the rows is doubled.

Connections have ``file``, ``conn_id``, ``ts`` (seconds, double), ``src``,
``dst``, ``dport``, ``duration`` and ``state``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import count_less, frames, kth_smallest
from ..schemas import ABNORMAL_STATES, HANDSHAKE_FAILURE_STATES, RESET_STATES

SPAN, TAU, STRETCH = 60, 30.0, 16


def _dealt(conns: DataFrame, span: int) -> DataFrame:
    size = float(span * STRETCH)
    at = lambda x: F.floor(x / size)
    return conns.withColumn("_s", F.explode(F.sequence(at(F.col("ts") - span), at(F.col("ts") + span)))).withColumn("_own", F.col("_s") == at(F.col("ts")))


def window_counts(conns: DataFrame, span: int = SPAN) -> DataFrame:
    """Counts and ratios of the frame, of the same connection tuple and of the same source.

    A frame is a range of sorted rows, so its counts are differences of running
    counts: one sort a stretch, whatever the number of rows in a frame.
    """
    kinds = (RESET_STATES, HANDSHAKE_FAILURE_STATES, ABNORMAL_STATES)

    def features(table: pa.Table) -> dict:
        ts, state = table["ts"].to_numpy(), table["state"]
        reset, fail, bad = (_in(state, k) for k in kinds)
        out = {}
        for by, names in ((), ("conn_count", "tcp_rst_count", "_fail")), (("src", "dst", "dport"), ("reconnect_count",)), (("src",), ("_src", "_bad")):
            key = _codes(table, *by)
            order = np.lexsort((ts, key))
            low, high = frames(key[order], ts[order], span)
            given = {"tcp_rst_count": reset, "_fail": fail, "_bad": bad}
            for n in names:
                out[n] = pa.array(_placed(order, _summed(given[n][order], low, high) if n in given else high - low))
        return out

    names = ["conn_count", "tcp_rst_count", "_fail", "reconnect_count", "_bad", "_src"]
    d = _by_stretch(conns, span, [T.StructField(n, T.LongType()) for n in names], features)
    return d.withColumns(
        {
            "rst_ratio": F.round(F.col("tcp_rst_count") / F.col("conn_count"), 4),
            "handshake_fail_rate": F.round(F.col("_fail") / F.col("conn_count"), 4),
            "reconnection_flag": F.when(F.col("reconnect_count") > 1, 1).otherwise(0),
            "src_ip_abnormal_ratio": F.round(F.col("_bad") / F.col("_src"), 4),
            "abnormal_to_conn_ratio": F.round(F.col("_bad") / F.col("conn_count"), 4),
        }
    ).drop("_fail", "_bad", "_src")


def _in(column: pa.ChunkedArray, values) -> np.ndarray:
    return pc.is_in(column, pa.array(list(values), column.type)).to_numpy(zero_copy_only=False).astype(np.int64)


def _summed(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per range the sum of its whole numbers."""
    before = np.concatenate([[0], np.cumsum(values)])
    return before[high] - before[low]


def _codes(table: pa.Table, *columns: str) -> np.ndarray:
    """Equal rows of the columns get equal numbers; nulls are equal."""
    out = np.zeros(len(table), np.int64)
    for c in columns:
        index = table[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        _, out = np.unique(out * (index.max(initial=0) + 2) + index + 1, return_inverse=True)
    return out


def _by_stretch(conns: DataFrame, span: int, fields: list[T.StructField], features) -> DataFrame:
    """Adds ``fields`` as ``features(table)`` makes them from all rows of a stretch and its edges.

    Memory is linear in a stretch's rows: a frame is a range of sorted rows,
    never an array of its own.
    """
    d = _dealt(conns, span)
    kept = conns.columns
    schema = T.StructType([*conns.select(kept).schema.fields, *fields])

    def run(table: pa.Table) -> pa.Table:
        mine = table["_own"].to_numpy()
        made = features(table)
        return pa.table([table[c].filter(pa.array(mine)) for c in kept] + [made[f.name].filter(pa.array(mine)) for f in fields], names=[*kept, *[f.name for f in fields]])

    return d.groupBy("file", "_s").applyInArrow(run, schema)


def _placed(order: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[order] = values
    return out


def window_distinct(conns: DataFrame, span: int = SPAN) -> DataFrame:
    """``unique_dst_count``: distinct (dst, dport) of the same source in the frame.

    Every row links to the row before it with its source, dst and dport; a
    frame has as many different ones as rows whose link points before it.
    """

    def features(table: pa.Table) -> dict:
        src, pair, ts = _codes(table, "src"), _codes(table, "src", "dst", "dport"), table["ts"].to_numpy()
        order = np.lexsort((ts, src))
        low, high = frames(src[order], ts[order], span)
        by_pair = np.argsort(pair[order], kind="stable")
        link = np.zeros(len(ts), np.int64)  # the place after the row linked to, 0 for none
        same = np.diff(pair[order][by_pair], prepend=-1) == 0
        link[by_pair[same]] = by_pair[np.flatnonzero(same) - 1] + 1
        # links point below low + 1 exactly where the row is its frame's first of its kind
        return {"unique_dst_count": pa.array(_placed(order, count_less(link, low, high, low + 1)), pa.int32())}

    return _by_stretch(conns, span, [T.StructField("unique_dst_count", T.IntegerType())], features)


def window_percentiles(conns: DataFrame, span: int = SPAN, shares=(0.25, 0.5, 0.75)) -> DataFrame:
    """Nearest-rank percentiles of the durations in the frame: element ``min(floor(n p), n - 1)``; nulls do not count."""
    names = [f"duration_p{int(100 * p)}" for p in shares]

    def features(table: pa.Table) -> dict:
        ts = table["ts"].to_numpy()
        order = np.argsort(ts, kind="stable")
        low, high = frames(np.zeros(len(ts), np.int64), ts[order], span)
        known = table["duration"].is_valid().to_numpy()[order]
        before = np.concatenate([[0], np.cumsum(known)])
        low, high = before[low], before[high]
        values, rank = np.unique(table["duration"].to_numpy()[order][known].astype(np.float64), return_inverse=True)
        n, out = high - low, {}
        some = n > 0
        for name, p in zip(names, shares, strict=True):
            found = np.full(len(ts), np.nan)
            k = np.minimum(np.floor(n[some] * p).astype(np.int64), n[some] - 1)
            found[some] = values[kth_smallest(rank, low[some], high[some], k)]
            out[name] = pa.array(_placed(order, found), pa.float64(), mask=_placed(order, ~some))
        return out

    return _by_stretch(conns, span, [T.StructField(n, T.DoubleType()) for n in names], features)


def window_decay(conns: DataFrame, span: int = SPAN, tau: float = TAU) -> DataFrame:
    """Count and mean duration of the frame weighted by ``exp(-|dt| / tau)``.

    The weight splits into one factor of the row and one of the other row, so a
    frame's sum is a running sum's difference.  Rows are cut at whole multiples
    of ``span``, where running sums begin anew (:func:`_decayed`): powers stay
    below ``exp(span / tau)`` and no sum is taken from one much greater.
    """

    def features(table: pa.Table) -> dict:
        ts = table["ts"].to_numpy()
        order = np.argsort(ts, kind="stable")
        duration = table["duration"].to_numpy()[order].astype(np.float64)
        known = table["duration"].is_valid().to_numpy()[order]
        at = ts[order]
        count = _decayed(at, np.ones(len(at)), span, tau)
        total = _decayed(at, np.where(known, duration, 0.0), span, tau)
        some = _summed(known.astype(np.int64), *frames(np.zeros(len(at), np.int64), at, span)) > 0
        mean = total / count
        return {"weighted_conn_count": pa.array(_placed(order, count)), "weighted_avg_duration": pa.array(_placed(order, mean), mask=_placed(order, ~some))}

    names = ["weighted_conn_count", "weighted_avg_duration"]
    return _by_stretch(conns, span, [T.StructField(n, T.DoubleType()) for n in names], features).withColumns({n: F.round(n, 4) for n in names})


def _decayed(at: np.ndarray, values: np.ndarray, span: float, tau: float) -> np.ndarray:
    """Per row of sorted times the sum of ``values * exp(-|dt| / tau)`` over rows at most ``span`` away.

    Rows of one cell, ``span`` wide, and the cells before and behind it hold
    every frame.  The earlier rows of a frame are the start of the row's own
    cell and the end of the cell before, the later ones likewise; each part is
    a running sum from a cell's edge, never a difference.
    """
    n = len(at)
    if not n:
        return np.zeros(0)
    cell = np.floor(at / span)
    first = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
    ends = np.append(first[1:], n)
    k = np.repeat(np.arange(len(first)), ends - first)
    start, end = first[k], ends[k]
    t, whole, row = (at - cell * span) / tau, span / tau, np.arange(n)
    up, down = values * np.exp(t), values * np.exp(-t)
    up_on, up_back, down_on, down_back = (np.empty(n) for _ in range(4))
    for a, e in zip(first.tolist(), ends.tolist(), strict=True):
        for v, on, back in ((up, up_on, up_back), (down, down_on, down_back)):
            on[a:e], back[a:e] = np.cumsum(v[a:e]), np.cumsum(v[a:e][::-1])[::-1]
    out = np.exp(-t) * up_on + np.exp(t) * np.where(row + 1 < end, down_back[np.minimum(row + 1, n - 1)], 0.0)
    # rows of the neighbouring cells lie one cell's width further off
    low = np.maximum(np.searchsorted(at, at - span, side="left"), first[np.maximum(k - 1, 0)])
    high = np.minimum(np.searchsorted(at, at + span, side="right"), ends[np.minimum(k + 1, len(ends) - 1)])
    prior = (low < start) & (cell[np.maximum(start - 1, 0)] == cell - 1)
    after = (high > end) & (cell[np.minimum(end, n - 1)] == cell + 1)
    out += np.where(prior, np.exp(-t - whole) * up_back[low], 0.0)
    return out + np.where(after, np.exp(t - whole) * down_on[np.maximum(high - 1, 0)], 0.0)


def window_jitter(conns: DataFrame, span: int = SPAN) -> DataFrame:
    """Mean and population deviation of the steps between starts of the same tuple in the frame, in microseconds' exactness.

    A frame's steps are a range of all steps of the tuple: their sum is the time
    from its first row to its last, and squares come from running sums, kept as
    whole numbers in two halves so that nothing cancels.
    """

    def features(table: pa.Table) -> dict:
        tup, ts = _codes(table, "src", "dst", "dport"), table["ts"].to_numpy()
        order = np.lexsort((ts, tup))
        low, high = frames(tup[order], ts[order], span)
        at = np.rint((ts[order] - ts.min(initial=np.inf)) * 1e6).astype(np.int64)
        step = np.diff(at, prepend=at[:1])
        step[np.flatnonzero(np.diff(tup[order], prepend=-1))] = 0  # a tuple's first row
        last, square = high - 1, step * step
        upper, lower = np.cumsum(square >> 32), np.cumsum(square & 0xFFFFFFFF)
        exact = (upper[last] - upper[low]).astype(np.longdouble) * 2.0**32 + (lower[last] - lower[low])
        total = (at[last] - at[low]).astype(np.longdouble)
        m = np.maximum(last - low, 1)
        mean = total / m
        dev = np.sqrt(np.maximum(exact / m - mean * mean, 0))
        return {"flow_interval_diff_mean": pa.array(_placed(order, (mean / 1e6).astype(np.float64))), "flow_interval_jitter": pa.array(_placed(order, (dev / 1e6).astype(np.float64)))}

    names = ["flow_interval_diff_mean", "flow_interval_jitter"]
    return _by_stretch(conns, span, [T.StructField(n, T.DoubleType()) for n in names], features).withColumns({n: F.round(n, 4) for n in names})


def all_window_features(conns: DataFrame, span: int = SPAN, tau: float = TAU) -> DataFrame:
    """Every feature of this module, one row per connection."""
    out = conns
    for f in (window_counts, window_distinct, window_percentiles):
        out = f(out, span)
    return window_jitter(window_decay(out, span, tau), span)
