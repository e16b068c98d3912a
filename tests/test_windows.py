"""Sliding features against plain loops, and their memory."""

import random
import tracemalloc

import numpy as np
import pytest

from netquill.functions.ranks import count_less, frames, kth_smallest
from netquill.operators import windows

SCHEMA = "file string, conn_id long, ts double, src string, dst string, dport int, duration double, state string"


def conns(seed, n=400):
    r, out = random.Random(seed), []
    for i in range(n):
        out.append((r.choice(["f", "g"]), i, round(r.choice([r.uniform(0, 5_000), r.uniform(900, 1_000), 960.0]), 4), r.choice(["a", "b", None]), r.choice(["x", "y", "z", None]), r.choice([80, 443, None]), r.choice([r.uniform(0, 9), 1.0, None]), "SF"))
    return out + [out[0][:1] + (n,) + out[0][2:], ("h", n + 1, 5.0, "a", "x", 80, None, "SF")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_loops(spark, seed):
    rows, span = conns(seed), 60
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    distinct = {r["conn_id"]: r["unique_dst_count"] for r in windows.window_distinct(df, span).collect()}
    pct = {r["conn_id"]: (r["duration_p25"], r["duration_p50"], r["duration_p75"]) for r in windows.window_percentiles(df, span).collect()}
    jit = {r["conn_id"]: (r["flow_interval_diff_mean"], r["flow_interval_jitter"]) for r in windows.window_jitter(df, span).collect()}
    assert len(distinct) == len(pct) == len(jit) == len(rows)
    for f, i, t, s, d, p, *_ in rows:
        near = [r for r in rows if r[0] == f and t - span <= r[2] <= t + span]
        assert distinct[i] == len({(r[4], r[5]) for r in near if r[3] == s})
        v = sorted(r[6] for r in near if r[6] is not None)
        assert pct[i] == tuple(v[min(int(len(v) * q), len(v) - 1)] if v else None for q in (0.25, 0.5, 0.75))
        at = sorted(r[2] for r in near if r[3:6] == (s, d, p))
        steps = np.diff(at) if len(at) > 1 else np.zeros(1)
        assert jit[i] == pytest.approx((steps.mean(), steps.std()), abs=6e-5)


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_and_decay_against_loops(spark, seed):
    r, span, tau = random.Random(seed), 60, 30.0
    rows = [(*x[:7], r.choice(["SF", "RSTO", "S0", None])) for x in conns(seed)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    counts = {x["conn_id"]: x for x in windows.window_counts(df, span).collect()}
    decay = {x["conn_id"]: (x["weighted_conn_count"], x["weighted_avg_duration"]) for x in windows.window_decay(df, span, tau).collect()}
    assert len(counts) == len(decay) == len(rows)
    for f, i, t, s, d, p, *_ in rows:
        near = [x for x in rows if x[0] == f and t - span <= x[2] <= t + span]
        mine = [x for x in near if x[3] == s]
        got = counts[i]
        assert (got["conn_count"], got["tcp_rst_count"], got["reconnect_count"]) == (len(near), sum(x[7] == "RSTO" for x in near), sum(x[3:6] == (s, d, p) for x in near))
        assert got["handshake_fail_rate"] == pytest.approx(sum(x[7] == "S0" for x in near) / len(near), abs=6e-5)
        assert got["src_ip_abnormal_ratio"] == pytest.approx(sum(x[7] in ("S0", "RSTO") for x in mine) / len(mine), abs=6e-5)
        weight = [np.exp(-abs(t - x[2]) / tau) for x in near]
        known = [w * x[6] for w, x in zip(weight, near, strict=True) if x[6] is not None]
        assert decay[i][0] == pytest.approx(sum(weight), abs=6e-5)
        assert decay[i][1] == (pytest.approx(sum(known) / sum(weight), abs=6e-5) if known else None)


def test_decay_of_a_crowded_stretch():
    """A hundred thousand rows share a frame: sums run once, where a frame a row would be 10^10 terms."""
    at = np.sort(np.random.default_rng(6).uniform(0, 100, 100_000))
    got = windows._decayed(at, np.ones(len(at)), 60, 30.0)
    for i in (0, 50_000, 99_999):
        near = np.abs(at - at[i])
        assert got[i] == pytest.approx(np.exp(-near[near <= 60] / 30).sum(), rel=1e-12)


def test_all_features_and_empty(spark):
    df = spark.createDataFrame(conns(3, 50), SCHEMA)
    out = windows.all_window_features(df)
    assert out.count() == 52 and {"unique_dst_count", "duration_p75", "flow_interval_jitter", "rst_ratio", "weighted_conn_count"} <= set(out.columns)
    assert windows.all_window_features(df.limit(0)).count() == 0


def test_order_statistics():
    r = np.random.default_rng(4)
    for n, top in ((1, 1), (50, 3), (300, 1_000), (300, 1)):
        v = r.integers(0, top, n)
        low = r.integers(0, n, 200)
        high = np.minimum(n, low + 1 + r.integers(0, n, 200))
        k = (r.random(200) * (high - low)).astype(np.int64)
        assert kth_smallest(v, low, high, k).tolist() == [sorted(v[a:b])[i] for a, b, i in zip(low, high, k, strict=True)]
        bound = r.integers(0, top + 2, 200)
        assert count_less(v, low, high, bound).tolist() == [int((v[a:b] < x).sum()) for a, b, x in zip(low, high, bound, strict=True)]
    assert [x.tolist() for x in frames(np.array([0, 0, 0, 2]), np.array([1.0, 2.0, 9.0, 9.0]), 1.0)] == [[0, 0, 2, 3], [2, 2, 3, 4]]


def test_a_million_in_one_frame():
    """Frames of a million rows each: memory stays linear, which an array a row would not."""
    n, r = 1_000_000, np.random.default_rng(5)
    rank = r.permutation(n)
    low, high = np.zeros(n, np.int64), np.full(n, n)
    tracemalloc.start()
    got = kth_smallest(rank, low, high, np.full(n, n // 2))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert (got == n // 2).all() and most < 200 * n
