"""Flows with bounded state against one packet after another."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netquill.streaming import evicting

SCHEMA = "flow_id string, ts double, len double, syn int, fin int, rst int"
STORE = "spark.sql.streaming.stateStore.providerClass"


def run(spark, tmp_path, parts, **more):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "src" / f"p{i:02d}"))
    s = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    s = s.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    old = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = evicting.evicting_flows(s, **more).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(100)
    finally:
        spark.conf.set(STORE, old)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def plain(rows, idle):
    """All closed flows of packets in order of time, the last ones idle."""
    state, out = {}, []
    for k, t, n, syn, fin, rst in sorted(rows, key=lambda r: r[1]):
        s = state.get(k)
        if s and t - s[-1][0] > idle:
            out.append((k, s, "idle"))
            s = None
        s = [*(s or []), (t, n, syn)]
        if fin or rst:
            out.append((k, s, "reset" if rst else "finished"))
            state.pop(k, None)
        else:
            state[k] = s
    out += [(k, s, "idle") for k, s in state.items()]
    return sorted((k, len(s), sum(x[1] for x in s), s[0][0], s[-1][0], sum(x[2] for x in s), round(float(np.mean([x[1] for x in s])), 6), round(float(np.std([x[1] for x in s])), 6), why) for k, s, why in out)


def test_stream_and_plain_are_equal(spark, tmp_path):
    r = random.Random(1)
    rows, t = [], 1_000.0
    for _ in range(400):
        t += r.choice([0.01, 0.2, 1.0])
        done = r.random()
        rows.append((f"f{r.randrange(12)}", round(t, 3), float(r.randint(1, 99)), int(r.random() < 0.2), int(done < 0.03), int(0.03 < done < 0.05)))
    rows += [("z", t + 10_000, 1.0, 0, 0, 1)]  # moves the watermark past all flows
    got = run(spark, tmp_path, [rows[a : a + 101] for a in range(0, 404, 101)], shards=3)
    have = sorted((x.flow_id, x.packets, x.bytes, x.ts_start, x.ts_end, x.syn, round(x.len_mean, 6), round(x.len_std, 6), x.reason) for x in got)
    assert have == plain(rows, 5.0)


def test_the_oldest_are_forced_out(spark, tmp_path):
    first = [(f"f{i}", 1_000.0 + i / 10, 1.0, 0, 0, 0) for i in range(6)]
    got = run(spark, tmp_path, [first, [("f9", 1_001.0, 1.0, 0, 0, 0)], [("z", 9_999.0, 1.0, 0, 1, 0)]], shards=1, most=4)
    assert {(x.flow_id, x.reason) for x in got} == {("f0", "forced"), ("f1", "forced"), ("f2", "forced"), ("f3", "idle"), ("f4", "idle"), ("f5", "idle"), ("f9", "idle"), ("z", "finished")}


def test_stretches_join_like_one():
    r = np.random.default_rng(2)
    x = r.integers(1, 100, 30).astype(float)
    none = np.zeros((30, 3), np.int64)
    ts = np.arange(30.0)
    whole = evicting.stretches(np.array(["a"] * 30), ts, x, none, 5.0)
    parts = [evicting.stretches(np.array(["a"] * len(i)), ts[i], x[i], none[i], 5.0) for i in (np.arange(11), np.arange(11, 30))]
    row = lambda d: tuple(d.iloc[0])[1:10]
    assert evicting.joined(row(parts[0]), row(parts[1])) == pytest.approx(row(whole))


class Store:
    """A map state that counts its calls, a value state, and the timers of one shard."""

    def __init__(self):
        self.calls, self.map, self.value, self.timers = 0, {}, None, set()

    def containsKey(self, k):
        self.calls += 1
        return k in self.map

    def getValue(self, k):
        self.calls += 1
        return self.map[k]

    def removeKey(self, k):
        self.calls += 1
        del self.map[k]

    def updateValue(self, k, v):
        self.calls += 1
        self.map[k] = v

    def iterator(self):
        return iter(list(self.map.items()))

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_one_write_a_flow():
    """A flow that closes many times in a batch costs the store a call for what is left, not calls a stretch."""
    s = Store()
    p = evicting.Evicting(5.0, 100)
    p.handle, p.open, p.held = s, s, s
    batch = lambda ts, fin: pd.DataFrame({"flow_id": ["a"] * len(ts), "ts": ts, "len": 1.0, "syn": 0, "fin": fin, "rst": 0})
    out = next(p.handleInputRows(("k",), iter([batch([float(i) for i in range(21)], [1] * 20 + [0])]), s))
    assert (len(out), set(out["reason"]), s.calls, s.value[0], s.timers) == (20, {"finished"}, 1, 1, {25_000})
    out = next(p.handleInputRows(("k",), iter([batch([21.0, 40.0, 41.0], [0, 0, 1])]), s))
    assert out[["packets", "reason"]].values.tolist() == [[2, "idle"], [2, "finished"]]
    assert (s.map, s.value[0], s.calls) == ({}, 0, 4)
