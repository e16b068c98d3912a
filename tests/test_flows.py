import pytest
from pyspark.sql import functions as F

from netquill.operators import flows, windows

FLAGS = {"syn": 0, "fin": 0, "rst": 0, "psh": 0, "ack": 0}


def frame(spark, times, dirs=None, lens=None):
    rows = [("f", i, float(t), float((lens or [100] * len(times))[i]), (dirs or "F" * len(times))[i]) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "flow_id string, pkt_no long, ts double, len double, dir string")
    return df.withColumns({k: F.lit(v) for k, v in FLAGS.items()})


def test_gaps_of_the_worked_example(spark):
    r = flows.flow_gaps(frame(spark, [0, 0.2, 0.8, 7.0, 7.4]), ["flow_id"]).first()
    assert (r.iat_min, r.iat_max, r.iat_mean, r.iat_std) == (0.2, 6.2, 1.85, 2.5155)


@pytest.mark.parametrize(("keep", "active"), [(True, (0.8, 0.4)), (False, (0.8, 0.8))])
def test_active_and_idle_of_the_worked_example(spark, keep, active):
    r = flows.active_idle(frame(spark, [0, 0.2, 0.8, 7.0, 7.4]), ["flow_id"], keep_last=keep).first()
    assert (r.active_max, r.active_min, r.idle_max, r.idle_min) == (*active, 6.2, 6.2)


def test_gap_equal_to_the_threshold_is_active(spark):
    r = flows.active_idle(frame(spark, [0, 5]), ["flow_id"]).first()
    assert (r.active_max, r.idle_max) == (5.0, 0.0)


def test_one_packet(spark):
    r = flows.flow_statistics(frame(spark, [3.0]), ["flow_id"]).first()
    assert (r.pkt_len_std, r.pkt_len_bwd_mean, r.flow_pkts_s, r.bytes_backward, r.ratio_bytes_back_to_forward) == (0.0, 0.0, 10000.0, 0.0, 0.0)


def test_states(spark):
    p = frame(spark, [0, 1, 2]).withColumn("syn", F.when(F.col("pkt_no") == 0, 1).otherwise(0))
    one = lambda df: flows.temporal_state(flows.flow_statistics(df, ["flow_id"])).first()
    assert one(p).conn_state == "S0" and one(p).temporal_state == "OTH"
    assert one(p.withColumn("ack", (F.col("pkt_no") == 1).cast("int"))).temporal_state == "S0"
    assert one(p.withColumn("rst", (F.col("pkt_no") == 2).cast("int"))).conn_state == "RSTO"


def test_both_directions_are_one_flow(spark):
    rows = [(0, "b", 2, "a", 1, "tcp"), (1, "a", 1, "b", 2, "tcp"), (2, "a", 1, "b", 2, "udp"), (3, "b", 2, "a", 1, "tcp")]
    df = spark.createDataFrame(rows, "pkt_no long, src_ip string, src_port int, dst_ip string, dst_port int, protocol string")
    got = {r.pkt_no: (r.fwd_ip, r.dir) for r in flows.five_tuple_flows(df).collect()}
    assert got == {0: ("b", "F"), 1: ("b", "B"), 2: ("a", "F"), 3: ("b", "F")}
    key = {r.pkt_no: (r.key_ip1, r.key_port1, r.key_ip2) for r in flows.four_tuple_key(df).collect()}
    assert set(key.values()) == {("a", 1, "b")}


def test_first_packets_and_arrays(spark):
    p = frame(spark, [5, 6, 7, 8], "FBFB", [1, 2, 3, 4])
    assert [r.pkt_no for r in flows.first_packets(p, ["flow_id"], 2).orderBy("pkt_no").collect()] == [0, 1]
    r = flows.packet_arrays(p, ["flow_id"]).first()
    assert (r.packet_time_offsets, r.packet_directions, r.packet_lengths) == ([0, 1, 2, 3], list("FBFB"), [1, 2, 3, 4])


def test_windows_match_a_direct_count(spark):
    import random

    r = random.Random(3)
    rows = [("f", i, round(r.uniform(0, 4000), 3), r.choice("ab"), r.choice("xy"), r.choice([80, 443]), r.uniform(0, 9), r.choice(["SF", "S0", "RSTO"])) for i in range(300)]
    df = spark.createDataFrame(rows, "file string, conn_id long, ts double, src string, dst string, dport int, duration double, state string")
    got = {x.conn_id: x for x in windows.all_window_features(df).collect()}
    assert len(got) == 300
    for _, i, t, s, d, p, _, _ in rows:
        near = [x for x in rows if abs(x[2] - t) <= 60]
        g = got[i]
        assert g.conn_count == len(near)
        assert g.reconnect_count == sum(x[3:6] == (s, d, p) for x in near)
        assert g.unique_dst_count == len({x[4:6] for x in near if x[3] == s})
        durations = sorted(x[6] for x in near)
        assert g.duration_p50 == durations[min(int(len(near) * 0.5), len(near) - 1)]
        w = [2.718281828459045 ** (-abs(x[2] - t) / 30) for x in near]
        assert g.weighted_conn_count == pytest.approx(sum(w), abs=1e-4)
        assert g.weighted_avg_duration == pytest.approx(sum(a * x[6] for a, x in zip(w, near, strict=True)) / sum(w), abs=1e-4)


def test_nearest_rank(spark):
    rows = [("f", i, 0.0, "a", "b", 1, float(v), "SF") for i, v in enumerate((1, 2, 3, 4))]
    df = spark.createDataFrame(rows, "file string, conn_id long, ts double, src string, dst string, dport int, duration double, state string")
    assert windows.window_percentiles(df).first().duration_p50 == 3.0
