"""Packets to flows: keys, per-flow statistics, active and idle periods, packet arrays.

Packets have ``pkt_no`` (order), ``ts`` (seconds), ``len``, ``dir`` (F or B) and
0/1 flags ``syn fin rst psh ack``; flows are named by key columns.  All windows
here share the key partitioning, so packets move once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDLE_SECONDS = 5.0
LEAST_DURATION = 1e-4
FLAGS = ("syn", "fin", "rst", "psh", "ack")


def four_tuple_key(df: DataFrame, src="src_ip", sport="src_port", dst="dst_ip", dport="dst_port") -> DataFrame:
    """Adds ``key_*``: the smaller address first with its own port; equal addresses keep the packet's direction reversed."""
    first = F.col(src) < F.col(dst)
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return df.withColumns({"key_ip1": pick(src, dst), "key_port1": pick(sport, dport), "key_ip2": pick(dst, src), "key_port2": pick(dport, sport)})


def five_tuple_flows(df: DataFrame, src="src_ip", sport="src_port", dst="dst_ip", dport="dst_port", proto="protocol", order="pkt_no", within=()) -> DataFrame:
    """Adds the flow's forward end (``fwd_*``/``bwd_*``) and each packet's ``dir``.

    Packets of both directions of a 5-tuple are one flow; its first packet's
    sender is forward, and a packet is forward if its address is the forward
    address.  The first packet comes from an aggregate, so only one row per
    flow is joined back.
    """
    a, b = F.struct(F.col(src).alias("ip"), F.col(sport).alias("port")), F.struct(F.col(dst).alias("ip"), F.col(dport).alias("port"))
    keyed = df.withColumns({"_end1": F.least(a, b), "_end2": F.greatest(a, b)})
    keys = [*within, "_end1", "_end2", proto]
    firsts = keyed.groupBy(*keys).agg(F.min_by(F.struct(a.alias("f"), b.alias("b")), order).alias("_first"))
    out = keyed.join(firsts, keys)
    out = out.withColumns({"fwd_ip": F.col("_first.f.ip"), "fwd_port": F.col("_first.f.port"), "bwd_ip": F.col("_first.b.ip"), "bwd_port": F.col("_first.b.port")})
    return out.withColumn("dir", F.when(F.col(src) == F.col("fwd_ip"), "F").otherwise("B")).drop("_end1", "_end2", "_first")


def first_packets(packets: DataFrame, keys, n: int = 200, order="pkt_no") -> DataFrame:
    """The first ``n`` packets of every flow in arrival order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return packets.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def _stats(value, prefix: str, which=("max", "min", "mean", "std"), digits=4):
    """Population statistics of a column, 0 without values."""
    fn = {"max": F.max, "min": F.min, "mean": F.avg, "std": F.stddev_pop, "var": F.var_pop}
    return [F.round(F.coalesce(fn[k](value), F.lit(0.0)), digits).alias(f"{prefix}_{k}") for k in which]


def flow_statistics(packets: DataFrame, keys, header_bytes: int = 40) -> DataFrame:
    """Counts, bytes, length statistics, rates, header lengths, flags and connection state per flow."""
    f, b = F.col("dir") == "F", F.col("dir") == "B"
    x = F.col("len")
    g = packets.groupBy(*keys).agg(
        F.min_by("ts", "pkt_no").alias("ts_start"),
        F.max_by("ts", "pkt_no").alias("ts_end"),
        F.count_if(f).alias("pkts_forward"),
        F.count_if(b).alias("pkts_backward"),
        F.count(F.lit(1)).alias("pkts_total"),
        *[F.round(F.coalesce(F.sum(v), F.lit(0.0)), 4).alias(n) for n, v in (("bytes_forward", F.when(f, x)), ("bytes_backward", F.when(b, x)), ("bytes_total", x))],
        *_stats(x, "pkt_len", ("max", "min", "mean", "std", "var")),
        *_stats(F.when(f, x), "pkt_len_fwd", ("mean", "std")),
        *_stats(F.when(b, x), "pkt_len_bwd", ("mean", "std")),
        *[F.sum(F.col(k).cast("long")).alias(f"flag_{k}_count") for k in FLAGS],
        F.when(F.max(F.col("rst").cast("int")) == 1, "RSTO").when(F.min_by(F.col("syn").cast("int"), "pkt_no") == 1, "S0").otherwise("SF").alias("conn_state"),
    )
    d = F.greatest(F.col("ts_end") - F.col("ts_start"), F.lit(LEAST_DURATION))
    over = lambda a, c: F.when(F.col(c) > 0, F.round(F.col(a) / F.col(c), 4)).otherwise(0.0)
    return g.withColumns(
        {
            "flow_bytes_s": F.round(F.col("bytes_total") / d, 4),
            "flow_pkts_s": F.round(F.col("pkts_total") / d, 4),
            "fwd_pkts_s": F.round(F.col("pkts_forward") / d, 4),
            "bwd_pkts_s": F.round(F.col("pkts_backward") / d, 4),
            "ratio_bytes_back_to_forward": over("bytes_backward", "bytes_forward"),
            "down_up_ratio": over("pkts_backward", "pkts_forward"),
            "fwd_header_len": F.col("pkts_forward") * header_bytes,
            "bwd_header_len": F.col("pkts_backward") * header_bytes,
        }
    )


def temporal_state(g: DataFrame, proto: str = "tcp") -> DataFrame:
    """Connection state of the temporal record: reset, then unanswered, then closed, else other; always SF for UDP."""
    state = F.when(F.col("flag_rst_count") > 0, "RSTO").when((F.col("flag_syn_count") > 0) & (F.col("flag_ack_count") == 1), "S0").when(F.col("flag_fin_count") > 0, "SF").otherwise("OTH")
    return g.withColumn("temporal_state", F.lit("SF") if proto == "udp" else state)


def flow_gaps(packets: DataFrame, keys, order="pkt_no") -> DataFrame:
    """Inter-arrival statistics per flow: all packets, forward ones, backward ones."""
    every = Window.partitionBy(*keys).orderBy(order)
    same = Window.partitionBy(*keys, "dir").orderBy(order)
    p = packets.withColumn("_g", F.col("ts") - F.lag("ts").over(every)).withColumn("_d", F.col("ts") - F.lag("ts").over(same))
    return p.groupBy(*keys).agg(*_stats(F.col("_g"), "iat"), *_stats(F.when(F.col("dir") == "F", F.col("_d")), "iat_fwd"), *_stats(F.when(F.col("dir") == "B", F.col("_d")), "iat_bwd"))


def active_idle(packets: DataFrame, keys, threshold: float = IDLE_SECONDS, order="ts", tie="pkt_no", keep_last: bool = True) -> DataFrame:
    """Active and idle period statistics per flow.

    A gap above ``threshold`` ends an active period and is an idle one.  With
    ``keep_last=False`` a flow's last active period, which nothing ends, does
    not count (the streaming form of the statistic).
    """
    w = Window.partitionBy(*keys).orderBy(order, tie)
    p = packets.withColumn("_gap", F.col("ts") - F.lag("ts").over(w))
    p = p.withColumn("_run", F.sum(F.when(F.col("_gap") > threshold, 1).otherwise(0)).over(w))
    runs = p.groupBy(*keys, "_run").agg((F.max("ts") - F.min("ts")).alias("_active"), F.max(F.when(F.col("_gap") > threshold, F.col("_gap"))).alias("_idle"))
    if not keep_last:
        last = F.max("_run").over(Window.partitionBy(*keys))
        runs = runs.withColumn("_active", F.when(F.col("_run") < last, F.col("_active")))
    return runs.groupBy(*keys).agg(*_stats(F.col("_active"), "active"), *_stats(F.col("_idle"), "idle"))


def packet_arrays(packets: DataFrame, keys) -> DataFrame:
    """Offsets from the first packet (6 digits), directions and lengths per flow, in time order."""
    pts = F.array_sort(F.collect_list(F.struct("ts", "pkt_no", "len", "dir")))
    g = packets.groupBy(*keys).agg(pts.alias("p"))
    start = F.get(F.col("p"), 0)["ts"]
    return g.select(
        *keys,
        F.transform("p", lambda x: F.round(x["ts"] - start, 6)).alias("packet_time_offsets"),
        F.transform("p", lambda x: x["dir"]).alias("packet_directions"),
        F.transform("p", lambda x: x["len"]).alias("packet_lengths"),
    )


def by_start(df: DataFrame, start: str = "ts_start", tie: str = "flow_id") -> DataFrame:
    """Flows in the order of their start."""
    return df.orderBy(start, tie)


def evictable(df: DataFrame, now: float, idle: float = IDLE_SECONDS, force: int = 0) -> DataFrame:
    """Flows to be closed: reset or finished ones, those idle for more than ``idle`` at ``now``, and the ``force`` oldest of the rest."""
    done = (F.col("flag_rst_count") > 0) | (F.col("flag_fin_count") > 0) | (F.lit(now) - F.col("ts_end") > idle)
    out = df.where(done)
    return out.unionByName(df.where(~done).orderBy("ts_start", "ts_end").limit(force)) if force else out
