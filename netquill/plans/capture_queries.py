"""Queries of the capture side: frames are written byte by byte from events, then decoded like any capture.

The tables hold no captures, so every event becomes an Ethernet frame: user and
server talk on a fixed 5-tuple (a port of 1,024 to 65,535 by the user), the event's type says which way and with which
flags, every tenth user's payload holds a certificate name.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flows, splits
from ..shared import fresh_dir
from ..sources import capture_scan, pcap
from ..streaming import evicting
from ..streaming import flows as streams
from . import extract
from .queries import query, seconds, table


#: Packets that a task writes of a capture, more or less.
PIECE_PACKETS = 100_000


def frames(spark, sf, events=None):
    """Events (those of the table, if none are given) as packets of captures: ``file``, ``pkt_no``, ``ts``, ``linktype``, ``raw``."""
    c, e = F.col, F.col("event_type")
    hex_ = lambda v, n: F.lpad(F.hex(v.cast("long")), n, "0")
    u = c("user_id")
    udp, out = u % 5 == 0, e.isin("click", "purchase", "signup")
    client, server = F.lit(10 << 24) + u % (1 << 24), F.lit((10 << 24) + (1 << 16)) + u % 7
    cport, sport = F.lit(1024) + u % 64_512, F.when(u % 2 == 0, 443).otherwise(8080)
    flags = F.when(e == "signup", 2).when(e == "purchase", 1).when(e == "error", 4).when(e == "click", 8).otherwise(16)
    cert = F.concat(F.lit("06035504030C10"), F.hex(F.concat(F.lit("host"), u.cast("string"), F.lit(".example.com"))))
    payload = F.when((u % 10 == 2) & (e == "view"), cert).otherwise(F.hex(F.repeat(F.lit("z"), F.floor("value").cast("int"))))
    pick = lambda a, b: F.when(out, a).otherwise(b)
    ip = F.concat(F.lit("4500"), F.lit("0000"), F.lit("0000000040"), F.when(udp, "11").otherwise("06"), F.lit("0000"), hex_(pick(client, server), 8), hex_(pick(server, client), 8))
    ports = F.concat(hex_(pick(cport, sport), 4), hex_(pick(sport, cport), 4))
    tcp = F.concat(ports, F.lit("0000000000000000"), F.lit("50"), hex_(flags, 2), F.lit("000000000000"))
    raw = F.concat(F.lit("0" * 24 + "0800"), ip, F.when(udp, F.concat(ports, F.lit("00000000"))).otherwise(tcp), payload)
    file = F.concat(F.lit("data/part/"), F.when(u % 2 == 0, "benign").otherwise("adware"), F.lit("/c.pcap"))
    return (table(spark, sf, "events") if events is None else events).select(file.alias("file"), c("event_id").alias("pkt_no"), seconds("ts").alias("ts"), F.lit(1).alias("linktype"), F.unhex(raw).alias("raw"))


_FRAMES = """e AS (SELECT *, epoch_us(ts) / 1e6 AS t, user_id % 5 = 0 AS udp, event_type IN ('click', 'purchase', 'signup') AS fwd, CASE WHEN user_id % 2 = 0 THEN 'benign' ELSE 'adware' END AS kind,
  '10.' || ((user_id >> 16) & 255) || '.' || ((user_id >> 8) & 255) || '.' || (user_id & 255) AS client, '10.1.0.' || (user_id % 7) AS server, CAST(1024 + user_id % 64512 AS INT) AS cport, CASE WHEN user_id % 2 = 0 THEN 443 ELSE 8080 END AS sport,
  CASE WHEN user_id % 10 = 2 AND event_type = 'view' THEN 7 + length('host' || user_id || '.example.com') ELSE CAST(floor(value) AS INT) END AS n FROM events),
k AS (SELECT *, CASE WHEN fwd THEN client ELSE server END AS src_ip, CASE WHEN fwd THEN server ELSE client END AS dst_ip, CASE WHEN fwd THEN cport ELSE sport END AS src_port, CASE WHEN fwd THEN sport ELSE cport END AS dst_port,
  CASE WHEN udp THEN 'udp' ELSE 'tcp' END AS protocol, CAST(14 + 20 + CASE WHEN udp THEN 8 ELSE 20 END + n AS INT) AS len FROM e)"""


@query(
    f"""WITH {_FRAMES} SELECT event_id AS pkt_no, t AS ts, src_ip, dst_ip, src_port, dst_port, protocol, len, CAST(n AS INT) AS payload_bytes, NOT udp AND event_type = 'signup' AS syn, NOT udp AND event_type = 'purchase' AS fin,
 NOT udp AND event_type = 'error' AS rst, NOT udp AND event_type = 'click' AS psh, NOT udp AND event_type = 'view' AS ack FROM k"""
)
def packet_decode(spark, sf):
    d = pcap.decode(frames(spark, sf))
    return d.select("pkt_no", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "len", F.length("payload").alias("payload_bytes"), "syn", "fin", "rst", "psh", "ack")


@query(
    f"""WITH {_FRAMES} SELECT CAST(row_number() OVER (PARTITION BY kind ORDER BY event_id) - 1 AS BIGINT) AS pkt_no, kind, t AS ts, src_ip, dst_ip, src_port, dst_port, protocol, len FROM k"""
)
def capture_ranges_read(spark, sf):
    """Events written as one capture per label, then read in byte ranges of 32 KB.

    Events are sorted before they are frames, so that rows of numbers move and not packets.
    """
    root = fresh_dir(spark, "captures")
    e, order = table(spark, sf, "events").drop("props"), (F.col("user_id") % 2 == 0, F.col("event_id"))
    e = e.repartitionByRange(max(1, -(-e.count() // PIECE_PACKETS)), *order).sortWithinPartitions(*order)
    label = F.element_at(F.split("file", "/"), -2).alias("label")
    pcap.write_in_order(frames(spark, sf, e).select(label, "linktype", "pkt_no", "ts", "raw"), root)
    d = pcap.decode(capture_scan.scan_captures(spark, root, 32 << 10))
    return d.select("pkt_no", F.element_at(F.split("file", "/"), -3).alias("kind"), "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "len")


def wide_frames(spark, sf):
    """The frames of :func:`frames` over IPv6, addresses as ``fd00::`` and the IPv4 one, every third behind a hop-by-hop header."""
    hexed = F.hex("raw")
    part = lambda at, n: F.substring(hexed, 2 * at + 1, 2 * n)
    rest = F.substring(hexed, 69, 1 << 20)
    chained = F.col("pkt_no") % 3 == 0
    proto, prefix = part(23, 1), F.lit("fd" + "0" * 22)
    size = F.lpad(F.hex((F.length(rest) / 2).cast("long") + F.when(chained, 8).otherwise(0)), 4, "0")
    ip = F.concat(F.lit("60000000"), size, F.when(chained, "00").otherwise(proto), F.lit("40"), prefix, part(26, 4), prefix, part(30, 4), F.when(chained, F.concat(proto, F.lit("00" * 7))).otherwise(""))
    return frames(spark, sf).withColumn("raw", F.unhex(F.concat(F.lit("0" * 24 + "86DD"), ip, rest)))


_WIDE = "'FD' || repeat('0', 22) || list_aggregate(list_transform(string_split({0}, '.'), lambda b: printf('%02X', CAST(b AS INT))), 'string_agg', '')"


@query(
    f"""WITH {_FRAMES} SELECT event_id AS pkt_no, {_WIDE.format("src_ip")} AS src, {_WIDE.format("dst_ip")} AS dst, src_port, dst_port, CAST(len + 20 + CASE WHEN event_id % 3 = 0 THEN 8 ELSE 0 END AS INT) AS len, CAST(n AS INT) AS payload_bytes
FROM k WHERE NOT udp AND (src_port = 443 OR dst_port = 443)"""
)
def packet_tls_ipv6(spark, sf):
    d = pcap.tls_packets(pcap.decode(wide_frames(spark, sf), ipv6=True))
    return d.select("pkt_no", F.hex("src_addr").alias("src"), F.hex("dst_addr").alias("dst"), "src_port", "dst_port", "len", F.length("payload").alias("payload_bytes"))


@query(f"WITH {_FRAMES} SELECT event_id AS pkt_no, src_port, dst_port FROM k WHERE NOT udp AND (src_port = 443 OR dst_port = 443)")
def packet_tls(spark, sf):
    return pcap.tls_packets(pcap.decode(frames(spark, sf))).select("pkt_no", "src_port", "dst_port")


@query(
    f"""WITH {_FRAMES}, f AS (SELECT user_id, min(event_id) AS pkt_no, arg_min(t, event_id) AS t FROM k WHERE NOT udp AND user_id % 10 = 2 AND event_type = 'view' GROUP BY user_id)
SELECT 'CN=host' || user_id || '.example.com' AS subject, sha256('host' || user_id || '.example.com') AS fp, t - 2592000.0 AS not_before, t + 31536000.0 AS not_after FROM f"""
)
def packet_certificates(spark, sf):
    return pcap.certificates(pcap.decode(frames(spark, sf)))[1].select("subject", "fp", "not_before", "not_after")


# a flow is a 5-tuple of a file, which users that are equal modulo 63 * 2**24 share
_FLOWS = f"""WITH {_FRAMES}, d AS (SELECT *, min(user_id) OVER w AS flow, arg_min(src_ip, event_id) OVER w AS f_ip, arg_min(src_port, event_id) OVER w AS f_port, arg_min(dst_ip, event_id) OVER w AS b_ip, arg_min(dst_port, event_id) OVER w AS b_port,
 t - lag(t) OVER (PARTITION BY kind, client, cport, server, sport, udp ORDER BY t, event_id) AS gap FROM k WINDOW w AS (PARTITION BY kind, client, cport, server, sport, udp)),
"""


@query(
    _FLOWS
    + """g AS (SELECT flow, any_value(kind) AS label, any_value(f_ip) AS src_ip, any_value(f_port) AS src_port, any_value(b_ip) AS dst_ip, any_value(b_port) AS dst_port, any_value(protocol) AS protocol, count(*) AS total_packets,
 CAST(sum(len) AS DOUBLE) AS total_bytes, count(*) FILTER (src_ip = f_ip) AS fwd_packets, count(*) FILTER (src_ip <> f_ip) AS bwd_packets, CAST(coalesce(sum(len) FILTER (src_ip = f_ip), 0) AS DOUBLE) AS fwd_bytes,
 round(stddev_pop(len) + 1e-9, 3) AS pkt_len_std, round(coalesce(max(gap), 0.0), 4) AS iat_max, round(coalesce(max(gap) FILTER (gap > 5), 0.0), 4) AS idle_max,
 CASE WHEN any_value(udp) THEN 'SF' WHEN bool_or(event_type = 'error') THEN 'RSTO' WHEN bool_or(event_type = 'signup') AND count(*) FILTER (event_type = 'view') = 1 THEN 'S0' WHEN bool_or(event_type = 'purchase') THEN 'SF' ELSE 'OTH' END AS conn_state,
 any_value(udp) AS udp FROM d GROUP BY flow)
SELECT * EXCLUDE (flow, udp), CAST(fwd_packets * CASE WHEN udp THEN 28 ELSE 40 END AS BIGINT) AS fwd_header_len, CAST(total_packets AS INT) AS offsets FROM g"""
)
def temporal_flows(spark, sf):
    t = extract.temporal_table(frames(spark, sf))
    cols = "label src_ip src_port dst_ip dst_port protocol total_packets total_bytes fwd_packets bwd_packets fwd_bytes iat_max idle_max conn_state".split()
    # the table's variance has four digits, whose root may round apart; the lengths give it exactly
    add = lambda f: F.aggregate("packet_lengths", F.lit(0).cast("long"), lambda t, x: t + f(x.cast("long")))
    n, total, squares = F.size("packet_lengths"), add(lambda x: x), add(lambda x: x * x)
    return t.select(*cols, F.round(F.sqrt(n * squares - total * total) / n + 1e-9, 3).alias("pkt_len_std"), F.col("fwd_header_len").cast("long").alias("fwd_header_len"), F.size("packet_time_offsets").alias("offsets"))


@query(
    _FLOWS
    + """g AS (SELECT flow, any_value(kind) AS label, any_value(f_ip) AS src_ip, any_value(b_ip) AS dst_ip, any_value(b_port) AS dst_port, any_value(protocol) AS protocol, count(*) AS pkts_total, count(*) FILTER (src_ip = f_ip) AS pkts_forward,
 CAST(sum(len) AS DOUBLE) AS bytes_total, count(*) FILTER (NOT udp AND event_type = 'signup') AS flag_syn_count, arg_min(t, event_id) AS start, max(event_id) AS last,
 arg_max(CASE WHEN NOT udp AND user_id % 10 = 2 AND event_type = 'view' THEN 'host' || user_id || '.example.com' END, event_id) AS cn, any_value(udp) AS udp,
 CASE WHEN bool_or(NOT udp AND event_type = 'error') THEN 'RSTO' WHEN NOT any_value(udp) AND arg_min(event_type, event_id) = 'signup' THEN 'S0' ELSE 'SF' END AS state FROM d GROUP BY flow),
w AS (SELECT a.flow, count(*) AS conn_count, count(*) FILTER (b.state = 'RSTO') AS tcp_rst_count FROM g a JOIN g b ON a.label = b.label AND b.start BETWEEN a.start - 60 AND a.start + 60 GROUP BY a.flow)
SELECT label, 'part' AS dataset_source, label AS subfolder, 'c.pcap' AS pcap_filename, src_ip, dst_ip, dst_port, protocol, pkts_total, pkts_forward, bytes_total, flag_syn_count, CAST(coalesce(length(cn), 0) AS INT) AS cn_length,
 CAST(CASE WHEN cn IS NULL THEN 0 ELSE 1 END AS INT) AS cert_chain_depth, CASE WHEN cn IS NULL THEN -1.0 ELSE 395.0 END AS cert_valid_days, conn_count, tcp_rst_count, state AS conn_state, coalesce(cn, '-') AS server_name FROM g JOIN w USING (flow)"""
)
def feature_flows(spark, sf):
    t = extract.feature_table(frames(spark, sf))
    cols = "label dataset_source subfolder pcap_filename src_ip dst_ip dst_port protocol pkts_total pkts_forward bytes_total flag_syn_count cn_length cert_chain_depth cert_valid_days conn_count tcp_rst_count".split()
    return t.select(*cols, F.get_json_object("zeek_conn_log", "$.conn_state").alias("conn_state"), F.get_json_object("zeek_ssl_log", "$.server_name").alias("server_name"))


@query(
    _FLOWS
    + """g AS (SELECT flow, any_value(kind) AS kind, any_value(f_ip) AS src_ip, any_value(b_ip) AS dst_ip, arg_max(CASE WHEN NOT udp AND user_id % 10 = 2 AND event_type = 'view' THEN 'host' || user_id || '.example.com' END, event_id) AS cn, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY flow)
SELECT src_ip, dst_ip, CAST(kind = 'adware' AS INT) AS label, kind AS label_name, CASE WHEN cn IS NULL THEN 2 ELSE 3 END AS num_events, n AS pkts_total, cn AS sni FROM g"""
)
def flow_rows(spark, sf):
    """Text rows of the feature table: records in the text, label, numbers, and the server name read back from the logs."""
    j = extract.flow_jsonl(extract.feature_table(frames(spark, sf)))
    sni = F.nullif(F.regexp_extract("text", r'"s":\{[^}]*"sni":"([^"]*)"', 1), F.lit(""))
    return j.select("src_ip", "dst_ip", "label", "label_name", "num_events", F.col("num_features")["pkts_total"].alias("pkts_total"), sni.alias("sni"))


@query(
    """WITH p AS (SELECT user_id AS flow_id, epoch_us(ts) / 1e6 AS ts, event_id, event_type FROM events), g AS (SELECT flow_id, arg_min(ts, event_id) AS ts_start, arg_max(ts, event_id) AS ts_end, bool_or(event_type IN ('error', 'purchase')) AS done FROM p GROUP BY flow_id),
m AS (SELECT max(ts) AS now FROM p), c AS (SELECT flow_id, ts_start, ts_end, done OR now - ts_end > 3600 AS closed FROM g, m)
SELECT flow_id, ts_start FROM c WHERE closed UNION ALL SELECT flow_id, ts_start FROM (SELECT * FROM c WHERE NOT closed ORDER BY ts_start, ts_end LIMIT 3)"""
)
def flow_eviction(spark, sf):
    from .queries import packets

    p = packets(spark, sf)
    now = p.agg(F.max("ts")).first()[0] or 0.0
    return flows.evictable(flows.flow_statistics(p, ["flow_id"]), now, 3600.0, 3).select("flow_id", "ts_start")


@query("""WITH p AS (SELECT user_id AS flow_id, epoch_us(ts) / 1e6 AS ts, event_id FROM events) SELECT flow_id, ts_start, CAST(row_number() OVER (ORDER BY ts_start, flow_id) AS INT) AS place FROM (SELECT flow_id, arg_min(ts, event_id) AS ts_start FROM p GROUP BY flow_id)""")
def flows_by_start(spark, sf):
    """Flows in the order of their start; a range sort gives the order, and places come from partition counts, not from one task."""
    from .queries import packets

    s = flows.flow_statistics(packets(spark, sf), ["flow_id"]).select("flow_id", "ts_start")
    return splits.numbered(s, ["ts_start", "flow_id"]).withColumn("place", F.col("place").cast("int"))


_NEARBY = """SELECT a.event_id AS click, b.event_id AS error FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'error'"""


@query(_NEARBY)
def stream_nearby(spark, sf):
    """The interval join of two streams, in its batch form."""
    e = table(spark, sf, "events")
    left = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("click"))
    right = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("other"), F.col("event_id").alias("error"))
    return streams.nearby(left, right, "user_id", "at", "other", "1 hour").select("click", "error")


@query(_NEARBY)
def streams_joined(spark, sf):
    """The same by two streams over the events' file, run to its end and read from the sink."""
    schema = table(spark, sf, "events").schema
    events = lambda: spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    left = events().where("event_type = 'click'").select("user_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("click"))
    right = events().where("event_type = 'error'").select("user_id", F.col("ts").cast("timestamp").alias("other"), F.col("event_id").alias("error"))
    root = fresh_dir(spark, "streams-joined")
    joined = streams.nearby(left, right, "user_id", "at", "other", "1 hour").select("click", "error")
    run = joined.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start(f"{root}/rows")
    run.awaitTermination()
    return spark.read.schema("click long, error long").parquet(f"{root}/rows")


@query(
    """WITH p AS (SELECT CAST(user_id AS VARCHAR) AS flow_id, epoch_us(ts) / 1e6 AS t, event_type = 'purchase' AS fin, event_type = 'error' AS rst FROM events),
o AS (SELECT *, lag(t) OVER w AS before, lag(fin OR rst) OVER w AS was_done FROM p WINDOW w AS (PARTITION BY flow_id ORDER BY t)),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR was_done OR t - before > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY t) AS k FROM o),
a AS (SELECT flow_id, k, count(*) AS packets, min(t) AS ts_start, max(t) AS ts_end, bool_or(fin) AS fin, bool_or(rst) AS rst FROM g GROUP BY ALL),
e AS (SELECT *, max(k) OVER (PARTITION BY flow_id) = k AS latest, max(ts_end) OVER () - 10 AS seen FROM a)
SELECT flow_id, packets, ts_start, ts_end, CASE WHEN rst THEN 'reset' WHEN fin THEN 'finished' ELSE 'idle' END AS reason FROM e WHERE fin OR rst OR NOT latest OR ts_end + 43200 < seen"""
)
def flows_evicted(spark, sf):
    """The events' file as a stream of packets, flows closed by state and timers, read from the sink."""
    store = "spark.sql.streaming.stateStore.providerClass"
    e = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    kind = F.col("event_type")
    packets = e.select(F.col("user_id").alias("flow_id"), F.col("ts").cast("timestamp").alias("event_time"), seconds("ts").alias("ts"), F.col("value").alias("len"), F.lit(0).alias("syn"), (kind == "purchase").cast("int").alias("fin"), (kind == "error").cast("int").alias("rst"))
    root, old = fresh_dir(spark, "flows-evicted"), spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = evicting.evicting_flows(packets, idle=43_200.0).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start(f"{root}/rows")
        run.awaitTermination()
    finally:
        spark.conf.set(store, old)
    return spark.read.schema("flow_id string, packets long, ts_start double, ts_end double, reason string").parquet(f"{root}/rows")


@query(
    f"""WITH {_FRAMES} SELECT kind AS label, 1 AS linktype, t AS ts, src_ip, dst_ip, src_port, dst_port, len FROM k"""
)
def captures_by_label(spark, sf):
    """Packets written as captures by label and link type, then read back by label folder."""
    root = fresh_dir(spark, "captures-by-label")
    spark.dataSource.register(pcap.PcapSource)
    label = F.element_at(F.split("file", "/"), -2)
    frames(spark, sf).select(label.alias("label"), "linktype", "ts", "raw").write.format("pcap").mode("append").save(root)
    d = pcap.decode(capture_scan.scan_captures(spark, root, glob="part-*.pcap"))
    return d.select(F.element_at(F.split("file", "/"), -3).alias("label"), "linktype", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "len")


@query(f"WITH {_FRAMES} SELECT t AS ts, kind, len FROM k WHERE t >= 1704240000 AND t < 1705000000.5 AND kind = 'benign'")
def captures_in_window(spark, sf):
    """Captures by label; the source reads packets of a span of time and of one link type only."""
    spark.dataSource.register(pcap.PcapSource)
    root = fresh_dir(spark, "window-captures")
    kind = F.element_at(F.split("file", "/"), -2).alias("label")
    frames(spark, sf).select(kind, "linktype", "ts", "raw").write.format("pcap").mode("append").save(root)
    found = pcap.open_captures(spark, root, [("ts", ">=", 1704240000), ("ts", "<", 1705000000.5), ("linktype", "=", 1)])
    label = F.element_at(F.split("file", "/"), -3)
    return found.where(label == "benign").select("ts", label.alias("kind"), F.length("raw").cast("int").alias("len"))
