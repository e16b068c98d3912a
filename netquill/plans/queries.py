"""Queries over the shared test tables, each with the SQL that says the same.

The tables hold no captures, so two views stand in.  Packets: an event is a
packet of the flow ``user_id``.  Connections: an event is a connection from
``user_id`` to its type and ``props.k``.  Thresholds are scaled to the events'
density (43,200 s of idleness, frames of an hour on both sides).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import features, flows, joins, metrics, splits, vectors, windows
from ..sources import files
from . import detect

IDLE, SPAN, TAU = 43_200.0, 3_600, 1_800.0
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.replace("{PACKETS}", PACKETS_SQL).replace("{CONNS}", CONNS_SQL)
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seconds(col):
    return F.unix_micros(F.col(col).cast("timestamp")) / F.lit(1e6)


def packets(spark, sf) -> DataFrame:
    e = F.col("event_type")
    flag = lambda k: F.when(e == k, 1).otherwise(0)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("flow_id"),
        F.col("event_id").alias("pkt_no"),
        seconds("ts").alias("ts"),
        F.col("value").alias("len"),
        F.when(e.isin("click", "purchase", "signup"), "F").otherwise("B").alias("dir"),
        flag("signup").alias("syn"),
        flag("purchase").alias("fin"),
        flag("error").alias("rst"),
        flag("click").alias("psh"),
        flag("view").alias("ack"),
    )


PACKETS_SQL = """p AS (SELECT user_id AS flow_id, event_id AS pkt_no, epoch_us(ts) / 1e6 AS ts, value AS len,
  CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'F' ELSE 'B' END AS dir,
  CAST(event_type = 'signup' AS INT) AS syn, CAST(event_type = 'purchase' AS INT) AS fin, CAST(event_type = 'error' AS INT) AS rst,
  CAST(event_type = 'click' AS INT) AS psh, CAST(event_type = 'view' AS INT) AS ack FROM events)"""


def connections(spark, sf) -> DataFrame:
    e = F.col("event_type")
    return table(spark, sf, "events").select(
        F.lit("events").alias("file"),
        F.col("event_id").alias("conn_id"),
        seconds("ts").alias("ts"),
        F.col("user_id").alias("src"),
        e.alias("dst"),
        F.get_json_object("props", "$.k").cast("int").alias("dport"),
        F.col("value").alias("duration"),
        F.when(e == "error", "RSTO").when(e == "signup", "S0").otherwise("SF").alias("state"),
    )


CONNS_SQL = """c AS (SELECT event_id AS conn_id, epoch_us(ts) / 1e6 AS ts, user_id AS src, event_type AS dst, CAST(json_extract_string(props, '$.k') AS INT) AS dport,
  value AS duration, CASE event_type WHEN 'error' THEN 'RSTO' WHEN 'signup' THEN 'S0' ELSE 'SF' END AS state FROM events)"""


def _stat_sql(x: str, name: str, which=("max", "min", "mean", "std")) -> str:
    fn = {"max": "max", "min": "min", "mean": "avg", "std": "stddev_pop", "var": "var_pop"}
    return ", ".join(f"round(coalesce({fn[k]}({x}), 0.0), 4) AS {name}_{k}" for k in which)


_FWD, _BWD = "CASE WHEN dir = 'F' THEN len END", "CASE WHEN dir = 'B' THEN len END"


@query(
    f"""WITH {{PACKETS}}, g AS (SELECT flow_id, arg_min(ts, pkt_no) AS ts_start, arg_max(ts, pkt_no) AS ts_end,
 count(*) FILTER (dir = 'F') AS pkts_forward, count(*) FILTER (dir = 'B') AS pkts_backward, count(*) AS pkts_total,
 round(coalesce(sum({_FWD}), 0.0), 4) AS bytes_forward, round(coalesce(sum({_BWD}), 0.0), 4) AS bytes_backward, round(coalesce(sum(len), 0.0), 4) AS bytes_total,
 {_stat_sql("len", "pkt_len", ("max", "min", "mean", "std", "var"))}, {_stat_sql(_FWD, "pkt_len_fwd", ("mean", "std"))}, {_stat_sql(_BWD, "pkt_len_bwd", ("mean", "std"))},
 {", ".join(f"CAST(sum({k}) AS BIGINT) AS flag_{k}_count" for k in flows.FLAGS)},
 CASE WHEN max(rst) = 1 THEN 'RSTO' WHEN arg_min(syn, pkt_no) = 1 THEN 'S0' ELSE 'SF' END AS conn_state FROM p GROUP BY flow_id),
d AS (SELECT *, greatest(ts_end - ts_start, 1e-4) AS d FROM g)
SELECT * EXCLUDE (d), round(bytes_total / d, 4) AS flow_bytes_s, round(pkts_total / d, 4) AS flow_pkts_s, round(pkts_forward / d, 4) AS fwd_pkts_s, round(pkts_backward / d, 4) AS bwd_pkts_s,
 CASE WHEN bytes_forward > 0 THEN round(bytes_backward / bytes_forward, 4) ELSE 0.0 END AS ratio_bytes_back_to_forward,
 CASE WHEN pkts_forward > 0 THEN round(pkts_backward / pkts_forward, 4) ELSE 0.0 END AS down_up_ratio,
 pkts_forward * 40 AS fwd_header_len, pkts_backward * 40 AS bwd_header_len,
 CASE WHEN flag_rst_count > 0 THEN 'RSTO' WHEN flag_syn_count > 0 AND flag_ack_count = 1 THEN 'S0' WHEN flag_fin_count > 0 THEN 'SF' ELSE 'OTH' END AS temporal_state FROM d"""
)
def flow_stats(spark, sf):
    return flows.temporal_state(flows.flow_statistics(packets(spark, sf), ["flow_id"]))


@query(
    f"""WITH {{PACKETS}}, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY flow_id ORDER BY pkt_no) AS g, ts - lag(ts) OVER (PARTITION BY flow_id, dir ORDER BY pkt_no) AS d FROM p)
SELECT flow_id, {_stat_sql("g", "iat")}, {_stat_sql("CASE WHEN dir = 'F' THEN d END", "iat_fwd")}, {_stat_sql("CASE WHEN dir = 'B' THEN d END", "iat_bwd")} FROM g GROUP BY flow_id"""
)
def flow_iat(spark, sf):
    return flows.flow_gaps(packets(spark, sf), ["flow_id"])


_RUNS = f"""WITH {{PACKETS}}, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY flow_id ORDER BY ts, pkt_no) AS gap FROM p),
r AS (SELECT *, sum(CASE WHEN gap > {IDLE} THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY ts, pkt_no ROWS UNBOUNDED PRECEDING) AS run FROM g),
s AS (SELECT flow_id, run, max(ts) - min(ts) AS active, max(CASE WHEN gap > {IDLE} THEN gap END) AS idle, max(run) OVER (PARTITION BY flow_id) AS last FROM r GROUP BY flow_id, run)
SELECT flow_id, """


@query(_RUNS + f"{_stat_sql('active', 'active')}, {_stat_sql('idle', 'idle')} FROM s GROUP BY flow_id")
def flow_active_idle(spark, sf):
    return flows.active_idle(packets(spark, sf), ["flow_id"], IDLE)


@query(_RUNS + f"{_stat_sql('CASE WHEN run < last THEN active END', 'active')}, {_stat_sql('idle', 'idle')} FROM s GROUP BY flow_id")
def flow_active_idle_online(spark, sf):
    return flows.active_idle(packets(spark, sf), ["flow_id"], IDLE, keep_last=False)


@query(
    f"""WITH {{PACKETS}}, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY flow_id ORDER BY ts, pkt_no) AS gap FROM p),
r AS (SELECT *, sum(CASE WHEN gap > {IDLE} THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY ts, pkt_no ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT flow_id, count(*) AS packets, round(sum(len), 4) AS bytes, min(ts) AS first, max(ts) AS last FROM r GROUP BY flow_id, run"""
)
def flow_sessions(spark, sf):
    from ..streaming.flows import sessions

    p = packets(spark, sf).withColumn("at", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long")))
    s = sessions(p, ["flow_id"], "at", f"{int(IDLE)} seconds")
    return s.select("flow_id", "packets", F.round("bytes", 4).alias("bytes"), *[(F.unix_micros(c) / F.lit(1e6)).alias(c) for c in ("first", "last")])


@query("WITH {PACKETS} SELECT flow_id, pkt_no, ts, dir FROM p QUALIFY row_number() OVER (PARTITION BY flow_id ORDER BY pkt_no) <= 20")
def flow_truncate(spark, sf):
    return flows.first_packets(packets(spark, sf), ["flow_id"], 20).select("flow_id", "pkt_no", "ts", "dir")


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS src_ip, l_suppkey % 50 AS dst_ip, l_linenumber AS src_port, l_linenumber % 3 AS dst_port FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN src_ip < dst_ip THEN src_ip ELSE dst_ip END AS key_ip1, CASE WHEN src_ip < dst_ip THEN src_port ELSE dst_port END AS key_port1,
 CASE WHEN src_ip < dst_ip THEN dst_ip ELSE src_ip END AS key_ip2, CASE WHEN src_ip < dst_ip THEN dst_port ELSE src_port END AS key_port2 FROM l"""
)
def flow_sorted_key(spark, sf):
    x = _ends(spark, sf)
    return flows.four_tuple_key(x).select("l_orderkey", "l_linenumber", "key_ip1", "key_port1", "key_ip2", "key_port2")


def _ends(spark, sf):
    mod = lambda c, n: F.col(c) % n
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", mod("l_partkey", 50).alias("src_ip"), mod("l_suppkey", 50).alias("dst_ip"), F.col("l_linenumber").alias("src_port"), mod("l_linenumber", 3).alias("dst_port"), F.lit("tcp").alias("protocol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pkt_no"))


@query(
    """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS pkt_no, l_partkey % 50 AS s, l_suppkey % 50 AS d, CAST(l_linenumber AS BIGINT) AS sp, CAST(l_linenumber % 3 AS BIGINT) AS dp FROM lineitem),
k AS (SELECT *, CASE WHEN (s, sp) <= (d, dp) THEN (s, sp, d, dp) ELSE (d, dp, s, sp) END AS k FROM l),
f AS (SELECT k, arg_min(s, pkt_no) AS fwd_ip, arg_min(sp, pkt_no) AS fwd_port, count(*) AS packets FROM k GROUP BY k)
SELECT fwd_ip, fwd_port, packets, count(*) FILTER (s = fwd_ip) AS forward FROM k JOIN f USING (k) GROUP BY f.k, fwd_ip, fwd_port, packets"""
)
def flow_bidir_key(spark, sf):
    x = _ends(spark, sf).withColumn("src_port", F.col("src_port").cast("long")).withColumn("dst_port", F.col("dst_port").cast("long"))
    g = flows.five_tuple_flows(x).groupBy("fwd_ip", "fwd_port", "bwd_ip", "bwd_port").agg(F.count(F.lit(1)).alias("packets"), F.count_if(F.col("dir") == "F").alias("forward"))
    return g.select("fwd_ip", "fwd_port", "packets", "forward")


@query(
    """WITH {PACKETS}, f AS (SELECT flow_id, min(ts) AS t0 FROM p GROUP BY flow_id)
SELECT flow_id, list(round(ts - t0, 6) ORDER BY ts, pkt_no) AS packet_time_offsets, list(dir ORDER BY ts, pkt_no) AS packet_directions, list(len ORDER BY ts, pkt_no) AS packet_lengths
FROM p JOIN f USING (flow_id) GROUP BY flow_id"""
)
def flow_arrays(spark, sf):
    return flows.packet_arrays(packets(spark, sf), ["flow_id"])


_NEAR = f"FROM c a JOIN c b ON b.ts BETWEEN a.ts - {SPAN} AND a.ts + {SPAN}"


@query(
    f"""WITH {{CONNS}}, w AS (SELECT a.conn_id, count(*) AS conn_count, count(*) FILTER (b.state = 'RSTO') AS tcp_rst_count, count(*) FILTER (b.state = 'S0') AS fail,
 count(*) FILTER (a.src = b.src AND a.dst = b.dst AND a.dport IS NOT DISTINCT FROM b.dport) AS reconnect_count, count(*) FILTER (a.src = b.src) AS n_src, count(*) FILTER (a.src = b.src AND b.state <> 'SF') AS bad {_NEAR} GROUP BY a.conn_id)
SELECT conn_id, conn_count, tcp_rst_count, reconnect_count, round(tcp_rst_count / conn_count, 4) AS rst_ratio, round(fail / conn_count, 4) AS handshake_fail_rate,
 CAST(reconnect_count > 1 AS INT) AS reconnection_flag, round(bad / n_src, 4) AS src_ip_abnormal_ratio, round(bad / conn_count, 4) AS abnormal_to_conn_ratio FROM w"""
)
def conn_window_counts(spark, sf):
    return windows.window_counts(connections(spark, sf), SPAN).drop("file", "ts", "src", "dst", "dport", "duration", "state")


@query(f"WITH {{CONNS}} SELECT a.conn_id, CAST(count(DISTINCT (b.dst, b.dport)) AS INT) AS unique_dst_count {_NEAR} AND a.src = b.src GROUP BY a.conn_id")
def conn_window_distinct(spark, sf):
    return windows.window_distinct(connections(spark, sf), SPAN).select("conn_id", "unique_dst_count")


@query(
    f"""WITH {{CONNS}}, w AS (SELECT a.conn_id, list(b.duration ORDER BY b.duration) AS v {_NEAR} GROUP BY a.conn_id)
SELECT conn_id, {", ".join(f"v[least(CAST(floor(len(v) * {q}) AS INT), len(v) - 1) + 1] AS duration_p{n}" for n, q in ((25, 0.25), (50, 0.5), (75, 0.75)))} FROM w"""
)
def conn_window_percentiles(spark, sf):
    return windows.window_percentiles(connections(spark, sf), SPAN).select("conn_id", "duration_p25", "duration_p50", "duration_p75")


@query(
    f"""WITH {{CONNS}}, w AS (SELECT a.conn_id, sum(exp(-abs(a.ts - b.ts) / {TAU})) AS n, sum(b.duration * exp(-abs(a.ts - b.ts) / {TAU})) AS d {_NEAR} GROUP BY a.conn_id)
SELECT conn_id, round(n, 4) AS weighted_conn_count, round(d / n, 4) AS weighted_avg_duration FROM w"""
)
def conn_window_decay(spark, sf):
    return windows.window_decay(connections(spark, sf), SPAN, TAU).select("conn_id", "weighted_conn_count", "weighted_avg_duration")


@query(
    f"""WITH {{CONNS}}, w AS (SELECT a.conn_id, b.ts - lag(b.ts) OVER (PARTITION BY a.conn_id ORDER BY b.ts) AS d {_NEAR} AND a.src = b.src AND a.dst = b.dst AND a.dport IS NOT DISTINCT FROM b.dport)
SELECT conn_id, round(coalesce(stddev_pop(d), 0.0), 4) AS flow_interval_jitter, round(coalesce(avg(d), 0.0), 4) AS flow_interval_diff_mean FROM w GROUP BY conn_id"""
)
def conn_jitter(spark, sf):
    return windows.window_jitter(connections(spark, sf), SPAN).select("conn_id", "flow_interval_jitter", "flow_interval_diff_mean")


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey % 150 AS k, CAST(epoch(o_orderdate) AS BIGINT) % 2592000 AS t FROM orders),
e AS (SELECT event_id, user_id % 150 AS k, CAST(floor(epoch(ts)) AS BIGINT) % 2592000 AS t FROM events)
SELECT event_id, k, t FROM e WHERE EXISTS (SELECT 1 FROM o WHERE o.k = e.k AND abs(o.t - e.t) <= 600 AND o.t > 0)"""
)
def interval_semi_join(spark, sf):
    month = 2_592_000
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 150).alias("k"), (F.floor(seconds("ts")) % month).alias("t"))
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 150).alias("k"), (F.floor(seconds("o_orderdate")) % month).alias("t"))
    return joins.interval_semi_join(e, o, ["k"], "t", "t", 600)


_HOST = "h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS cn FROM pages)"


def hosts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("cn"))


@query(
    f"""WITH {_HOST}, n AS (SELECT *, length(cn) AS n FROM h)
SELECT page_id, cn, CASE WHEN n > 0 THEN round(len(regexp_extract_all(cn, '[aeiouAEIOU]')) / n, 4) ELSE 0.0 END AS cn_vowel_ratio, CASE WHEN n > 0 THEN round(len(regexp_extract_all(cn, '[0-9]')) / n, 4) ELSE 0.0 END AS cn_digit_density,
 CASE WHEN n > 0 THEN round(len(regexp_extract_all(cn, '[^\\p{{L}}\\p{{N}}]')) / n, 4) ELSE 0.0 END AS cn_special_char_density FROM n"""
)
def cn_features(spark, sf):
    h = hosts(spark, sf)
    return h.withColumns(scalar.char_ratios(F.col("cn")))


@query(f"WITH {_HOST} SELECT page_id, CAST(length(cn) AS INT) AS cn_length, CAST(CAST(('0x' || right(md5(cn), 3)) AS INT) % 1024 AS INT) AS cn_hash, sha256(cn) AS fp FROM h")
def cn_hash(spark, sf):
    return hosts(spark, sf).select("page_id", F.length("cn").alias("cn_length"), scalar.name_hash(F.col("cn")).alias("cn_hash"), F.sha2(F.col("cn").cast("binary"), 256).alias("fp"))


@query(
    f"""WITH {_HOST}, t AS (SELECT *, lower(split_part(cn, '.', -1)) AS tld FROM h), k AS (SELECT tld FROM t GROUP BY tld HAVING count(*) >= 5),
u AS (SELECT t.*, coalesce(k.tld, 'other') AS common FROM t LEFT JOIN k ON t.tld = k.tld), c AS (SELECT common, row_number() OVER (ORDER BY common) - 1 AS code FROM (SELECT DISTINCT common FROM u)),
e AS (SELECT page_id, -sum(q * log2(q)) AS h FROM (SELECT page_id, n / sum(n) OVER (PARTITION BY page_id) AS q FROM (SELECT page_id, ch, count(*) AS n FROM (SELECT page_id, unnest(string_split(cn, '')) AS ch FROM h) GROUP BY page_id, ch)) GROUP BY page_id)
SELECT page_id, CAST(length(cn) AS INT) AS cn_len, CAST(greatest(0, len(string_split(regexp_replace(cn, '\\.$', ''), '.')) - 1) AS INT) AS cn_subdomain_count,
 CAST(regexp_matches(cn, '^(\\d{{1,3}}\\.){{3}}\\d{{1,3}}$') AS INT) AS cn_has_ip, round(coalesce(e.h, 0.0), 6) AS cn_entropy, CAST(starts_with(cn, 'www.') AS INT) AS cn_is_www,
 round(len(regexp_extract_all(cn, '[0-9]')) / greatest(length(cn), 1), 6) AS cn_digit_ratio, CAST(contains(cn, '-') AS INT) AS cn_has_hyphen, CAST(c.code AS INT) AS cn_tld_encoded
FROM u JOIN c USING (common) LEFT JOIN e USING (page_id)"""
)
def cn_entropy(spark, sf):
    return features.name_feature_table(hosts(spark, sf), "cn").drop("cn")


@query(
    """SELECT doc_id, CASE WHEN t NOT IN ('', '-', 'nan', 'NaN', 'None', 'null') THEN md5(replace(replace(t, '"', ''''), chr(10), ' ')) END AS cleaned_md5,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS marker
FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS t FROM documents)"""
)
def null_normalize(spark, sf):
    m = F.when(F.col("doc_id") % 3 == 0, F.get(F.array(*[F.lit(x) for x in ("nan", " - ", "None")]), (F.col("doc_id") % 3).cast("int"))).otherwise(F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", F.md5(scalar.clean_value(F.col("text")).cast("binary")).alias("cleaned_md5"), scalar.clean_value(m).alias("marker"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN NULL WHEN event_id % 7 = 2 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events")
def safe_numeric(spark, sf):
    k = F.get_json_object("props", "$.k")
    n = F.col("event_id") % 7
    raw = F.when(n == 0, "inf").when(n == 1, " NaN ").when(n == 2, "12x").otherwise(F.concat(F.lit(" "), k, F.lit(" ")))
    return table(spark, sf, "events").select("event_id", scalar.safe_number(raw).alias("k"))


@query(
    """SELECT event_id, '{"c":{' || '"proto":"' || event_type || '"' || CASE WHEN event_id % 2 = 0 THEN ',"dur":"' || CAST(event_id AS VARCHAR) || '"' ELSE '' END || '}} {"x":{"ver":"3"}}' AS text, 2 AS num_events FROM events"""
)
def flow_text(spark, sf):
    e = table(spark, sf, "events")
    conn = scalar.compact_json({"proto": F.col("event_type"), "dur": scalar.clean_value(F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("-"))}, "c")
    cert = scalar.compact_json({"ver": F.lit("3")}, "x")
    parts = F.array(conn, cert)
    return e.select("event_id", F.concat_ws(" ", parts).alias("text"), F.size(parts).alias("num_events"))


@query("""SELECT CAST(min(n) AS BIGINT) AS min_events, CAST(max(n) AS BIGINT) AS max_events, round(avg(n), 4) AS avg_events, count(*) FILTER (length(t) = 0) AS empty_texts, count(*) AS n
FROM (SELECT conv_id, count(*) AS n, coalesce(string_agg(text, ' ' ORDER BY turn, text), '') AS t FROM conversations GROUP BY conv_id)""")
def text_summary(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("events"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])).alias("text"))
    return metrics.text_summary(c, "events", "text")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type AS sni, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'TLSv1.2' END AS tls_version FROM events")
def tls_parse(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    cell = F.when(F.col("event_id") % 5 == 0, F.format_string("{'s': {'server_name': '%s', 'version': None, 'resumed': True, 'k': %s}}", "event_type", k)).otherwise(
        F.format_string("{'s': {'server_name': '%s', 'version': 'TLSv1.2', 'k': %s}}", "event_type", k)
    )
    schema = "struct<s:struct<server_name:string,version:string,k:int>>"
    fast = scalar.parse_struct(cell, schema)["s"]
    x = e.select("event_id", cell.alias("cell"), fast.alias("fast"))
    slow = F.from_json(scalar.literal_to_json(F.when(F.col("fast.server_name").isNull(), F.col("cell"))), schema)["s"]
    x = x.withColumn("v", F.when(F.col("fast.server_name").isNull(), slow).otherwise(F.col("fast")))
    return x.select("event_id", "v.k", F.nullif(F.col("v.server_name"), F.lit("")).alias("sni"), F.nullif(F.col("v.version"), F.lit("")).alias("tls_version"))


@query("SELECT doc_id, CAST(dense_rank() OVER (ORDER BY coalesce(lang, 'nan')) - 1 AS INT) AS lang_code FROM documents")
def label_encode(spark, sf):
    return features.label_encode(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "lang_code").select("doc_id", "lang_code")


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_size, p_brand) >= 5 THEN p_brand || ':' || p_size ELSE 'other' END AS kind FROM part")
def frequent_collapse(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(":", "p_brand", "p_size").alias("k"))
    return features.collapse_rare(p, "k", "kind").select("p_partkey", "kind")


@query("""WITH x AS (SELECT d.doc_id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, coalesce(CAST(quality AS DOUBLE), (SELECT median(quality) FROM x)) AS quality FROM x""")
def median_impute(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return features.impute_median(x, ["n_chars", "quality"])


_MATRIX = """g AS (SELECT a.k AS true_label, b.k AS pred_label FROM (VALUES (0), (1)) a(k), (VALUES (0), (1)) b(k)),
m AS (SELECT g.true_label, g.pred_label, count(l.doc_id) AS n FROM g LEFT JOIN labels l ON l.quality = g.true_label AND l.toxic = g.pred_label GROUP BY ALL)"""


@query(f"WITH {_MATRIX} SELECT true_label, pred_label, n, CASE WHEN sum(n) OVER w > 0 THEN round(n / sum(n) OVER w, 4) ELSE 0.0 END AS share FROM m WINDOW w AS (PARTITION BY true_label)")
def confusion(spark, sf):
    return metrics.confusion(table(spark, sf, "labels"), "quality", "toxic", [0, 1])


@query(
    f"""WITH {_MATRIX}, t AS (SELECT k, sum(n) FILTER (true_label = k AND pred_label = k) AS tp, sum(n) FILTER (true_label = k) AS support, sum(n) FILTER (pred_label = k) AS predicted FROM m, (VALUES (0), (1)) x(k) GROUP BY k),
r AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM t),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM r)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM (
SELECT CAST(k AS VARCHAR) AS class, p, r, f, support AS s FROM f UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM f
UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM f UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM f)"""
)
def class_report(spark, sf):
    return metrics.class_report(table(spark, sf, "labels"), "quality", "toxic", [0, 1])


@query("SELECT quality AS label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS balanced_weight, round(1.0 / count(*), 6) AS sampling_weight FROM labels WHERE quality IS NOT NULL GROUP BY quality")
def class_weights(spark, sf):
    return metrics.class_weights(table(spark, sf, "labels"), "quality")


_AUC = "x AS (SELECT l.quality AS y, (d.n_chars % 1000) / 1000.0 AS s, d.lang FROM labels l JOIN documents d USING (doc_id))"


def _scored(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id").select(F.col("quality").alias("y"), ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("s"), "lang")


@query(f"WITH {_AUC}, r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM x) SELECT count(*) AS n, round((sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r")
def micro_auc(spark, sf):
    return metrics.micro_auc(_scored(spark, sf), "y", "s")


@query(
    f"""WITH {_AUC}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2 AS k FROM x)
SELECT lang, count(*) AS n, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN round((sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) END AS auc FROM r GROUP BY lang"""
)
def group_auc(spark, sf):
    return metrics.micro_auc(_scored(spark, sf), "y", "s", by=["lang"])


@query(
    """WITH v AS (SELECT user_id, CAST(floor(value) AS INT) % 4 AS label, value / 500 AS c FROM events), g AS (SELECT user_id, label, count(*) AS n FROM v GROUP BY ALL)
SELECT user_id, (SELECT label FROM g WHERE g.user_id = u.user_id ORDER BY n DESC, label LIMIT 1) AS label, round(u.c, 6) AS confidence FROM (SELECT user_id, avg(c) AS c FROM v GROUP BY user_id) u"""
)
def majority_vote(spark, sf):
    v = table(spark, sf, "events").select("user_id", (F.floor("value").cast("int") % 4).alias("label"), (F.col("value") / 500).alias("c"))
    return metrics.majority_vote(v, "user_id", "label", "c")


_CLASS = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 0 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END"


def _classed(spark, sf):
    e = F.col("event_type")
    return table(spark, sf, "events").withColumn("label", F.when(e.isin("view", "click"), 0).when(e == "signup", 1).when(e == "purchase", 2).otherwise(3)).withColumn("t", seconds("ts"))


@query(f"WITH x AS (SELECT {_CLASS} AS k FROM events) SELECT 'total' AS kind, count(*) AS n FROM x UNION ALL SELECT 'benign', count(*) FILTER (k = 0) FROM x UNION ALL SELECT 'malicious', count(*) FILTER (k <> 0) FROM x UNION ALL SELECT 'class_' || k, count(*) FROM x GROUP BY k")
def detection_summary(spark, sf):
    return metrics.detection_summary(_classed(spark, sf), "label")


@query(f"SELECT CAST(floor(event_id / 100) AS BIGINT) AS segment, count(*) FILTER ({_CLASS} = 0) AS benign, count(*) FILTER ({_CLASS} <> 0) AS malicious FROM events GROUP BY 1")
def trend_rows(spark, sf):
    return metrics.row_segments(_classed(spark, sf), "event_id", "label")


@query(
    f"""WITH x AS (SELECT epoch_us(ts) / 1e6 AS t, {_CLASS} AS k FROM events), e AS (SELECT min(t) AS lo, max(t) AS hi FROM x)
SELECT CAST(least(floor((t - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (k <> 0) AS malicious FROM x, e WHERE t < hi GROUP BY 1"""
)
def trend_time(spark, sf):
    return metrics.time_bins(_classed(spark, sf), "t", "label")


@query("WITH m AS (SELECT greatest(max(value), 1.0) AS m FROM events) SELECT CAST(least(9, floor(value / m * 10)) AS BIGINT) AS bin, count(*) AS n FROM events, m WHERE value IS NOT NULL GROUP BY 1")
def histogram10(spark, sf):
    return metrics.histogram(table(spark, sf, "events"), "value")


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang")
def value_counts(spark, sf):
    return metrics.value_counts(table(spark, sf, "documents"), "lang")


def _ranked(t, i, by):
    return f"r AS (SELECT {i}, {by}, row_number() OVER (PARTITION BY {by} ORDER BY md5('42:' || {i}), {i}) - 1 AS k, count(*) OVER (PARTITION BY {by}) AS n FROM {t})"


@query(
    f"""WITH {_ranked("labels", "doc_id", "quality")}, q AS (SELECT *, floor(n * 0.2 + 0.5) AS a FROM r)
SELECT doc_id, quality, CASE WHEN k < a THEN 'test' WHEN k < a + floor((n - a) * 0.125 + 0.5) THEN 'val' ELSE 'train' END AS subset FROM q"""
)
def stratified_split(spark, sf):
    return splits.stratified_split(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query(f"WITH {_ranked('documents', 'doc_id', 'lang')} SELECT doc_id, lang, CASE WHEN k < floor(n * 0.67) THEN 'pretrain' ELSE 'supervised' END AS subset FROM r")
def ratio_split(spark, sf):
    return splits.ratio_split(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", ["lang"])


@query(
    """WITH r AS (SELECT user_id, row_number() OVER (ORDER BY md5('42:' || user_id), user_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)),
q AS (SELECT *, CASE WHEN n < 200 THEN floor(n * 120 / 200) ELSE 120 END AS a, CASE WHEN n < 200 THEN n - floor(n * 120 / 200) ELSE 80 END AS b FROM r)
SELECT user_id, CASE WHEN k < a THEN 'train' ELSE 'test' END AS subset FROM q WHERE k < a + b"""
)
def quota_sample(spark, sf):
    return splits.quota_sample(table(spark, sf, "events").select("user_id").distinct(), "user_id", 120, 80)


@query(
    """WITH l AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM l GROUP BY i)
SELECT vec_id, CAST(i - 1 AS INT) AS dim, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1.0 END + 1e-9, 4) AS value FROM l JOIN m USING (i)"""
)
def standardize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    # engines sum in different orders; the nudge keeps values that end in 5 from rounding apart
    return vectors.standardize(e, "v").select("vec_id", F.posexplode("scaled").alias("dim", "x")).select("vec_id", "dim", F.round(F.col("x") + 1e-9, 4).alias("value"))


@query()
def pca2(spark, sf):
    e, _ = vectors.pca(table(spark, sf, "embeddings"), "embedding", 2)
    return e.select("vec_id", "label", F.round(F.get("reduced", 0), 6).alias("x"), F.round(F.get("reduced", 1), 6).alias("y"))


@query(
    """WITH l AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m FROM l GROUP BY i)
SELECT vec_id, round(sum((x - m) * (x - m)) + 1e-9, 5) AS squared FROM l JOIN m USING (i) GROUP BY vec_id"""
)
def pca_norms(spark, sf):
    """What no rotation changes: with all axes kept, a row's squared length is that of the centred vector."""
    e, _ = vectors.pca(table(spark, sf, "embeddings"), "embedding", 64)
    return e.select("vec_id", F.round(F.aggregate("reduced", F.lit(0.0), lambda t, x: t + x * x) + 1e-9, 5).alias("squared"))


@query(
    """WITH q AS (SELECT vec_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id, list_distance(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS d FROM q, embeddings e WHERE q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INT) AS rank, neighbour_id, round(d, 4) AS distance FROM r WHERE rank <= 5"""
)
def knn(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.knn(e.where(F.col("vec_id") % 20 == 0), e, "embedding", "vec_id", 5)


@query(
    """WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS d FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INT) AS rank, neighbour_id, round(d, 4) AS distance FROM r WHERE rank <= 5"""
)
def knn_all(spark, sf):
    """Neighbours of every row, through the same cells."""
    e = table(spark, sf, "embeddings")
    return vectors.knn(e, e, "embedding", "vec_id", 5)


def _wide(spark, sf):
    """Embeddings with a column per component."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"feat_{i}") for i in range(64)])


@query(None)
def boosted_labels(spark, sf):
    """Labels of the held-out vectors by boosted trees that stop early."""
    d = _wide(spark, sf)
    got = detect.train_boosted(d, "vec_id", "label", [f"feat_{i}" for i in range(64)], classes=10, rounds=4, depth=3, bins=16, rate=0.3, least=5, patience=2)
    return got["predictions"].select("vec_id", "true_label", "pred_label", F.round("confidence", 6).alias("confidence"))


@query(None)
def reduced_labels(spark, sf):
    """The same after the contrastive autoencoder has reduced the 64 components to 8."""
    small = {"latent_dim": 8, "hidden_dims": [32], "proj_dim": 8, "batch_size": 128, "epochs": 3, "learning_rate": 0.01, "seed": 7}
    got = detect.train_boosted(_wide(spark, sf), "vec_id", "label", [], [f"feat_{i}" for i in range(64)], classes=10, reducer=small, rounds=4, depth=3, bins=16, rate=0.3, least=5, patience=2)
    return got["predictions"].select("vec_id", "true_label", "pred_label", F.round("confidence", 6).alias("confidence"))


_SUPCON = """WITH u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
s AS (SELECT a.vec_id AS a, a.label = b.label AS same, list_dot_product(a.v, b.v) / 0.1 AS s FROM u a, u b WHERE a.vec_id <> b.vec_id),
z AS (SELECT a, ln(sum(exp(s))) AS z FROM s GROUP BY a), l AS (SELECT s.a, -avg(s.s - z.z) AS l FROM s JOIN z ON s.a = z.a WHERE same GROUP BY s.a)
SELECT round(avg(l), 6) AS loss, count(*) AS anchors FROM l"""


@query(_SUPCON)
def supcon_loss(spark, sf):
    return vectors.contrastive_loss(table(spark, sf, "embeddings"), "embedding", "label", "vec_id")


@query(_SUPCON)
def supcon_loss_table(spark, sf):
    return supcon_loss(spark, sf)


@query(_SUPCON.split("SELECT round(avg(l), 6)")[0].replace("l AS (SELECT s.a,", "c AS (SELECT label, 1 / count(*) AS w FROM embeddings GROUP BY label), l AS (SELECT s.a,") + "SELECT round(sum(l * w) / sum(w), 6) AS loss, count(*) AS anchors FROM l JOIN u ON l.a = u.vec_id JOIN c ON u.label = c.label")
def supcon_loss_weighted(spark, sf):
    """The loss with anchors weighted by the inverse of their label's rows."""
    return vectors.contrastive_loss(table(spark, sf, "embeddings"), "embedding", "label", "vec_id", class_weighted=True)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").offset(100).limit(50)


@query("SELECT p_brand, round(avg(p_retailprice), 4) AS score, count(*) AS n FROM part GROUP BY p_brand ORDER BY score DESC, p_brand LIMIT 5")
def top_models(spark, sf):
    g = table(spark, sf, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("score"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("score"), "p_brand").limit(5)


@query("SELECT r_regionkey AS key, r_name AS name, NULL::INT AS parent FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def union_all(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    return files.union_all([r, n])


@query("SELECT o_orderstatus, metric, round(value, 4) AS value FROM (SELECT o_orderstatus, avg(o_totalprice) AS mean_price, min(o_totalprice) AS least_price, CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY 1) UNPIVOT (value FOR metric IN (mean_price, least_price, orders))")
def unpivot_metrics(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("mean_price"), F.min("o_totalprice").alias("least_price"), F.count(F.lit(1)).cast("double").alias("orders"))
    return features.melt(g, ["o_orderstatus"], ["mean_price", "least_price", "orders"]).withColumn("value", F.round("value", 4))


@query("SELECT vec_id, label, CASE label WHEN 0 THEN 'benign' WHEN 1 THEN 'adware' WHEN 2 THEN 'dns2tcp' WHEN 3 THEN 'dnscat2' WHEN 4 THEN 'iodine' WHEN 5 THEN 'ransomware' WHEN 6 THEN 'scareware' WHEN 7 THEN 'smsmalware' END AS label_name, CASE WHEN label < 8 THEN CAST(label AS INT) END AS back FROM embeddings")
def label_names(spark, sf):
    e = files.label_join(table(spark, sf, "embeddings").select("vec_id", "label"))
    return e.withColumn("back", scalar.label_id(F.upper("label_name")))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS pred, CAST(list_max(embedding) AS DOUBLE) AS confidence FROM embeddings")
def argmax_class(spark, sf):
    k, top = metrics.argmax("embedding")
    return table(spark, sf, "embeddings").select("vec_id", k.alias("pred"), top.cast("double").alias("confidence"))


@query(f"SELECT event_id, {_CLASS} AS pred_label, value / 200 AS confidence FROM events WHERE {_CLASS} <> 0 AND value / 200 >= 0.8")
def high_confidence(spark, sf):
    return metrics.high_confidence_malicious(_classed(spark, sf).select("event_id", F.col("label").alias("pred_label"), (F.col("value") / 200).alias("confidence")))


@query("SELECT o_orderkey, CAST(o_orderkey * 104729 % 4294967296 AS BIGINT) AS n, CAST(o_orderkey * 104729 % 4294967296 AS BIGINT) AS again, ((n >> 24) & 255) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) AS ip, ((n & 255) << 24) | (((n >> 8) & 255) << 16) | (((n >> 16) & 255) << 8) | ((n >> 24) & 255) AS swapped FROM orders")
def ip_forms(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 104729 % (1 << 32)).alias("n"))
    o = o.withColumn("ip", scalar.long_to_ip(F.col("n")))
    return o.withColumn("again", scalar.ip_to_long(F.col("ip"))).withColumn("swapped", scalar.swap_bytes(F.col("n")))


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + 14400 AS day_first, CAST(epoch(o_orderdate) AS BIGINT) - 28800 AS year_first, 0::BIGINT AS bad FROM orders")
def date_forms(spark, sf):
    o = table(spark, sf, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    day, year = F.date_format("t", "d/M/yyyy h:mm:ss a"), F.date_format("t", "yyyy-MM-dd HH:mm:ss")
    return o.select("o_orderkey", scalar.parse_epoch(day, scalar.DAY_FIRST, -4).alias("day_first"), scalar.parse_epoch(year, scalar.YEAR_FIRST, 8).alias("year_first"), scalar.parse_epoch(F.lit("n/a"), scalar.DAY_FIRST).alias("bad"))


@query("SELECT event_id, CASE WHEN value / 5 >= 85 THEN 'critical' WHEN value / 5 >= 60 THEN 'high' WHEN value / 5 >= 30 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN event_id > 0 THEN 3.0 / event_id END AS progress FROM events")
def risk_levels(spark, sf):
    return table(spark, sf, "events").select("event_id", scalar.risk_level(F.col("value") / 5).alias("risk"), scalar.progress_ratio(F.concat(F.lit("step 3/"), F.col("event_id"))).alias("progress"))


@query(
    """WITH l AS (SELECT o_orderkey AS uid, list_transform([1, 2, 3], lambda i: 'k' || ((o_orderkey * i) % 40)) AS chain FROM orders), k AS (SELECT uid, unnest(chain) AS fp, generate_subscripts(chain, 1) AS pos FROM l),
n AS (SELECT 'k' || n_nationkey AS fp, n_name AS subject FROM nation)
SELECT k.uid, coalesce(string_agg(n.subject, ',' ORDER BY pos), '') AS subjects, count(*) AS cert_chain_depth FROM k LEFT JOIN n USING (fp) GROUP BY k.uid"""
)
def cert_lookup(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), F.concat_ws(",", *[F.concat(F.lit("k"), F.col("o_orderkey") * i % 40) for i in (1, 2, 3)]).alias("cert_chain_fps"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("k"), "n_nationkey").alias("fp"), F.col("n_name").alias("subject"), F.col("n_nationkey").alias("pkt_no"))
    c = joins.certificate_chain(o, n)
    return c.select("uid", F.concat_ws(",", F.transform("certs", lambda x: x["subject"])).alias("subjects"), "cert_chain_depth")


@query("SELECT c_custkey, CAST(c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS INT) AS in_train, CAST(c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS INT) AS in_test FROM customer")
def membership(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return joins.member_flags(table(spark, sf, "customer").select("c_custkey"), {"in_train": o.where("o_orderstatus = 'F'"), "in_test": o.where("o_orderstatus = 'O'")}, "c_custkey")


@query("SELECT DISTINCT user_id AS src, event_type AS dst FROM events")
def distinct_keys(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst")).distinct()


@query("SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_extendedprice AS price FROM lineitem WHERE l_orderkey = 7 ORDER BY l_linenumber LIMIT 1")
def point_lookup(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return files.find_row(x.orderBy("l_linenumber"), "l_orderkey", 7)


@query("SELECT s_suppkey, s_acctbal AS bal, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier")
def numeric_map(spark, sf):
    x = features.numeric_map(table(spark, sf, "supplier"), ["s_acctbal", "s_nationkey"])
    return x.select("s_suppkey", F.col("num_features")["s_acctbal"].alias("bal"), F.col("num_features")["s_nationkey"].alias("nation"))


@query("SELECT n_nationkey, 'a_1_b_2_tcp_' || n_nationkey AS made, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'a_1_b_2_tcp_' || n_nationkey END AS uid FROM nation")
def flow_uids(spark, sf):
    given = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("-")
    ends = [F.lit("a"), F.lit(1), F.lit("b"), F.lit(2), F.lit("TCP"), F.col("n_nationkey")]
    return table(spark, sf, "nation").select("n_nationkey", scalar.canonical_uid(F.lit(None).cast("string"), *ends).alias("made"), scalar.canonical_uid(given, *ends).alias("uid"))


@query("SELECT user_id, list_filter(list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]), lambda x: x >= 0) AS steps FROM (SELECT user_id, list(event_id ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)")
def array_steps(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"]).alias("v"))
    return g.select("user_id", scalar.array_steps(F.col("v")).alias("steps"))


from . import capture_queries, source_queries  # noqa: E402, F401  they register themselves
