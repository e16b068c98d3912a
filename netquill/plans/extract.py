"""Captures to flow tables: the 94-column feature record, the 48-column temporal record, and the text form.

Everything between the capture reader and the tables is one declarative plan.
Packets are shuffled by flow once; flow rows, far fewer, are then joined with
their window features and certificates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import flows, windows
from ..schemas import CONN_FIELDS, FLOW_COLUMNS, NUMERIC_FEATURES, SSL_FIELDS, X509_FIELDS
from ..sources import pcap

KEYS = ["file", "fwd_ip", "fwd_port", "bwd_ip", "bwd_port", "protocol"]
DAY = 86400.0


def time_text(ts):
    """Seconds as text with up to six decimals, at least one."""
    return F.regexp_replace(F.regexp_replace(ts.cast("decimal(20,6)").cast("string"), "0+$", ""), r"\.$", ".0")


def flow_packets(packets: DataFrame) -> DataFrame:
    """Decoded packets with their flow's ends and their direction; flags as 0/1."""
    p = flows.five_tuple_flows(pcap.decode(packets), within=["file"])
    return p.withColumns({f: F.col(f).cast("int") for f in flows.FLAGS})


def flow_chains(p: DataFrame) -> DataFrame:
    """Per flow the certificate names of its last packet that holds any."""
    names = pcap.tls_packets(p).select(*KEYS, "pkt_no", pcap.common_names("payload").alias("names")).where(F.size("names") > 0)
    return names.groupBy(*KEYS).agg(F.max_by("names", "pkt_no").alias("names"))


def _json(**fields):
    return F.to_json(F.struct(*[F.coalesce(v.cast("string"), F.lit("-")).alias(k.replace("__", ".")) for k, v in fields.items()]))


def feature_table(packets: DataFrame) -> DataFrame:
    """One row per flow with the identity, numeric and log columns; ``dataset_source`` and ``subfolder`` come from the path."""
    p = flow_packets(packets)
    g = flows.flow_statistics(p, KEYS)
    gaps = flows.flow_gaps(p, KEYS)
    idle = flows.active_idle(p, KEYS, order="pkt_no", keep_last=False)
    chains = flow_chains(p)
    _, certs = pcap.certificates(p)
    first = certs.select("file", F.col("fp").alias("_fp"), "not_before", "not_after")
    d = g.join(gaps, KEYS).join(idle, KEYS).join(chains, KEYS, "left")
    cn = F.get("names", 0)
    d = d.withColumns({"_cn": cn, "_fps": F.transform("names", lambda n: F.sha2(n.cast("binary"), 256)), "_lead": F.sha2(cn.cast("binary"), 256)})
    d = d.join(first.withColumnRenamed("file", "_file"), (F.col("file") == F.col("_file")) & (F.col("_lead") == F.col("_fp")), "left").drop("_file", "_fp")
    d = d.withColumn("_duration", F.col("ts_end") - F.col("ts_start"))
    d = d.withColumn("flow_uid", F.concat_ws("_", "fwd_ip", F.col("fwd_port").cast("string"), "bwd_ip", F.col("bwd_port").cast("string"), time_text(F.col("ts_start"))))
    w = windows.all_window_features(d.select("file", F.struct(*KEYS[1:]).alias("conn_id"), F.col("ts_start").alias("ts"), F.col("fwd_ip").alias("src"), F.col("bwd_ip").alias("dst"), F.col("bwd_port").alias("dport"), F.col("_duration").alias("duration"), F.col("conn_state").alias("state")))
    w = w.drop("ts", "src", "dst", "dport", "duration", "state").select("*", *[F.col(f"conn_id.{k}").alias(k) for k in KEYS[1:]]).drop("conn_id")
    d = d.join(w, KEYS)
    header = F.when(F.col("protocol") == "tcp", 40).otherwise(28)
    has = F.col("_cn").isNotNull()
    text = F.coalesce("_cn", F.lit(""))
    d = d.withColumns(scalar.char_ratios(text))
    none = F.lit(-1.0)
    d = d.withColumns(
        {
            "src_ip": F.col("fwd_ip"),
            "src_port": F.col("fwd_port"),
            "dst_ip": F.col("bwd_ip"),
            "dst_port": F.col("bwd_port"),
            "timestamp": F.col("ts_start"),
            "dataset_source": F.element_at(F.split("file", "/"), -3),
            "subfolder": F.element_at(F.split("file", "/"), -2),
            "pcap_filename": F.element_at(F.split("file", "/"), -1),
            "label": pcap.label_of_path(F.col("file")),
            "pkt_len_var": F.round(F.col("pkt_len_std") * F.col("pkt_len_std"), 4),
            "fwd_header_len": F.col("pkts_forward") * header,
            "bwd_header_len": F.col("pkts_backward") * header,
            "avg_fwd_segment_size": F.round("pkt_len_fwd_mean", 2),
            "avg_bwd_segment_size": F.round("pkt_len_bwd_mean", 2),
            "subflow_fwd_pkts": F.col("pkts_forward"),
            "subflow_fwd_bytes": F.col("bytes_forward"),
            "subflow_bwd_pkts": F.col("pkts_backward"),
            "subflow_bwd_bytes": F.col("bytes_backward"),
            "handshake_duration": F.col("_duration"),
            "cn_length": F.length(text),
            "cn_hash": F.when(has, scalar.name_hash(text)).otherwise(0),
            "cert_valid_days": F.when(has, scalar.days_between(F.col("not_after"), F.col("not_before"))).otherwise(none),
            "cert_age_at_capture": F.when(has, scalar.days_between(F.col("ts_start"), F.col("not_before"))).otherwise(none),
            "cert_remaining_days": F.when(has, scalar.days_between(F.col("not_after"), F.col("ts_start"))).otherwise(none),
            "cert_chain_depth": F.when(has, F.size("names")).otherwise(0),
        }
    )
    return d.withColumns({c: F.round(c, 2) for c in ("pkt_len_mean", "pkt_len_std", "pkt_len_fwd_mean", "pkt_len_fwd_std", "pkt_len_bwd_mean", "pkt_len_bwd_std")}).withColumns(_logs(d)).select(*FLOW_COLUMNS)


def _logs(d: DataFrame) -> dict:
    """The connection, TLS and certificate records as JSON; ``-`` without a certificate."""
    c, dash = F.col, F.lit("-")
    has = c("_cn").isNotNull()
    tls = lambda v: F.when(has, v).otherwise("-")
    six = lambda v: F.format_string("%.6f", v)
    ends = {"ts": six(c("ts_start")), "uid": c("flow_uid"), "id__orig_h": c("fwd_ip"), "id__orig_p": c("fwd_port"), "id__resp_h": c("bwd_ip"), "id__resp_p": c("bwd_port")}
    whole = lambda v: v.cast("long")
    conn = _json(
        **ends, proto=c("protocol"), service=F.when((c("fwd_port") == 443) | (c("bwd_port") == 443), "ssl").otherwise("-"), duration=F.format_string("%.4f", c("_duration")), orig_bytes=whole(c("bytes_forward")), resp_bytes=whole(c("bytes_backward")),
        conn_state=c("conn_state"), local_orig=dash, local_resp=dash, missed_bytes=F.lit(0), history=F.when(c("conn_state") == "SF", "ShADfFa").otherwise("S"),
        orig_pkts=c("pkts_forward"), orig_ip_bytes=whole(c("bytes_forward") + c("pkts_forward") * 40), resp_pkts=c("pkts_backward"), resp_ip_bytes=whole(c("bytes_backward") + c("pkts_backward") * 40), tunnel_parents=dash,
    )
    ssl = _json(
        **ends, version=tls(F.lit("TLSv1.2")), cipher=tls(F.lit("TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256")), curve=dash, server_name=tls(c("_cn")), resumed=F.lit("F"), last_alert=dash, next_protocol=dash, established=F.when(has, "T").otherwise("F"),
        cert_chain_fps=tls(F.concat_ws(",", "_fps")), client_cert_chain_fps=dash, subject=tls(F.concat(F.lit("CN="), c("_cn"))), issuer=tls(F.concat(F.lit("CN="), c("_cn"), F.lit(" CA"))), client_subject=dash, client_issuer=dash, validation_status=dash,
    )
    fixed = {"certificate.version": "3", "certificate.key_alg": "rsa", "certificate.sig_alg": "sha256WithRSAEncryption", "certificate.key_type": "rsa", "certificate.key_length": "2048", "certificate.exponent": "-", "certificate.curve": "-", "san.dns": "-", "san.uri": "-", "san.email": "-", "san.ip": "-", "basic_constraints.ca": "F", "basic_constraints.path_len": "-1"}
    cert = lambda n: F.struct(
        F.sha2(n.cast("binary"), 256).alias("id"),
        F.conv(F.substring(F.sha2(n.cast("binary"), 256), 1, 15), 16, 10).alias("certificate.serial"),
        F.concat(F.lit("CN="), n).alias("certificate.subject"),
        F.concat(F.lit("CN="), n, F.lit(" CA")).alias("certificate.issuer"),
        six(c("not_before")).alias("certificate.not_valid_before"),
        six(c("not_after")).alias("certificate.not_valid_after"),
        *[F.lit(v).alias(k) for k, v in fixed.items()],
    )
    return {"zeek_conn_log": conn, "zeek_ssl_log": ssl, "zeek_x509_log": F.when(has, F.to_json(F.transform("names", cert))).otherwise("-")}


def temporal_table(packets: DataFrame) -> DataFrame:
    """One row per flow with its packet arrays and the statistics over time order."""
    p = flow_packets(packets)
    g = flows.temporal_state(flows.flow_statistics(p, KEYS))
    by_time = p.withColumn("pkt_no", F.struct("ts", "pkt_no"))
    gaps = flows.flow_gaps(by_time, KEYS).select(*KEYS, "iat_max", "iat_min", "iat_mean", "iat_std")
    out = g.join(gaps, KEYS).join(flows.active_idle(p, KEYS), KEYS).join(flows.packet_arrays(p, KEYS), KEYS)
    header = F.when(F.col("protocol") == "tcp", 40).otherwise(28)
    c = F.col
    pick = {
        "flow_uid": F.concat_ws("_", "fwd_ip", c("fwd_port").cast("string"), "bwd_ip", c("bwd_port").cast("string"), time_text(c("ts_start"))),
        "src_ip": c("fwd_ip"), "src_port": c("fwd_port"), "dst_ip": c("bwd_ip"), "dst_port": c("bwd_port"), "protocol": c("protocol"),
        "start_time": c("ts_start"), "end_time": c("ts_end"), "duration": F.round(F.greatest(c("ts_end") - c("ts_start"), F.lit(flows.LEAST_DURATION)), 6),
        "pcap_filename": F.element_at(F.split("file", "/"), -1), "label": pcap.label_of_path(c("file")),
        "total_packets": c("pkts_total"), "total_bytes": c("bytes_total"), "flow_bytes_s": c("flow_bytes_s"), "flow_pkts_s": c("flow_pkts_s"),
        "fwd_packets": c("pkts_forward"), "bwd_packets": c("pkts_backward"), "fwd_bytes": c("bytes_forward"), "bwd_bytes": c("bytes_backward"),
        "ratio_bytes_bwd_fwd": c("ratio_bytes_back_to_forward"), "average_packet_size": F.round("pkt_len_mean", 2), "pkt_len_std": c("pkt_len_std"), "pkt_len_var": c("pkt_len_var"),
        "fwd_header_len": c("pkts_forward") * header, "bwd_header_len": c("pkts_backward") * header, "avg_fwd_segment_size": F.round("pkt_len_fwd_mean", 2), "avg_bwd_segment_size": F.round("pkt_len_bwd_mean", 2),
        **{f"{a}_{b}": c(f"{a}_{b}") for a in ("iat", "active", "idle") for b in ("max", "min", "mean", "std")},
        "conn_state": F.when(c("protocol") == "udp", "SF").otherwise(c("temporal_state")),
        **{f"{k}_count": c(f"flag_{k}_count") for k in flows.FLAGS},
        "packet_time_offsets": c("packet_time_offsets"), "packet_directions": c("packet_directions"), "packet_lengths": c("packet_lengths"),
    }
    return out.select(*[v.alias(k) for k, v in pick.items()])


def _compact(cell, fields: dict[str, str], event: str):
    m = F.from_json(cell, "map<string,string>", {"allowSingleQuotes": "true"})
    return F.when(m.isNotNull(), _short(m, fields, event))


def _short(m, fields: dict[str, str], event: str):
    return F.to_json(F.struct(F.struct(*[scalar.clean_value(F.element_at(m, k)).alias(v) for k, v in fields.items()]).alias(event)))


def flow_text(df: DataFrame) -> DataFrame:
    """Adds ``text``, the three logs in short form, and ``num_events``, the number of records in it.

    Logs may be JSON or Python literals; what is neither gives no record.
    """
    x509 = F.coalesce(F.from_json("zeek_x509_log", "array<map<string,string>>", {"allowSingleQuotes": "true"}), F.array().cast("array<map<string,string>>"))
    parts = F.concat(F.array_compact(F.array(_compact(F.col("zeek_conn_log"), CONN_FIELDS, "c"), _compact(F.col("zeek_ssl_log"), SSL_FIELDS, "s"))), F.transform(F.filter(x509, lambda m: m.isNotNull()), lambda m: _short(m, X509_FIELDS, "x")))
    return df.withColumn("_parts", parts).withColumns({"text": F.concat_ws(" ", "_parts"), "num_events": F.size("_parts")}).drop("_parts")


def flow_jsonl(df: DataFrame) -> DataFrame:
    """The labelled text rows made of a feature table: uid, ends, text, label, numbers."""
    t = flow_text(df)
    uid = scalar.canonical_uid(F.col("flow_uid"), *[F.col(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "timestamp")])
    label = scalar.label_id(scalar.clean_value(F.col("label")))
    numbers = F.create_map(*[x for c in NUMERIC_FEATURES for x in (F.lit(c), scalar.safe_number(F.col(c)))])
    return t.select(uid.alias("flow_uid"), "src_ip", "dst_ip", "text", label.alias("label"), scalar.label_name(label).alias("label_name"), "num_events", numbers.alias("num_features"))


def tls_details(df: DataFrame) -> DataFrame:
    """TLS fields of the logs: server name, version, cipher, certificate parties and dates; absent or empty ones null.

    Logs may be wrapped in a one-key object and may be lists; their first record counts.
    """
    inner = "map<string,string>"

    def record(col):
        plain = F.from_json(col, inner, {"allowSingleQuotes": "true"})
        listed = F.get(F.from_json(col, f"array<{inner}>", {"allowSingleQuotes": "true"}), 0)
        wrapped = F.from_json(F.element_at(F.map_values(plain), 1), inner, {"allowSingleQuotes": "true"})
        return F.coalesce(F.when(F.size(plain) == 1, wrapped), plain, listed)

    def pick(rec, *names):
        return F.coalesce(*[F.nullif(F.element_at(rec, n), F.lit("")) for n in names])

    s, x = record(F.col("zeek_ssl_log")), record(F.col("zeek_x509_log"))
    both = lambda n: (f"certificate_{n}", f"certificate.{n}")
    return df.withColumns(
        {
            "sni": pick(s, "server_name"), "tls_version": pick(s, "version"), "cipher_suite": pick(s, "cipher"), "alpn": pick(s, "alpn"),
            "cert_issuer": pick(x, *both("issuer")), "cert_subject": pick(x, *both("subject")), "cert_valid_from": pick(x, *both("not_valid_before")), "cert_valid_to": pick(x, *both("not_valid_after")),
        }
    )
