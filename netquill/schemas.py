"""Schemas, labels and fixed column lists of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Class labels, their order is their id.
CLASS_LABELS = ["benign", "adware", "dns2tcp", "dnscat2", "iodine", "ransomware", "scareware", "smsmalware"]
LABEL2ID = {name: i for i, name in enumerate(CLASS_LABELS)}

# The numeric flow features, in file order.
NUMERIC_FEATURES = """
pkts_forward pkts_backward pkts_total bytes_forward bytes_backward bytes_total ratio_bytes_back_to_forward
pkt_len_max pkt_len_min pkt_len_mean pkt_len_std pkt_len_var
pkt_len_fwd_mean pkt_len_fwd_std pkt_len_bwd_mean pkt_len_bwd_std
flow_bytes_s flow_pkts_s fwd_pkts_s bwd_pkts_s fwd_header_len bwd_header_len down_up_ratio
avg_fwd_segment_size avg_bwd_segment_size
iat_max iat_min iat_mean iat_std iat_fwd_max iat_fwd_min iat_fwd_mean iat_fwd_std
iat_bwd_max iat_bwd_min iat_bwd_mean iat_bwd_std
flag_syn_count flag_fin_count flag_rst_count flag_psh_count flag_ack_count
subflow_fwd_pkts subflow_fwd_bytes subflow_bwd_pkts subflow_bwd_bytes
active_max active_min active_mean active_std idle_max idle_min idle_mean idle_std
rst_ratio handshake_fail_rate reconnect_count conn_count flow_interval_jitter flow_interval_diff_mean
tcp_rst_count reconnection_flag unique_dst_count src_ip_abnormal_ratio duration_p25 duration_p50 duration_p75
weighted_conn_count weighted_avg_duration abnormal_to_conn_ratio
handshake_duration cn_vowel_ratio cn_digit_density cn_special_char_density cn_length cn_hash
cert_valid_days cert_age_at_capture cert_remaining_days cert_chain_depth
""".split()

# Identity columns before, log columns after the numeric ones.
IDENTITY_COLUMNS = "flow_uid src_ip src_port dst_ip dst_port protocol timestamp dataset_source subfolder pcap_filename label".split()
LOG_COLUMNS = ["zeek_conn_log", "zeek_ssl_log", "zeek_x509_log"]
FLOW_COLUMNS = [*IDENTITY_COLUMNS, *NUMERIC_FEATURES, *LOG_COLUMNS]

# Columns that would leak the answer into a model.
LEAKAGE_COLUMNS = "flow_uid flow_id src_ip src_port dst_ip dst_port protocol timestamp dataset_source subfolder pcap_filename zeek_conn_log zeek_ssl_log zeek_x509_log label_name".split()

# Connection states by kind.
RESET_STATES = ["REJ", "RSTO", "RSTR", "RSTRH"]
HANDSHAKE_FAILURE_STATES = ["S0", "S1", "S2", "S3"]
ABNORMAL_STATES = RESET_STATES + HANDSHAKE_FAILURE_STATES

# Log fields kept in a flow's text and their short names.
CONN_FIELDS = {"proto": "proto", "service": "svc", "duration": "dur", "orig_bytes": "orig_bytes", "resp_bytes": "resp_bytes", "conn_state": "state", "missed_bytes": "missed", "history": "hist", "orig_pkts": "orig_pkts", "resp_pkts": "resp_pkts"}
SSL_FIELDS = {"version": "ver", "cipher": "cipher", "curve": "curve", "server_name": "sni", "resumed": "resumed", "last_alert": "alert", "next_protocol": "next", "established": "est", "subject": "subj", "issuer": "issuer", "validation_status": "validation"}
X509_FIELDS = {"certificate.version": "ver", "certificate.subject": "subj", "certificate.issuer": "issuer", "certificate.not_valid_before": "not_bef", "certificate.not_valid_after": "not_aft", "certificate.key_alg": "key_alg", "certificate.sig_alg": "sig", "certificate.key_type": "key_type", "certificate.key_length": "key_len", "certificate.curve": "curve", "san.dns": "san_dns", "basic_constraints.ca": "ca"}

PACKET = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("pkt_no", T.LongType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("linktype", T.IntegerType()),
        T.StructField("raw", T.BinaryType()),
    ]
)

FLOW_JSONL = T.StructType(
    [
        T.StructField("flow_uid", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("label_name", T.StringType()),
        T.StructField("num_events", T.IntegerType()),
        T.StructField("num_features", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def require_columns(df: DataFrame, columns) -> DataFrame:
    """``df`` itself, or an error naming every missing column."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def prefixed_columns(df: DataFrame, prefix: str = "feat_") -> list[str]:
    """Columns ``prefix<number>`` by number; an error if there are none."""
    found = [c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    if not found:
        raise ValueError(f"no columns named {prefix}<number>")
    return sorted(found, key=lambda c: int(c[len(prefix) :]))


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    kinds = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in set(exclude)]


def feature_groups(df: DataFrame, label: str = "label") -> dict[str, list[str]]:
    """Column lists of the ablation groups: all features, semantic ones only, manual ones only."""
    semantic = [c for c in df.columns if c.startswith("feat_")]
    every = numeric_columns(df, exclude=[label, *LEAKAGE_COLUMNS])
    return {"Fused": every, "LLM-only": semantic, "Manual-only": [c for c in every if c not in set(semantic)]}


def id_column(df: DataFrame, candidates=("flow_uid", "flow_id")) -> str:
    """The first candidate that is a column; an error without one."""
    found = [c for c in candidates if c in df.columns]
    if not found:
        raise ValueError(f"none of {list(candidates)} is a column")
    return found[0]
