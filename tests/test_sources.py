import struct

import pytest
from pyspark.sql import functions as F

from netquill import schemas
from netquill.operators import flows
from netquill.sources import files, pcap


def frame(src, dst, sport, dport, flags=0x10, payload=b"", proto=6, link=14):
    if proto == 6:
        body = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 0, 0, 0) + payload
    else:
        body = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    ip = struct.pack(">BBHHHBBH4B4B", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, *src, *dst)
    return b"\0" * link + ip + body


A, B = (10, 0, 0, 1), (192, 168, 0, 9)
CERT = b"xx\x06\x03\x55\x04\x03\x0c\x0fwww.example.com\x06\x03\x55\x04\x03\x13\x07a.b.org\x00"
ROWS = [(1.5, frame(A, B, 5000, 443, 0x02)), (1.75, frame(B, A, 443, 5000, 0x12, CERT)), (2.0, frame(A, B, 5000, 53, proto=17, payload=b"q")), (2.5, b"junk" * 20), (9.0, frame(A, B, 5000, 443, 0x11))]


def pcapng(rows, order="<"):
    block = lambda kind, body: struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)
    out = struct.pack("<I", 0x0A0D0D0A)[:0] + block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    for ts, raw in rows:
        t = round(ts * 1e6)
        pad = b"\0" * (-len(raw) % 4)
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(raw), len(raw)) + raw + pad)
    return out + block(3, struct.pack("<I", 4) + b"abcd")


@pytest.fixture()
def captures(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "iodine_x_train.pcap").write_bytes(pcap.capture_bytes(ROWS))
    (tmp_path / "plain_test.pcapng").write_bytes(pcapng(ROWS))
    (tmp_path / "broken_test.pcap").write_bytes(pcap.capture_bytes(ROWS)[:150])
    (tmp_path / "notes_test.pcap").write_bytes(b"not a capture" * 10)
    return str(tmp_path)


def test_reading(spark, captures):
    df = pcap.read_split_captures(spark, captures)
    got = {(r.pcap_filename, r.label, r.subset): r.n for r in df.groupBy("pcap_filename", "label", "subset").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("iodine_x_train.pcap", "iodine", "train"): 5, ("plain_test.pcapng", "benign", "test"): 6, ("broken_test.pcap", "benign", "test"): 1}
    assert [r.ts for r in df.where("label = 'iodine'").orderBy("pkt_no").collect()] == [1.5, 1.75, 2.0, 2.5, 9.0]
    assert df.where("pcap_filename like 'plain%' and ts is null").count() == 1


def test_big_endian_and_limits():
    le = pcap.capture_bytes(ROWS)
    be = struct.pack(">IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 113) + b"".join(struct.pack(">IIII", int(t), 0, len(r), len(r)) + r for t, r in ROWS)
    assert [p[2] for p in pcap.packets(be)] == [113] * 5
    assert len(list(pcap.packets(le, limit=2))) == 2
    assert list(pcap.packets(b"")) == [] and list(pcap.packets(le[:24] + struct.pack("<IIII", 0, 0, 0, 0))) == []


def test_decoding(spark, captures):
    d = pcap.decode(pcap.read_packets(spark, captures, "*_train.pcap")).orderBy("pkt_no").collect()
    assert [(r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.protocol) for r in d[:1]] == [("10.0.0.1", 5000, "192.168.0.9", 443, "tcp")]
    assert [(r.syn, r.ack, r.fin) for r in d] == [(True, False, False), (True, True, False), (False, False, False), (False, True, True)]
    assert [bytes(r.payload) for r in d] == [b"", CERT, b"q", b""]
    probe = pcap.decode(pcap.read_packets(spark, captures, "*_train.pcap").withColumn("linktype", F.lit(0)), probe=True)
    assert probe.count() == 4


def test_flows_of_a_capture(spark, captures):
    d = pcap.decode(pcap.read_packets(spark, captures, "*_train.pcap"))
    f = flows.five_tuple_flows(d, within=["file"])
    g = flows.flow_statistics(f, ["file", "fwd_ip", "fwd_port", "bwd_port", "protocol"]).orderBy("protocol").collect()
    assert [(r.protocol, r.pkts_forward, r.pkts_backward, r.flag_syn_count) for r in g] == [("tcp", 2, 1, 2), ("udp", 1, 0, 0)]


def test_certificates(spark, captures):
    found, certs = pcap.certificates(pcap.decode(pcap.read_packets(spark, captures, "*_train.pcap")))
    assert [r.cn for r in found.orderBy("pos").collect()] == ["www.example.com", "a.b.org"]
    assert {r.subject for r in certs.collect()} == {"CN=www.example.com", "CN=a.b.org"}


def test_data_source(spark, captures, tmp_path):
    spark.dataSource.register(pcap.PcapSource)
    df = spark.read.format("pcap").load(f"{captures}/sub")
    assert df.count() == 5
    assert spark.read.format("pcap").option("limit", 2).load(f"{captures}/sub").count() == 2
    out = str(tmp_path / "out")
    df.coalesce(1).write.format("pcap").mode("append").save(out)
    back = pcap.read_packets(spark, out)
    assert [(r.ts, bytes(r.raw)) for r in back.orderBy("pkt_no").collect()] == ROWS


def test_text_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("uid,名\n1,甲\n".encode("gb18030"))
    assert files.read_csv_any_encoding(spark, str(path)).first()[1] == "甲"
    with pytest.raises(ValueError, match="missing columns"):
        files.read_flow_csv(spark, str(path)).count()
    report = "=== one ===\n              precision    recall  f1-score   support\n\n      benign       0.90      0.80      0.85        10\n\n    accuracy                           0.88        12\n   macro avg       0.70      0.60      0.65        12\n"
    (tmp_path / "r.txt").write_text(report + report.replace("one", "two"))
    got = files.read_report(spark, str(tmp_path / "r.txt")).where("section = 'two'").collect()
    assert [(r.name, r.precision, r.support) for r in got] == [("benign", 0.9, 10), ("accuracy", 0.88, 12), ("macro avg", 0.7, 12)]
    assert files.first_existing(spark, [str(tmp_path / "no"), str(path)]) == str(path)


def test_jsonl_round_trip(spark, tmp_path):
    rows = [("u1", "1.1.1.1", "2.2.2.2", "é text", 1, "adware", 2, {"a": 1.0}), ("u2", None, None, "", 0, "benign", 0, {})]
    df = spark.createDataFrame(rows, schemas.FLOW_JSONL)
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_flows(spark, str(tmp_path / "j")).count() == 2
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "j")).collect()] == ["é text"]
    assert "é text" in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))


def test_column_lists(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "feat_10 int, feat_2 int, bytes int, label int, src_port int")
    assert schemas.prefixed_columns(df) == ["feat_2", "feat_10"]
    assert schemas.feature_groups(df) == {"Fused": ["feat_10", "feat_2", "bytes"], "LLM-only": ["feat_10", "feat_2"], "Manual-only": ["bytes"]}
    assert len(schemas.FLOW_COLUMNS) == 94 and len(schemas.NUMERIC_FEATURES) == 80
