"""Headers decoded by column against one packet after another."""

import ipaddress
import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from netquill.sources import capture_scan, headers, pcap

from .test_sources import frame


def plain(raw, link, probe, ipv6):
    if raw is None:
        return None
    known = (4, 6) if ipv6 else (4,)
    ip = next((o for o in (14, 16, 18, 0) if len(raw) > o and raw[o] >> 4 in known), None) if probe else {1: 14, 113: 16}.get(link, 0)
    if ip is None or len(raw) <= ip:
        return None
    version = raw[ip] >> 4
    if version == 4 and len(raw) >= ip + 20 and (raw[ip] & 15) >= 5:
        t, proto, src, dst = ip + (raw[ip] & 15) * 4, raw[ip + 9], raw[ip + 12 : ip + 16], raw[ip + 16 : ip + 20]
    elif version == 6 and ipv6 and len(raw) >= ip + 40:
        t, proto, src, dst = ip + 40, raw[ip + 6], raw[ip + 8 : ip + 24], raw[ip + 24 : ip + 40]
        while proto in (0, 43, 44, 51, 60, 135):
            if t + 8 > len(raw) or (proto == 44 and int.from_bytes(raw[t + 2 : t + 4], "big") >> 3):
                return None
            size = 8 if proto == 44 else (raw[t + 1] + 2) * 4 if proto == 51 else (raw[t + 1] + 1) * 8
            t, proto = t + size, raw[t]
    else:
        return None
    if proto not in (6, 17) or len(raw) < t + (20 if proto == 6 else 8):
        return None
    off = (raw[t + 12] >> 4) * 4 if proto == 6 else 8
    if len(raw) < t + off:
        return None
    flags = raw[t + 13] if proto == 6 else 0
    return (str(ipaddress.ip_address(src)), str(ipaddress.ip_address(dst)), *struct.unpack_from(">HH", raw, t), {6: "tcp", 17: "udp"}[proto], len(raw), *[flags & b > 0 for b in (1, 2, 4, 8, 16)], raw[t + off :])


def six(payload, chain=(), proto=6, link=14, src="2001:db8::1", dst="fe80::2:0:0:1"):
    body = payload
    kind = proto
    for k, data in reversed(chain):
        body, kind = bytes([kind]) + data + body, k
    head = struct.pack(">IHBB", 6 << 28, len(body), kind, 64) + ipaddress.IPv6Address(src).packed + ipaddress.IPv6Address(dst).packed
    return b"\0" * link + head + body


TCP = struct.pack(">HHIIBBHHH", 5000, 443, 0, 0, 5 << 4, 0x12, 0, 0, 0)
SIX = [
    six(TCP + b"hello"),
    six(struct.pack(">HHHH", 53, 9, 8, 0) + b"q", proto=17),
    six(TCP, [(0, b"\0" + b"\0" * 6), (60, b"\1" + b"\0" * 14), (43, b"\0" * 7)]),
    six(TCP + b"part", [(44, b"\0\0\1" + b"\0" * 4)]),
    six(TCP, [(44, b"\0\0\x09" + b"\0" * 4)]),  # a later fragment
    six(TCP, [(51, b"\4" + b"\0" * 22)]),
    six(TCP, [(0, b"\xff" + b"\0" * 6)]),  # leads out of the frame
    six(b"", [(59, b"\0" * 7)]),
    six(TCP + b"x", src="::ffff:1.2.3.4"),
    six(TCP)[:-1],
]


def frames():
    r, out = random.Random(3), [(None, 1), (b"", 1), (b"\0" * 14, 1)]
    a, b = (10, 0, 0, 1), (255, 168, 0, 9)
    for link, pad in ((1, 14), (113, 16), (101, 0), (276, 18)):
        out += [(frame(a, b, 5000, 443, 0x1F, b"abc", 6, pad), link), (frame(b, a, 53, 65535, payload=b"", proto=17, link=pad), link), (frame(a, b, 1, 2, proto=17, link=pad)[:-1], link), (frame(a, b, 1, 2, proto=1, link=pad), link)]
        out += [(x[14 - pad :] if pad <= 14 else b"\0" * (pad - 14) + x, link) for x in SIX]
    for raw, link in [x for x in out if x[0]]:
        for _ in range(6):
            hurt = bytearray(raw)
            for _ in range(r.randint(1, 3)):
                hurt[r.randrange(len(hurt))] = r.randrange(256)
            out.append((bytes(hurt[: r.randint(1, len(hurt))]) if r.random() < 0.3 else bytes(hurt), link))
    return out


@pytest.mark.parametrize("probe", [False, True])
@pytest.mark.parametrize("ipv6", [False, True])
def test_against_one_by_one(probe, ipv6):
    rows = frames()
    column = pa.array([None, b"front", *[x[0] for x in rows]], pa.binary()).slice(2)  # a column that starts inside its buffer
    keep, out = headers.decode_frames(column, np.array([x[1] for x in rows]), probe, ipv6)
    want = [plain(*x, probe, ipv6) for x in rows]
    assert keep.tolist() == [w is not None for w in want]
    names = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "len", "fin", "syn", "rst", "psh", "ack", "payload"]
    assert list(zip(*[out[n].to_pylist() for n in names], strict=True)) == [w for w in want if w]
    for a, v, i in zip(out["src_ip"].to_pylist(), (out["src_addr"] if ipv6 else out["src_ip"]).to_pylist(), out["src_int"].to_pylist(), strict=True):
        address = ipaddress.ip_address(a)
        assert i == (int(address) if address.version == 4 else None)
        if ipv6:
            assert v == (b"\0" * 10 + b"\xff\xff" + address.packed if address.version == 4 else address.packed)


def test_frames_of_spark(spark):
    rows = [(i, raw, link, "gone") for i, (raw, link) in enumerate(frames())]
    df = spark.createDataFrame(rows, "n long, raw binary, linktype int, src_ip string").repartition(3)
    got = {r["n"]: (r["src_ip"], r["dst_port"], bytes(r["payload"])) for r in pcap.decode(df, ipv6=True).collect()}
    want = {i: plain(raw, link, False, True) for i, raw, link, _ in rows}
    assert got == {i: (w[0], w[3], w[-1]) for i, w in want.items() if w}
    tls = pcap.tls_packets(pcap.decode(df, ipv6=True)).where("src_ip like '%:%'")
    assert tls.count() == sum(1 for w in want.values() if w and ":" in w[0] and w[4] == "tcp" and 443 in w[2:4])
    assert pcap.decode(df.limit(0)).count() == 0


def test_snaplen(spark, tmp_path):
    data = bytearray(pcap.capture_bytes([(1.0, b"a" * 60), (2.0, b"b" * 200), (3.0, b"c" * 50)]))
    data[16:20] = struct.pack("<I", 100)
    (tmp_path / "x.pcap").write_bytes(data)
    assert len(list(pcap.packets(bytes(data)))) == 3 and len(list(pcap.packets(bytes(data), snaplen=True))) == 1
    assert capture_scan.scan_captures(spark, str(tmp_path), 1_000, snaplen=True).count() == 1


def test_decoding_keeps_nothing():
    """Memory of batches decoded before is free again; a worker's grew with its rows."""
    raw = pa.array([frame((10, 0, 0, 1), (10, 0, 0, 2), 5, 6, payload=b"z" * 400) for _ in range(2_000)], pa.binary())
    headers.decode_frames(raw, np.ones(len(raw), np.int64))
    before = pa.total_allocated_bytes()
    for _ in range(20):
        headers.decode_frames(raw, np.ones(len(raw), np.int64))
    assert pa.total_allocated_bytes() - before < 1 << 20
