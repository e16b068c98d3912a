"""Captures read in ranges against the whole-file reader."""

import random
import struct

import pytest

from netquill.sources import capture_scan, pcap

from .test_sources import pcapng


def rows(seed, n, nested=False):
    r, out, t = random.Random(seed), [], 0.0
    for i in range(n):
        t += r.random()
        raw = r.randbytes(r.choice([1, 40, 60, 300, 1500]))
        if nested and i % 7 == 3:  # a packet that holds records of a capture itself
            raw = pcap.capture_bytes([(j, r.randbytes(50)) for j in range(30)])[24:] + raw
        out.append((round(t, 6), raw))
    return out


def interfaces(data, every=40):
    """A capture of the newer format whose link type changes on the way."""
    out, at, n = data[:28], 28, 0
    while at < len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if n % every == every - 1:
            out += struct.pack("<IIHHII", 1, 20, 100 + n % 256, 0, 0, 20)
        out, at, n = out + data[at : at + size], at + size, n + 1
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("captures")
    classic, blocks, nested = pcap.capture_bytes(rows(1, 400)), interfaces(pcapng(rows(2, 300))), pcap.capture_bytes(rows(3, 200, nested=True))
    hurt = bytearray(classic)
    hurt[60_000:60_040] = b"\xff" * 40
    big = struct.pack(">IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 113) + b"".join(struct.pack(">IIII", int(t), 5, len(x), len(x)) + x for t, x in rows(4, 200))
    files = {"a.pcap": classic, "b.pcapng": blocks, "c.pcap": nested, "d.pcap": bytes(hurt), "e.pcap": big, "f.pcap": classic[:-7], "g.pcapng": blocks[: len(blocks) // 2], "h.pcap": b"", "i.pcap": classic[:10], "j.pcap": b"no capture" * 500, "k.pcap": classic[:24], "l.pcap": pcap.capture_bytes([(1.0, b"x" * 200_000), (2.0, b"y" * 10), (3.0, b"z" * 150_000)])}
    for name, data in files.items():
        (d / name).write_bytes(data)
    want = {(name, i, *p) for name, data in files.items() for i, p in enumerate(pcap.packets(data))}
    return str(d), want


@pytest.mark.parametrize("split", [9_000, 1 << 20])
def test_ranges_join_up(spark, folder, split):
    path, want = folder
    got = capture_scan.scan_captures(spark, path, split)
    if split == 9_000:
        assert got.rdd.getNumPartitions() > 80
    found = [(r["file"].rsplit("/", 1)[1], r["pkt_no"], r["ts"], bytes(r["raw"]), r["linktype"]) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_wrong_guesses_are_walked_again(spark, folder):
    """Records inside packets mislead the guess; the walk of the range before corrects it."""
    path, want = folder
    files = spark.createDataFrame([(f"{path}/c.pcap", len(open(f"{path}/c.pcap", "rb").read()))], "file string, length long")
    ranges = {r["part"]: r for r in capture_scan.capture_ranges(files, 1_500).collect()}
    guessed = 0
    with open(f"{path}/c.pcap", "rb") as f:
        records = capture_scan.capture(capture_scan.Bytes(f, ranges[0]["length"]))
        for r in ranges.values():
            if r["part"]:
                assert r["entry"] == ranges[r["part"] - 1]["exit"]
                guessed += r["entry"] != capture_scan.first_record(records, r["begin"], r["end"])
    assert guessed > 3
    assert sum(r["packets"] for r in ranges.values()) == sum(w[0] == "c.pcap" for w in want)


def test_memory_is_a_block(tmp_path):
    """The reader never asks for more than a block at once, however large the file."""
    path = tmp_path / "x.pcap"
    path.write_bytes(pcap.capture_bytes(rows(5, 3_000)))

    class Watched:
        most = 0

        def __init__(self, f):
            self.f, self.seek = f, f.seek

        def read(self, n):
            self.most = max(self.most, n)
            return self.f.read(n)

    with open(path, "rb") as f:
        watched = Watched(f)
        records = capture_scan.capture(capture_scan.Bytes(watched, path.stat().st_size, block=4_096))
        assert sum(1 for _ in records.walk(capture_scan.Walk(24), path.stat().st_size)) == 3_000
    assert watched.most <= 4_096
