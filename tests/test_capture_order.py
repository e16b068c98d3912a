"""Captures written side by side in order, and many small ranges read by few tasks."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from netquill.plans import capture_queries
from netquill.sources import capture_scan, pcap

from .test_capture_queries import against_sql, events
from .test_capture_scan import rows

PACKETS = "label string, linktype int, pkt_no long, ts double, raw binary"


def test_small_ranges_share_tasks(spark, tmp_path):
    data = {name: pcap.capture_bytes(rows(seed, 300)) for name, seed in (("a.pcap", 1), ("b.pcap", 2))}
    for name, x in data.items():
        (tmp_path / name).write_bytes(x)
    assert sum(map(len, data.values())) > 2 * 500 * capture_scan.SIDE_BY_SIDE
    got = capture_scan.scan_captures(spark, str(tmp_path), 500)
    assert got.rdd.getNumPartitions() <= capture_scan.SIDE_BY_SIDE
    found = sorted((r["file"].rsplit("/", 1)[1], r["pkt_no"], r["ts"], bytes(r["raw"]), r["linktype"]) for r in got.collect())
    assert found == sorted((name, i, *p) for name, x in data.items() for i, p in enumerate(pcap.packets(x)))


def test_a_range_reads_little_more_than_itself(tmp_path):
    path = tmp_path / "x.pcap"
    path.write_bytes(pcap.capture_bytes(rows(5, 40_000)))
    size = path.stat().st_size

    class Watched:
        def __init__(self, f):
            self.f, self.seek, self.sizes = f, f.seek, []

        def read(self, n):
            self.sizes.append(n)
            return self.f.read(n)

    def walked(begin, end):
        with open(path, "rb") as f:
            watched = Watched(f)
            records = capture_scan.capture(capture_scan.Bytes(watched, size))
            n = sum(1 for _ in records.walk(capture_scan.Walk(capture_scan.first_record(records, begin, end) if begin else records.first), end))
        return n, watched.sizes

    n, sizes = walked(5 << 20, (5 << 20) + (32 << 10))
    assert n > 10 and sum(sizes) < 512 << 10
    n, sizes = walked(0, size)  # blocks grow over a whole file
    assert n == 40_000 and max(sizes) == capture_scan.BLOCK_BYTES and len(sizes) < 20


def packets(n=300):
    r = random.Random(3)
    return [(r.choice(["a", "b", None]), r.choice([1, 113, None]), i, None if i == 7 else round(r.uniform(0, 2e9), 6), r.randbytes(r.choice([1, 60, 1500]))) for i in range(n)]


def test_written_in_order(spark, tmp_path):
    """A capture per label and link type, byte for byte that of its packets in order."""
    found = packets()
    df = spark.createDataFrame(random.Random(4).sample(found, len(found)), PACKETS)
    pcap.write_in_order(df.repartitionByRange(7, "label", "pkt_no").sortWithinPartitions("label", "pkt_no"), str(tmp_path / "out"))
    for label in ("a", "b", None):
        for linktype in (1, 113, None):
            files = list((tmp_path / "out" / pcap._folder(label, linktype)).glob("*.pcap"))
            assert len(files) == 1
            assert files[0].read_bytes() == pcap.capture_bytes([(p[3] or 0.0, p[4]) for p in found if p[:2] == (label, linktype)], linktype or 0)
    assert not list((tmp_path / "out").rglob("*.lz4"))


def test_order_is_not_guessed(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, i, 1.0, b"x") for i in range(40)], PACKETS)
    with pytest.raises(PySparkException, match="not in order within a partition"):
        pcap.write_in_order(df.repartition(1).sortWithinPartitions(F.desc("pkt_no")), str(tmp_path / "down"))
    with pytest.raises(ValueError, match="not in order over partitions"):
        pcap.write_in_order(df.repartition(4, "pkt_no").sortWithinPartitions("pkt_no"), str(tmp_path / "mixed"))
    for bad in [("a", 1, 0, 1.0, None), ("a", 1, 0, -1.0, b"x"), ("a", 1, 0, 2.0**32, b"x")]:
        with pytest.raises(PySparkException, match="a capture cannot hold"):
            pcap.write_in_order(spark.createDataFrame([bad], PACKETS), str(tmp_path / "bad"))


def test_query_writes_one_capture_per_label(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(capture_queries, "PIECE_PACKETS", 5)
    monkeypatch.setattr(capture_queries, "fresh_dir", lambda spark, name: str(tmp_path / name))
    against_sql(spark, tmp_path, "capture_ranges_read", events(random.Random(9)))
    assert len(list((tmp_path / "captures").rglob("*.pcap"))) == 2


def test_query_without_events(spark, tmp_path):
    against_sql(spark, tmp_path, "capture_ranges_read", [])
