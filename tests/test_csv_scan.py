"""CSV in byte ranges and encodings, and filters answered by the sources, against Spark's own answers."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from netquill.sources import csv_scan, pcap

from .test_capture_sink import rows as packets

ALPHABET = ["a", "b", "Z", ",", '"', " ", "é", "甲", "聯通", "😀", "0"]


def cells(rng, n):
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, n))) for _ in range(3)]


def write(path, header, rows, encoding, end):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerows([header, *rows])
    path.write_bytes(out.getvalue().encode(encoding))


def blank_null(row):
    return tuple(x or None for x in row)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Headers, encodings and line ends that differ per file; the expected rows by column name."""
    root, want, rng = tmp_path_factory.mktemp("csv"), [], random.Random(3)
    for i, (enc, end) in enumerate([("utf-8", "\n"), ("gb18030", "\r\n"), ("gb18030", "\n"), ("utf-8", "\r\n"), ("utf-8-sig", "\n")]):
        header = [["k", "x", "名"], ["名", "k", "y"], ["k", "x", "y"]][i % 3]
        rows = [[*cells(rng, 12 if j % 50 else 3000)] for j in range(300)]
        for j, r in enumerate(rows):
            r[header.index("k")] = f"{i}-{j}"
        rows[7][1 if header[0] == "k" else 0] = "甲"  # GB18030 files hold what is no UTF-8
        write(root / f"f{i}.csv", header, rows, enc, end)
        want += [{**dict.fromkeys(["k", "x", "名", "y"]), **dict(zip(header, blank_null(r), strict=True))} for r in rows]
    (root / "_SUCCESS").write_text("")
    (root / ".f0.csv.crc").write_text("x")
    (root / "none.csv").write_text("")
    (root / "head.csv").write_text("k,x")
    return root, want


@pytest.mark.parametrize("split, block", [(64 << 20, 4 << 20), (1000, 64), (333, 4096), (1, 7)])
def test_ranges_hold_every_line_once(folder, split, block):
    root, _ = folder
    for path in sorted(root.glob("*.csv")):
        raw = path.read_bytes()
        with open(path, "rb") as f:
            got = [b for a in range(0, min(len(raw), 40 * split + 1), split) for b in csv_scan.blocks(f, a, min(a + split, len(raw)), len(raw), block)]
        assert raw.startswith(b"".join(got))
        if 40 * split >= len(raw):
            assert b"".join(got) == raw
        assert all(b.endswith(b"\n") or raw.endswith(b) for b in got)


@pytest.mark.parametrize("split", [64 << 20, 5000])
def test_files_of_both_encodings(spark, folder, split):
    root, want = folder
    df = csv_scan.scan_csv(spark, str(root), split_bytes=split)
    assert df.columns == ["k", "x", "名", "y"]
    key = lambda r: r["k"]
    assert sorted((r.asDict() for r in df.collect()), key=key) == sorted(want, key=key)
    few = csv_scan.scan_csv(spark, str(root), ["y", "k"], split_bytes=split)
    assert sorted(few.collect(), key=key) == sorted(((r["y"], r["k"]) for r in want), key=lambda r: r[1])


FILTERS = {
    "x > 'a'": [("x", ">", "a")],
    "x <= 'b' and x >= '0'": [("x", "<=", "b"), ("x", ">=", "0")],
    "x = 'a'": [("x", "=", "a")],
    "x <> 'a'": [("x", "<>", "a")],
    "x is null": [("x", "is null", None)],
    "y is not null and x < 'a'": [("y", "is not null", None), ("x", "<", "a")],
    "x in ('a', '甲', 'b')": [("x", "in", ["a", "甲", "b"])],
    "x not in ('a', 'b')": [("x", "not in", ["a", "b"])],
    "x like 'a%' and y like '%b'": [("x", "starts with", "a"), ("y", "ends with", "b")],
    "x like '%甲%'": [("x", "contains", "甲")],
}


def test_filters_answered_by_the_source(spark, folder):
    root, _ = folder
    df = csv_scan.scan_csv(spark, str(root))
    plain = spark.createDataFrame(df.collect(), df.schema)
    for sql, where in FILTERS.items():
        got = csv_scan.scan_csv(spark, str(root), where=where, split_bytes=20_000).collect()
        assert sorted(map(str, got)) == sorted(map(str, plain.where(sql).collect())), sql
    a, b = (csv_scan.scan_csv(spark, str(root), ["k"], [("x", *f)]) for f in (("=", "a"), (">", "b")))
    assert sorted(r["k"] for r in a.union(b).collect()) == sorted(r["k"] for r in plain.where("x = 'a' or x > 'b'").collect())
    with pytest.raises(ValueError, match="no such filter"):
        csv_scan.scan_csv(spark, str(root), where=[("x", "like", "a")])
    with pytest.raises(ValueError, match="null"):
        csv_scan.scan_csv(spark, str(root), where=[("x", "in", ["a", None])])


def test_ragged_and_broken_lines(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(b'a,b,a,\n1\n1,2,3,4,5\n\n"x ""y""",,"",z\n"open,2,3\nu\rv,w\n\xff,2,3,4\n')
    got = csv_scan.CsvReader({"path": str(tmp_path / "r.csv"), "gb18030Files": "[]"}, type("S", (), {"names": ["a0", "b", "a2", "_c3"]}))
    rows = [tuple(r.values()) for p in got.partitions() for b in got.read(p) for r in b.to_pylist()]
    assert rows == [("1", None, None, None), ("1", "2", "3", "4"), ('x "y"', None, "", "z"), ("open,2,3", None, None, None), ("u", None, None, None), ("v", "w", None, None), ("�", "2", "3", "4")]


def test_other_columns_only_and_nothing(spark, folder, tmp_path):
    root, want = folder
    assert csv_scan.scan_csv(spark, str(root), ["no such"]).where("`no such` is null").count() == len(want)
    (tmp_path / "h.csv").write_text("k,x")
    assert csv_scan.scan_csv(spark, str(tmp_path)).collect() == []
    with pytest.raises(FileNotFoundError):
        csv_scan.listed(str(tmp_path / "gone"))


def test_written_in_gb18030(spark, tmp_path):
    rows = [(1, "甲,乙", None), (2, 'say "x"', "😀"), (3, "", "")]
    df = spark.createDataFrame(rows, "n int, t string, u string")
    csv_scan.write_encoded_csv(df.repartition(3), str(tmp_path / "out"))
    assert any(b"\xbc\xd7" in p.read_bytes() for p in (tmp_path / "out").glob("*.csv"))
    got = csv_scan.scan_csv(spark, str(tmp_path / "out")).select(F.col("n").cast("int"), "t", "u")
    assert sorted(map(tuple, got.collect())) == rows
    with pytest.raises(Exception, match="line break"):
        csv_scan.write_encoded_csv(df.select(F.lit("a\nb").alias("t")), str(tmp_path / "no"))


def test_capture_filters(spark, tmp_path):
    spark.dataSource.register(pcap.PcapSource)
    out = str(tmp_path / "out")
    spark.createDataFrame(packets(5, 300), "label string, linktype int, ts double, raw binary").repartition(2).write.format("pcap").mode("append").save(out)
    df = pcap.open_captures(spark, out)
    plain = spark.createDataFrame(df.collect(), df.schema)
    assert plain.count() == 300
    one = plain.first()["file"]
    for sql, where in {
        "ts >= 100 and ts < 200.5": [("ts", ">=", 100), ("ts", "<", 200.5)],
        "linktype = 113": [("linktype", "=", 113)],
        "linktype in (1, 101) and ts > 7": [("linktype", "in", [1, 101]), ("ts", ">", 7)],
        "ts not in (1.0, 2.0) and linktype <> 1": [("ts", "not in", [1.0, 2.0]), ("linktype", "<>", 1)],
        "ts is null": [("ts", "is null", None)],
        f"file = '{one}' and ts <= 150": [("file", "=", one), ("ts", "<=", 150)],
        "file = 'none'": [("file", "=", "none")],
    }.items():
        assert sorted(map(str, pcap.open_captures(spark, out, where).collect())) == sorted(map(str, plain.where(sql).collect())), sql
    with pytest.raises(ValueError):
        pcap.open_captures(spark, out, [("pkt_no", "=", 1)])
