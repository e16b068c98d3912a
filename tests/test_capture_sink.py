"""Captures by label and link type, from batches and streams."""

import random
import shutil

from pyspark.sql import Row

from netquill.sources import capture_scan, pcap

SCHEMA = "label string, linktype int, ts double, raw binary"


def rows(seed, n):
    r = random.Random(seed)
    return [(r.choice(["benign", "a/b", None]), r.choice([1, 113, 101]), float(i), r.randbytes(r.randint(1, 80))) for i in range(n)]


def read(spark, path):
    out = set()
    for r in capture_scan.scan_captures(spark, path, glob="*.pcap").collect():
        folder = r["file"].split(path.rstrip("/") + "/")[1].split("/")[:-1]
        out.add((folder[0] if len(folder) == 2 else None, r["linktype"], r["ts"], bytes(r["raw"])))
    return out


def named(data):
    return {(None if label is None else label.replace("/", "_2f_"), *rest) for label, *rest in data}


def test_batch(spark, tmp_path):
    spark.dataSource.register(pcap.PcapSource)
    data = rows(1, 200)
    spark.createDataFrame(data, SCHEMA).repartition(3).write.format("pcap").option("flushPackets", 7).mode("append").save(str(tmp_path / "out"))
    assert read(spark, str(tmp_path / "out")) == named(data)
    assert spark.read.format("pcap").load(str(tmp_path / "out")).count() == 200


def test_stream_of_epochs(spark, tmp_path):
    spark.dataSource.register(pcap.PcapSource)
    parts = [rows(s, 60) for s in (2, 3, 4)]
    parts = [[(label, k, t + 100 * i, raw) for label, k, t, raw in p] for i, p in enumerate(parts)]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "src" / f"p{i}"))
    out = str(tmp_path / "out")

    def run(state):
        s = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
        q = s.writeStream.format("pcap").option("path", out).option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start()
        assert q.awaitTermination(100)

    run("state")
    want = named(x for p in parts for x in p)
    assert read(spark, out) == want and len(pcap.committed_captures(out)) == len(list((tmp_path / "out").rglob("*.pcap")))
    # all epochs once more, as after the loss of the checkpoint: their logs stand, so nothing is added
    run("state-again")
    assert read(spark, out) == want and len({x[3] for x in want}) == sum(1 for _ in capture_scan.scan_captures(spark, out, glob="*.pcap").collect())


def test_an_epoch_cut_off(spark, tmp_path):
    data = rows(5, 40)
    sink = pcap.PcapStreamWriter({"path": str(tmp_path / "out")})
    write = lambda: sink.write(iter([Row(label=a, linktype=k, ts=t, raw=raw) for a, k, t, raw in data]))
    sink.commit([write()], 0)
    (tmp_path / "out" / "_epochs" / "0.json").unlink()  # files were placed, the log was not written
    sink.commit([write(), None], 0)
    assert read(spark, str(tmp_path / "out")) == named(data)
    sink.commit([write()], 0)
    sink.abort([write(), None], 1)
    assert read(spark, str(tmp_path / "out")) == named(data) and not list((tmp_path / "out" / "_temporary").iterdir())
    assert pcap.committed_captures(str(tmp_path / "none")) == []
    shutil.rmtree(tmp_path / "out")
