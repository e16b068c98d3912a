from pyspark.sql import functions as F

from netquill.streaming import flows

SCHEMA = "flow_id string, ts double, len double, syn int, fin int, rst int"


def run(spark, tmp_path, rows, make):
    src, ckpt = tmp_path / "src", tmp_path / "ckpt"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(src / f"p{i}"))
    s = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    s = s.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    q = make(s).writeStream.format("memory").queryName("t" + tmp_path.name.replace("-", "_")).option("checkpointLocation", str(ckpt)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("t" + tmp_path.name.replace("-", "_")).collect()


def test_running_flows(spark, tmp_path):
    rows = [
        [("a", 0.0, 10.0, 1, 0, 0), ("a", 1.0, 20.0, 0, 0, 0), ("b", 0.5, 5.0, 0, 0, 0)],
        [("a", 2.0, 30.0, 0, 1, 0), ("a", 20.0, 7.0, 0, 0, 0), ("c", 100.0, 1.0, 0, 0, 0)],
        [("d", 200.0, 1.0, 0, 0, 1)],
    ]
    rows = [[(k, t + 1000, *rest) for k, t, *rest in part] for part in rows]  # the first watermark is 1970
    got = {(r.flow_id, r.ts_start - 1000): r for r in run(spark, tmp_path, rows, flows.running_flows)}
    a = got[("a", 0.0)]
    assert (a.packets, a.bytes, a.reason, a.syn, a.len_mean) == (3, 60.0, "finished", 1, 20.0)
    assert got[("b", 0.5)].reason == "idle" and got[("a", 20.0)].packets == 1 and got[("d", 200.0)].reason == "reset"


def test_sessions_equal_their_batch_form(spark, tmp_path):
    rows = [[("a", 0.0, 1.0, 0, 0, 0), ("a", 5.0, 1.0, 0, 0, 0), ("a", 10.5, 1.0, 0, 0, 0)], [("z", 500.0, 1.0, 0, 0, 0)]]
    got = run(spark, tmp_path, rows, lambda s: flows.sessions(s, ["flow_id"], "event_time"))
    batch = spark.createDataFrame(rows[0], SCHEMA).withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    want = flows.sessions(batch, ["flow_id"], "event_time").collect()
    assert sorted(r.packets for r in got if r.flow_id == "a") == sorted(r.packets for r in want) == [1, 2]


def test_nearby_batches(spark):
    l = spark.createDataFrame([("k", 100)], "k string, t long").select("k", F.timestamp_seconds("t").alias("lt"))
    r = spark.createDataFrame([("k", 160), ("k", 161), ("j", 100)], "k string, t long").select("k", F.timestamp_seconds("t").alias("rt"))
    assert flows.nearby(l, r, "k", "lt", "rt").count() == 1
