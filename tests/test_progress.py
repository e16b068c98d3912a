import time

from netquill.streaming import progress


def test_progress_of_a_stream(spark, tmp_path):
    for i in range(2):
        spark.range(10 * (i + 1)).coalesce(1).write.parquet(str(tmp_path / "src" / f"p{i}"))
    heard = progress.watch(spark, most=50)
    try:
        s = spark.readStream.schema("id long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
        q = s.writeStream.format("noop").queryName("counted").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        for _ in range(100):
            rows = heard.table(spark).where(f"run_id = '{q.runId}'").collect()
            if any(r["event"] == "terminated" for r in rows):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(heard)
    assert [r["event"] for r in rows][0] == "started" and rows[-1]["event"] == "terminated" and rows[-1]["error"] is None
    batches = [(r["batch"], r["rows_in"]) for r in rows if r["event"] == "progress" and r["rows_in"]]
    assert [b for b, _ in batches] == [0, 1] and sorted(n for _, n in batches) == [10, 20]
