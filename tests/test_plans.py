import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from netquill.functions import embed
from netquill.plans import detect, extract, registry, runner, serve
from netquill.schemas import FLOW_COLUMNS
from netquill.sources import pcap

from .test_sources import CERT, ROWS, A, B, frame


@pytest.fixture(scope="module")
def packets(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("captures") / "set" / "sub"
    d.mkdir(parents=True)
    more = [(100.0, frame(B, A, 7, 8, 0x02)), (101.0, frame(A, B, 8, 7, 0x14)), (108.0, frame(B, A, 7, 8))]
    (d / "iodine_train.pcap").write_bytes(pcap.capture_bytes(ROWS + more))
    return pcap.read_packets(spark, str(d))


def test_feature_table(spark, packets):
    t = extract.feature_table(packets)
    assert t.columns == FLOW_COLUMNS
    got = {(r.src_port, r.protocol): r for r in t.collect()}
    assert set(got) == {(5000, "tcp"), (5000, "udp"), (7, "tcp")}
    r = got[(5000, "tcp")]
    assert r.flow_uid == "10.0.0.1_5000_192.168.0.9_443_1.5" and r.label == "iodine" and r.subfolder == "sub" and r.dataset_source == "set"
    assert (r.pkts_forward, r.pkts_backward, r.flag_syn_count, r.flag_fin_count) == (2, 1, 2, 1)
    assert (r.cn_length, r.cn_hash, r.cert_chain_depth, r.cert_valid_days) == (15, 290, 2, 395.0)
    assert r.cert_age_at_capture == 30.0 and r.conn_count == 2 and r.fwd_header_len == 80
    # the last active period is not counted, the gap of 7.25 s is idle
    assert (r.active_max, r.idle_max) == (0.25, 7.25)
    assert got[(7, "tcp")].rst_ratio == 1.0 and got[(7, "tcp")].cert_valid_days == -1.0 and got[(7, "tcp")].zeek_x509_log == "-"
    text = {r.flow_uid: r for r in extract.flow_jsonl(t).collect()}["10.0.0.1_5000_192.168.0.9_443_1.5"]
    assert text.num_events == 4 and text.label == 4 and text.num_features["pkts_total"] == 3.0
    assert text.text.startswith('{"c":{"proto":"tcp","svc":"ssl","dur":"7.5000"') and '{"s":{"ver":"TLSv1.2"' in text.text and text.text.count('{"x":') == 2
    d = extract.tls_details(t).where("src_port = 5000 and protocol = 'tcp'").first()
    assert (d.sni, d.tls_version, d.cert_subject) == ("www.example.com", "TLSv1.2", "CN=www.example.com")


def test_temporal_table(spark, packets):
    t = extract.temporal_table(packets)
    assert len(t.columns) == 48
    r = t.where("src_port = 5000 and protocol = 'tcp'").first()
    assert r.packet_time_offsets == [0.0, 0.25, 7.5] and r.packet_directions == ["F", "B", "F"]
    assert (r.active_max, r.active_min, r.idle_max, r.iat_max) == (0.25, 0.0, 7.25, 7.25)
    assert t.where("protocol = 'udp'").first().conn_state == "SF"


def test_tls_details_of_odd_logs(spark):
    rows = [("a", None, None), ("b", '{"s": {"server_name": "x.org", "version": ""}}', '{"x": {"certificate_issuer": "CN=I"}}'), ("c", "{not valid json", "-"), ("d", "{'server_name': 'y.org'}", '[{"certificate.subject": "CN=S"}]')]
    df = spark.createDataFrame(rows, "flow_uid string, zeek_ssl_log string, zeek_x509_log string")
    got = {r.flow_uid: (r.sni, r.tls_version, r.cert_issuer, r.cert_subject) for r in extract.tls_details(df).collect()}
    assert got == {"a": (None,) * 4, "b": ("x.org", None, "CN=I", None), "c": (None,) * 4, "d": ("y.org", None, None, "CN=S")}


@pytest.fixture(scope="module")
def table(spark):
    k = (F.col("id") % 3).cast("int")
    noise = F.pmod(F.xxhash64("id"), F.lit(100)) / 100
    return spark.range(600).select(F.concat(F.lit("u"), "id").alias("flow_uid"), k.alias("label"), (k * 2 + noise).alias("feat_0"), noise.alias("feat_1"), F.when(F.col("id") % 50 > 0, noise + k).alias("manual"), F.col("id").alias("timestamp").cast("double"))


def test_detector(spark, table, tmp_path):
    got = detect.train_detector(table, columns=["feat_0", "feat_1", "manual"], model=detect.boosted(rounds=3))
    p = got["predictions"]
    assert p.count() == 120
    parts = detect.evaluate(p, range(3))
    assert parts["report"].where("class = 'accuracy'").first().f1 > 0.9
    assert parts["micro_auc"].first().auc > 0.9
    back = detect.save(got["model"], str(tmp_path / "m"))
    fill = table.na.fill(0.0)
    assert detect.predict(back, fill).select("pred_label").exceptAll(detect.predict(got["model"], fill).select("pred_label")).count() == 0
    assets = detect.detection_assets(p, table.select("flow_uid", "timestamp"))
    assert {r.kind: r.n for r in assets["summary"].collect()}["total"] == 120
    assert assets["row_trend"].agg(F.sum(F.col("benign") + F.col("malicious"))).first()[0] == 120
    for name, model in detect.baseline_models().items():
        one = detect.train_detector(table, columns=["feat_0", "feat_1"], model=model)["predictions"]
        assert one.where("true_label = pred_label").count() > 60, name


def test_ablation(spark, table):
    rows = detect.ablation(table, {"all": ["feat_0", "feat_1"], "noise": ["feat_1"]}, make_model=lambda: DecisionTreeClassifier(labelCol="label", weightCol="weight"), labels=range(3)).collect()
    v = {(r.group, r.metric): r.value for r in rows}
    assert v[("all", "accuracy")] > v[("noise", "accuracy")] and len(v) == 6


def test_serving(spark):
    f = spark.createDataFrame([(f"u{i}", i, i * 10.0, "tcp") for i in range(5)], "flow_uid string, total_packets long, total_bytes double, protocol string")
    assert [r.flow_uid for r in serve.metadata_page(f, 2, 1).collect()] == ["u1", "u2"]
    logs = spark.createDataFrame([("u1", "{}", '{"server_name": "h"}', "-")], "flow_uid string, zeek_conn_log string, zeek_ssl_log string, zeek_x509_log string")
    assert serve.metadata_detail(f, logs, "u1").first().sni == "h" and serve.metadata_detail(f, logs, "u9").count() == 0
    p = spark.createDataFrame([("u1", "benign"), ("u2", "iodine")], "flow_uid string, pred_label_name string")
    assert [r.flow_uid for r in serve.predictions_page(p, label="iodine").collect()] == ["u2"]
    assert serve.dashboard(f, p)["flows"].first().packets == 10
    rep = spark.createDataFrame([("m1", "weighted avg", 0.5), ("m2", "weighted avg", 0.7)], "section string, name string, f1 double")
    assert [r.section for r in serve.evaluation(rep).collect()] == ["m2", "m1"]


def test_runner(spark):
    seen = []

    def bad(spark, ctx):
        raise RuntimeError("no")

    m = runner.run_pipeline(spark, [("a", lambda s, c: c["n"]), ("b", lambda s, c: 1), ("c", bad), ("d", lambda s, c: 1)], {"n": 7}, done=lambda n: n == "b", listen=lambda *x: seen.append(x))
    assert [(r.stage, r.status, r.rows) for r in m.collect()] == [("a", "ok", 7), ("b", "skipped", None), ("c", "failed", None)]
    assert seen[-1] == ("c", "failed")


def test_embedding(spark):
    df = spark.createDataFrame([("a b a",), (None,)], "t string")
    r = embed.embed(df, "t").collect()
    assert len(r[0].embedding) == 768 and sum(x * x for x in r[0].embedding) == pytest.approx(1.0) and set(r[1].embedding) == {0.0}
    ids = df.select(embed.token_ids(F.col("t"), 4).alias("i")).collect()
    assert ids[0].i[0] == ids[0].i[2] > 0 and ids[0].i[3] == 0 and ids[1].i == [0] * 4


assert CERT


def test_registry(spark, tmp_path):
    from netquill.plans import registry

    base = tmp_path / "base"
    assert registry.latest_checkpoint(spark, str(base)) is None
    for n in ("checkpoint-9", "checkpoint-10", "checkpoint-", "other-99"):
        (base / n).mkdir(parents=True)
    assert registry.latest_checkpoint(spark, str(base)).endswith("checkpoint-10")
    (tmp_path / "best").mkdir()
    assert registry.assemble(spark, str(base), str(tmp_path / "best"))[0].endswith("checkpoint-10")
    with pytest.raises(FileNotFoundError):
        registry.assemble(spark, str(base), str(tmp_path / "absent"))
    registry.save_columns(spark, ["b", "a"], str(tmp_path / "columns"))
    assert registry.load_columns(spark, str(tmp_path / "columns")) == ["b", "a"]


def test_boosted_detector_with_reducer(spark, tmp_path):
    """Trained, stored, read back: the same predictions, also without labels; the report's tables as files."""
    import numpy as np

    r = np.random.default_rng(5)
    names = [f"feat_{i}" for i in range(6)]
    rows = [(f"u{i}", *(r.normal(size=6) + 3.0 * (i % 3)).tolist(), float(i % 3) if i % 9 else None, i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "flow_uid string, " + ", ".join(f"{c} double" for c in names) + ", bytes_total double, label int")
    cfg = {"latent_dim": 3, "hidden_dims": [8], "proj_dim": 3, "batch_size": 64, "epochs": 2, "learning_rate": 0.01, "seed": 7}
    got = detect.train_boosted(df, semantic=names, classes=3, reducer=cfg, rounds=4, depth=2, bins=8, rate=0.5, least=3, patience=2)
    assert got["columns"] == ["bytes_total", "latent_0", "latent_1", "latent_2"]
    p = {x.flow_uid: (x.pred_label, round(x.confidence, 9)) for x in got["predictions"].collect()}
    assert len(p) == 30 and sum(int(u[1:]) % 3 == v[0] for u, v in p.items()) >= 27
    registry.save_boosted(spark, got, str(tmp_path / "m"))
    again = {x.flow_uid: (x.pred_label, round(x.confidence, 9)) for x in registry.infer_boosted(spark, df.drop("label"), str(tmp_path / "m")).collect()}
    assert len(again) == 150 and {u: again[u] for u in p} == p
    folders = detect.export_assets(detect.detection_assets(got["predictions"]), str(tmp_path / "csv"))
    assert [f.rsplit("/", 1)[1] for f in folders] == ["classes", "malicious", "summary"]
    assert spark.read.option("header", True).csv(folders[0]).count() == len({v[0] for v in p.values()})


def test_models_compared_on_one_split(spark):
    import random

    r = random.Random(6)
    rows = [(f"u{i}", r.gauss(4.0 * (i % 3), 0.5), r.gauss(100.0 * (i % 3), 5.0) if i % 8 else None, i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "flow_uid string, a double, b double, label int")
    tree = {"DecisionTree": DecisionTreeClassifier(labelCol="label", featuresCol="features", weightCol="weight", seed=1)}
    got = {x.model: x for x in detect.compare_models(df, models=tree, classes=3, rounds=3, depth=2, bins=8, rate=0.5, least=3, patience=2).collect()}
    assert set(got) == {"DecisionTree", "KNN", "Boosted"}
    assert all(x.accuracy > 0.9 and x.macro_f1 > 0.9 and x.weighted_f1 > 0.9 for x in got.values())
