import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netquill.operators import features, joins, metrics, splits, vectors


def data():
    rng = np.random.default_rng(42)
    y = np.repeat([0, 1, 2], 20)
    return rng.normal(size=(60, 12)) + 0.4 * y[:, None], y


NAMES = [f"feat_{i}" for i in range(12)]


def fused(spark):
    x, y = data()
    rows = [(f"u{i}", *map(float, x[i]), i, int(y[i])) for i in range(60)]
    return spark.createDataFrame(rows, "flow_uid string, " + ", ".join(f"{n} double" for n in NAMES) + ", bytes_total long, label int")


def test_reducer(spark, tmp_path):
    x, y = data()
    r = vectors.Reducer(latent=4, epochs=5, batch=16).fit(x, y, NAMES)
    assert r.encode(x).shape == (60, 4)
    r.save(str(tmp_path / "m.json"))
    again = vectors.Reducer.load(str(tmp_path / "m.json"))
    assert np.allclose(again.encode(x), r.encode(x))
    df = fused(spark)
    with pytest.raises(ValueError, match="columns differ"):
        r.transform(df, NAMES[::-1])
    out = features.replace_semantic(again.transform(df, NAMES), NAMES, "reduced", 4)
    assert out.columns == ["flow_uid", "bytes_total", "label", "feat_0", "feat_1", "feat_2", "feat_3"]
    first = out.orderBy("bytes_total").first()
    assert np.allclose([first[f"feat_{i}"] for i in range(4)], r.encode(x[:1])[0])
    (tmp_path / "old.json").write_text('{"input_dim": 12, "cfg": {}}')
    with pytest.raises(ValueError, match="format"):
        vectors.Reducer.load(str(tmp_path / "old.json"))
    with pytest.raises(ValueError, match="finite"):
        vectors.Reducer().fit(x * np.nan, y, NAMES)


def test_reducer_gradient():
    x, y = data()
    r = vectors.Reducer(latent=3).fit(x, y, NAMES)
    z = (x - r.mean) / r.std
    _, g = r._loss(z[::3], y[::3])
    for i, j in ((0, 0), (5, 2), (11, 1)):
        w = r.w.copy()
        r.w = w.copy()
        r.w[i, j] += 1e-5
        hi = r._loss(z[::3], y[::3])[0]
        r.w = w.copy()
        r.w[i, j] -= 1e-5
        lo = r._loss(z[::3], y[::3])[0]
        r.w = w
        assert g[i, j] == pytest.approx((hi - lo) / 2e-5, abs=1e-4)


def test_pca_matches_numpy(spark):
    x, _ = data()
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    out, axes = vectors.pca(df, "v", 3)
    got = np.array([r.reduced for r in out.orderBy("i").collect()])
    assert np.allclose(got, (x - x.mean(0)) @ axes.T)
    assert np.allclose(np.abs(axes), np.abs(np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:3]), atol=1e-6)


def test_neighbour_vote(spark):
    x, y = data()
    df = spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], "i long, v array<double>, label int")
    got = {r.query_id: r.pred_label for r in vectors.knn_classify(df.where("i % 7 = 0"), df, "v", "i", "label", 5).collect()}
    for q in range(0, 60, 7):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        near = y[np.argsort(d, kind="stable")[:5]]
        assert got[q] == np.argmax(np.bincount(near))


def test_prepare_detector(spark):
    rows = [("u1", "benign", "a.com", "x", 1.0), ("u2", "adware", None, None, None), ("u3", None, "b.org", "y", 3.0)]
    df = spark.createDataFrame(rows, "flow_uid string, label string, cn_value string, kind string, n double").withColumn("src_ip", F.lit("1.1.1.1"))
    out = {r.flow_uid: r for r in features.prepare_detector(df).collect()}
    assert out["u2"].n == 2.0 and out["u2"].label == 1 and out["u3"].label is None
    assert [out[f"u{i}"].kind for i in (1, 2, 3)] == [1, 0, 2]
    assert "src_ip" not in out["u1"].asDict() and out["u1"].cn_len == 5


def test_splits_are_exact_and_repeatable(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 3).cast("int"))
    a = splits.stratified_split(df, "id", "label")
    got = {(r.label, r.subset): r["count"] for r in a.groupBy("label", "subset").count().collect()}
    assert got[(0, "test")] == 67 and got[(0, "val")] == 33 and got[(0, "train")] == 234
    b = splits.stratified_split(df.repartition(7), "id", "label")
    assert a.exceptAll(b.select(a.columns)).count() == 0
    q = {r.subset: r["count"] for r in splits.quota_sample(spark.range(10), "id", 30, 20).groupBy("subset").count().collect()}
    assert q == {"train": 6, "test": 4}
    assert splits.guarded_split(df.where("id < 4"), "id", "label").count() == 4
    w = splits.weighted_sample(df.withColumn("w", F.lit(1.0)), "id", "w", 2000)
    assert w.groupBy("id").count().where("count <> 2").count() == 0


def test_cached_split(spark, tmp_path):
    path = str(tmp_path / "s")
    one = splits.cached_split(spark.range(5), path, lambda d: d)
    two = splits.cached_split(spark.range(50), path, lambda d: d)
    assert one.count() == two.count() == 5
    assert splits.cached_split(spark.range(50), path, lambda d: d, refresh=True).count() == 50


def test_metrics_on_empty_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "t int, p int")
    rep = {r["class"]: r for r in metrics.class_report(df, "t", "p", [0, 1, 2]).collect()}
    assert (rep["1"].precision, rep["1"].recall, rep["2"].f1, rep["2"].support) == (0, 0, 0, 0)
    assert rep["accuracy"].f1 == round(2 / 3, 6)
    assert metrics.confusion(df, "t", "p", range(3)).count() == 9
    s = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1)], "y int, s double")
    assert metrics.micro_auc(s, "y", "s").first().auc == 0.625


def test_interval_join(spark):
    left = spark.createDataFrame([(1, "a", 100), (2, "a", 161), (3, "b", 100), (4, "a", 40)], "i int, k string, t long")
    right = spark.createDataFrame([("a", 100), ("b", 0), ("a", None)], "k string, t long")
    assert {r.i for r in joins.interval_semi_join(left, right, ["k"], "t", "t", 60).collect()} == {1, 4}


@pytest.mark.parametrize("block", [4_096, 20])
def test_contrastive_loss_of_whole_table(spark, block):
    r = np.random.default_rng(5)
    x, y = r.normal(size=(90, 4)), [None if i % 11 == 0 else int(i % 5) for i in range(89)] + [99]
    df = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, y, strict=True))], "i long, v array<double>, label int").repartition(5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s, losses = u @ u.T / 0.1, []
    for a in range(90):
        rest = [b for b in range(90) if b != a]
        mates = [b for b in rest if y[a] is not None and y[a] == y[b]]
        if mates:
            losses.append(np.log(np.exp(s[a, rest]).sum()) - s[a, mates].mean())
    got = vectors.contrastive_loss(df, "v", "label", "i", block=block).first()
    assert got.anchors == len(losses) and abs(got.loss - np.mean(losses)) < 2e-6


def test_contrastive_loss_above_20_000_rows(spark):
    # all vectors equal: each anchor's loss is the logarithm of the number of other rows
    df = spark.range(20_001).selectExpr("id", "array(1.0D, 0.0D) AS v", "1 AS label")
    got = vectors.contrastive_loss(df, "v", "label", "id").first()
    assert got.anchors == 20_001 and abs(got.loss - np.log(20_000)) < 2e-6


@pytest.mark.parametrize("temperature", [0.1, 0.001])
def test_sums_of_two_blocks_for_the_anchors_of_both(temperature):
    """A pair of blocks is multiplied once; a small temperature needs its greatest similarities."""
    r = np.random.default_rng(8)
    v, y = r.normal(size=(50, 4)), r.integers(0, 3, 50)
    block = lambda a, e, *ab: pa.table({"id": pa.array(range(a, e)), "v": pa.array(v[a:e].tolist()), "label": pa.array(y[a:e]), "row": pa.array(range(a, e), pa.int64()), "a": pa.array([ab[0]] * (e - a)), "b": pa.array([ab[1]] * (e - a))})
    got = vectors._log_sums(temperature)(block(0, 20, 0, 1), block(20, 50, 0, 1)).to_pylist()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T / temperature
    assert [x["anchor"] for x in got] == list(range(50))
    for x in got:
        i = x["anchor"]
        rest = np.arange(20, 50) if i < 20 else np.arange(20)
        mates = rest[y[rest] == y[i]]
        top = s[i, rest].max()
        assert x["top"] + np.log(x["total"]) == pytest.approx(top + np.log(np.exp(s[i, rest] - top).sum()))
        assert (x["partners"], x["same"]) == (len(mates), pytest.approx(s[i, mates].sum()))
