"""The contrastive autoencoder: gradients, training over Spark, files."""

import numpy as np
import pytest

from netquill.operators import reducer

CFG = {"latent_dim": 4, "hidden_dims": [16, 8], "proj_dim": 4, "batch_size": 16, "epochs": 2, "seed": 7}
NAMES = [f"feat_{i}" for i in range(12)]


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(1)
    net = reducer.Network(5, {**reducer.DEFAULTS, **CFG, "hidden_dims": [7, 6], "dropout": 0.3})
    x, y = r.normal(size=(9, 5)), np.array([0, 0, 1, 1, 2, 2, 0, 1, 3])
    rng = lambda: np.random.default_rng(3)  # noqa: E731  the same dropout each time
    _, grad = net.loss(x, y, rng())
    w, g = reducer.flat(net.weights), reducer.flat(grad)
    assert len(w) == len(g)
    for i in r.choice(len(w), 120, replace=False):
        step = np.zeros_like(w)
        step[i] = 1e-6
        up, down = (reducer.Network(5, net.cfg, reducer.unflat(w + s * step, net.weights)).loss(x, y, rng(), False)[0] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)


def test_contrastive_loss_by_hand():
    z, y, t = np.random.default_rng(2).normal(size=(6, 3)), np.array([0, 0, 1, 1, 1, 5]), 0.2
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    each = []
    for i in range(6):
        others = [j for j in range(6) if j != i]
        mates = [j for j in others if y[j] == y[i]]
        if mates:
            z_i = np.log(sum(np.exp(u[i] @ u[j] / t) for j in others))
            each.append(-np.mean([u[i] @ u[j] / t - z_i for j in mates]))
    assert reducer.contrastive(z, y, t)[0] == pytest.approx(np.mean(each))
    assert reducer.contrastive(z[:2], np.array([0, 1]), t)[0] == 0


def test_weighted_anchors():
    r = np.random.default_rng(4)
    z, y, t = r.normal(size=(8, 3)), np.array([0, 0, 0, 0, 1, 1, 2, 2]), 0.3
    w = reducer.class_weights([4, 2, 2])
    assert w == pytest.approx([0.6, 1.2, 1.2])
    one = [reducer.contrastive(z, y, t, np.eye(3)[k])[0] for k in range(3)]  # the mean over one class's anchors
    share = w * [4, 2, 2] / (w * [4, 2, 2]).sum()
    assert reducer.contrastive(z, y, t, w)[0] == pytest.approx(np.dot(one, share))
    assert reducer.contrastive(z, y, t, np.ones(3))[0] == pytest.approx(reducer.contrastive(z, y, t)[0])
    _, grad = reducer.contrastive(z, y, t, w)
    for i in range(z.size):
        step = np.zeros(z.size)
        step[i] = 1e-6
        up, down = (reducer.contrastive(z + s * step.reshape(z.shape), y, t, w)[0] for s in (1, -1))
        assert grad.ravel()[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-7)


def test_settings_of_epochs():
    model = reducer.SupConReducer(epochs=5, learning_rate=0.1, schedule="cosine", contrastive_weight=1.0, contrastive_weight_end=3.0)
    rates, weights = zip(*(model.settings(e) for e in range(5)), strict=True)
    assert rates == pytest.approx([0.1 * (1 + np.cos(np.pi * e / 5)) / 2 for e in range(5)])
    assert weights == pytest.approx([1, 1.5, 2, 2.5, 3])
    assert reducer.SupConReducer(learning_rate=0.2).settings(7) == (0.2, 1.0)
    with pytest.raises(ValueError, match="schedule"):
        reducer.SupConReducer(schedule="steps")


def test_variants_train_and_are_stored(spark, tmp_path):
    train, val = frames(spark)
    cfg = {**CFG, "class_weighted": True, "schedule": "cosine", "contrastive_weight_end": 2.0, "dropout": 0.0}
    fit = reducer.SupConReducer(**cfg).fit(train.where("label > 0 or flow_uid < 'f3'"), val, NAMES)
    assert np.isfinite(fit.history).all()
    fit.save(spark, str(tmp_path / "m"))
    assert reducer.SupConReducer.load(spark, str(tmp_path / "m")).cfg == fit.cfg


def frames(spark, per=20):
    r = np.random.default_rng(42)

    def make(n, start):
        return [(f"f{start + i}", *(r.normal(size=12) + 0.4 * (i % 3)).tolist(), i % 3) for i in range(n)]

    ddl = "flow_uid string, " + ", ".join(f"{c} double" for c in NAMES) + ", label int"
    return spark.createDataFrame(make(3 * per, 0), ddl), spark.createDataFrame(make(18, 1000), ddl)


def test_fit_transform_and_files(spark, tmp_path):
    train, val = frames(spark)
    one = reducer.SupConReducer(**CFG).fit(train.repartition(3), val, NAMES)
    assert len(one.history) == 2 and np.isfinite(one.history).all()
    again = reducer.SupConReducer(**CFG).fit(train.repartition(2), val, NAMES)
    assert np.allclose(reducer.flat(one.net.weights), reducer.flat(again.net.weights))  # whatever the partitions
    out = one.transform(val, NAMES).orderBy("flow_uid").collect()
    assert len(out) == 18 and all(len(x["reduced"]) == 4 for x in out)
    one.save(spark, str(tmp_path / "model"))
    back = reducer.SupConReducer.load(spark, str(tmp_path / "model")).transform(val, NAMES).orderBy("flow_uid").collect()
    assert [x["reduced"] for x in back] == [x["reduced"] for x in out]
    with pytest.raises(ValueError, match="columns differ"):
        one.transform(val, NAMES[::-1])
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "part.txt").write_text('{"input_dim": 12, "cfg": {}}')
    with pytest.raises(ValueError, match="format"):
        reducer.SupConReducer.load(spark, str(tmp_path / "old"))


def test_loss_falls_and_refusals(spark):
    train, val = frames(spark)
    fit = reducer.SupConReducer(**{**CFG, "epochs": 5, "learning_rate": 0.01, "dropout": 0.0}).fit(train, val, NAMES)
    assert fit.history[-1][0] < fit.history[0][0]
    with pytest.raises(ValueError, match="classes"):
        reducer.SupConReducer(**CFG).fit(train.where("label < 2"), val, NAMES)
    with pytest.raises(ValueError, match="finite"):
        reducer.SupConReducer(**CFG).fit(train.withColumn("feat_3", train["feat_3"] * float("nan")), val, NAMES)
    with pytest.raises(ValueError, match="unknown"):
        reducer.SupConReducer(latent=3)
