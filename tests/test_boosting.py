"""Boosting over Spark against one that walks rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquill.operators import boosting


def rows(seed, n=240, width=4, classes=3):
    r = np.random.default_rng(seed)
    y = r.integers(0, classes, n)
    x = r.normal(0, 1, (n, width)).round(2)
    x[:, 0] += y
    x[:, 1] -= y * (r.random(n) < 0.7)
    x[r.random((n, width)) < 0.05] = np.nan
    return x, y


def frame(spark, x, y):
    data = [(i, *[None if np.isnan(v) and (i + j) % 2 else float(v) for j, v in enumerate(row)], int(c)) for i, (row, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data + [(len(data), *[0.0] * x.shape[1], None)], "i long, " + ", ".join(f"x{j} double" for j in range(x.shape[1])) + ", y int")


def plain(x, y, edges, classes, rounds, depth, rate, reg, least):
    """Trees grown node by node from lists of rows; the value of every row."""
    bins = np.array([[0 if np.isnan(v) else sum(c < v for c in e) + 1 for v, e in zip(row, edges, strict=True)] for row in x])
    scores = np.zeros((len(x), classes))
    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        new = np.zeros_like(scores)
        for c in range(classes):
            g, h = p[:, c] - (y == c), p[:, c] * (1 - p[:, c])

            def grow(own, level, c=c, g=g, h=h):
                new[own, c] = -rate * g[own].sum() / (h[own].sum() + reg)
                best = (1e-9, None)
                for j in range(x.shape[1]):
                    for b in range(bins.max() + 1):
                        left, right = own[bins[own, j] <= b], own[bins[own, j] > b]
                        if min(len(left), len(right)) >= least:
                            part = lambda s: g[s].sum() ** 2 / (h[s].sum() + reg)
                            gain = part(left) + part(right) - part(own)
                            if gain > best[0] + 1e-7:
                                best = (gain, left, right)
                if level < depth and best[1] is not None:
                    grow(best[1], level + 1)
                    grow(best[2], level + 1)

            grow(np.arange(len(x)), 0)
        scores += new
    return scores


def test_against_rows(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REWRITE", 2)
    x, y = rows(1)
    df = frame(spark, x, y).repartition(3)
    names = [f"x{j}" for j in range(4)]
    model = boosting.fit_boosted(df, names, "y", 3, rounds=3, depth=2, bins=8, rate=0.3, reg=1.0, least=5)
    want = plain(x, y, model.edges, 3, 3, 2, 0.3, 1.0, 5)
    got = np.array([r["scores"] for r in boosting.predict_boosted(df.where("y is not null"), model).orderBy("i").collect()])
    assert np.allclose(got, np.exp(want) / np.exp(want).sum(1, keepdims=True), atol=1e-6)
    again = boosting.Trees.from_json(boosting.fit_boosted(df.repartition(5), names, "y", 3, rounds=1, depth=2, bins=8, rate=0.3, least=5).to_json())
    assert all((a[k] == b[k]).all() for a, b in zip(again.rounds[0], model.rounds[0], strict=True) for k in a)


def test_early_stop(spark):
    x, y = rows(2, 120)
    y[60:] = np.random.default_rng(3).permutation(y[60:])  # nothing to learn for the rows that measure
    df = frame(spark, x, y)
    model = boosting.fit_boosted(df, [f"x{j}" for j in range(4)], "y", 3, valid=F.col("i") >= 60, rounds=12, depth=2, bins=6, rate=0.9, least=3, patience=2)
    assert len(model.losses) < 12 and len(model.rounds) == int(np.argmin(model.losses)) + 1
    found = boosting.predict_boosted(df.where("i < 60"), model)
    assert found.where("pred_label = y").count() > 30 and found.where("confidence < 1/3 or confidence > 1").count() == 0


def test_one_row_and_refusals(spark):
    df = spark.createDataFrame([(1.0, 0)], "a double, y int")
    model = boosting.fit_boosted(df, ["a"], "y", 2, rounds=1, depth=1, bins=4, least=1)
    assert boosting.predict_boosted(df, model).first()["pred_label"] == 0
    with pytest.raises(ValueError, match="bins"):
        boosting.fit_boosted(df, ["a"], "y", 2, bins=300)
