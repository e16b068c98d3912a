"""Multiclass gradient boosting on histograms, with early stop.

Features are cut into quantile bins once.  A round adds a tree per class
(softmax objective); a level of all of them is one pass of the table: tasks sum
gradients and hessians by node, feature and bin, groups of one (class, node,
feature) add those up and find their best split, and one row per node comes to
the driver.  Gradients are whole numbers of 2^-30, so sums, and with them trees,
do not depend on partitions.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Gradients and hessians are handled in this fraction.
UNIT = float(1 << 30)
#: Rounds after which scores are written anew, so that a pass applies few trees.
REWRITE = 10


class Trees:
    """The model: bin edges per feature, and per round a tree per class.

    A tree is a heap of nodes: node i has children 2 i + 1 and 2 i + 2,
    ``feature`` -1 marks a leaf, rows of a bin up to ``bin`` go left, missing
    values (bin 0) always do.
    """

    def __init__(self, features: list[str], classes: int, edges: list[list[float]], depth: int):
        self.features, self.classes, self.edges, self.depth = features, classes, edges, depth
        self.rounds: list[list[dict]] = []
        self.losses: list[float] = []

    def bins(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(values.shape, np.uint8)
        for j, e in enumerate(self.edges):
            x = values[:, j]
            known = ~np.isnan(x)
            out[known, j] = np.searchsorted(np.array(e), x[known], side="left") + 1
        return out

    def blank(self) -> dict:
        n = 2 ** (self.depth + 1) - 1
        return {"feature": np.full(n, -1), "bin": np.zeros(n, np.int64), "value": np.zeros(n)}

    def nodes(self, tree: dict, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for _ in range(self.depth):
            f = tree["feature"][at]
            inner = f >= 0
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > tree["bin"][at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at

    def scores(self, bins: np.ndarray, rounds: list[list[dict]] | None = None) -> np.ndarray:
        out = np.zeros((len(bins), self.classes))
        for trees in self.rounds if rounds is None else rounds:
            for c, t in enumerate(trees):
                out[:, c] += t["value"][self.nodes(t, bins)]
        return out

    def to_json(self) -> str:
        trees = [[{k: v.tolist() for k, v in t.items()} for t in r] for r in self.rounds]
        return json.dumps({"features": self.features, "classes": self.classes, "edges": self.edges, "depth": self.depth, "rounds": trees, "losses": self.losses})

    @classmethod
    def from_json(cls, text: str) -> Trees:
        d = json.loads(text)
        out = cls(d["features"], d["classes"], d["edges"], d["depth"])
        out.rounds = [[{k: np.array(v) for k, v in t.items()} for t in r] for r in d["rounds"]]
        out.losses = d["losses"]
        return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(scores: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of the log loss, in whole units."""
    p = softmax(scores)
    y = np.zeros_like(p)
    y[np.arange(len(p)), label] = 1
    return np.rint(weight[:, None] * (p - y) * UNIT), np.rint(weight[:, None] * p * (1 - p) * UNIT)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, reg: float, least: int) -> tuple[float, int]:
    """Gain and bin of the best split of one feature's sums by bin; gain 0 if none; ties to the lowest bin."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gt, ht, nt = g.sum(), h.sum(), n.sum()
    gain = gl * gl / (hl + reg) + (gt - gl) ** 2 / (ht - hl + reg) - gt * gt / (ht + reg)
    gain[(nl < least) | (nt - nl < least)] = 0
    at = int(gain.argmax()) if len(gain) else 0
    return (float(gain[at]), at) if len(gain) and gain[at] > 1e-9 else (0.0, 0)


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _scored(model: Trees, batch: pa.RecordBatch, recent: list[list[dict]]):
    bins = _unpacked(batch.column("bins"), len(model.features))
    scores = np.array(batch.column("scores").to_pylist(), np.float64).reshape(len(bins), model.classes)
    return bins, scores + model.scores(bins, recent)


def _histograms(shared, level: int, most: int):
    def run(batches):
        model, recent, growing = shared.value
        first, many, width = 2**level - 1, 2**level, len(model.features)
        total = None
        for batch in batches:
            bins, scores = _scored(model, batch, recent)
            g, h = gradients(scores, batch.column("label").to_numpy(), batch.column("weight").to_numpy())
            if total is None:
                total = np.zeros((model.classes, many, width, 3, most))
            for c, tree in enumerate(growing):
                node = model.nodes(tree, bins) - first
                here = np.flatnonzero((node >= 0) & (node < many))  # others rest in leaves above
                for j in range(width):
                    at = node[here] * most + bins[here, j]
                    for s, w in enumerate((g[here, c], h[here, c], None)):
                        total[c, :, j, s] += np.bincount(at, w, many * most).reshape(many, most)
        if total is not None:
            c, node, j = np.nonzero(total[:, :, :, 2].any(axis=3))
            yield pa.record_batch({"class": pa.array(c, pa.int32()), "node": pa.array(node + first, pa.int32()), "feature": pa.array(j, pa.int32()), "sums": pa.array([total[a, b, f].astype(np.int64).tobytes() for a, b, f in zip(c, node, j, strict=True)], pa.binary())})

    return run


def _splits(reg: float, least: int, most: int):
    def run(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x, np.int64).reshape(3, most) for x in table["sums"].to_pylist())
        g, h = sums[0] / UNIT, sums[1] / UNIT
        gain, at = best_split(g, h, sums[2], reg, least)
        one = table.slice(0, 1)
        return pa.table({"class": one["class"], "node": one["node"], "feature": one["feature"], "gain": pa.array([gain]), "bin": pa.array([at], pa.int32()), "g": pa.array([g.sum()]), "h": pa.array([h.sum()])})

    return run


def _losses(shared):
    def run(batches):
        model, recent = shared.value
        loss = n = 0.0
        for batch in batches:
            _, scores = _scored(model, batch, recent)
            p, w = softmax(scores), batch.column("weight").to_numpy()
            loss -= float((np.log(np.maximum(p[np.arange(len(p)), batch.column("label").to_numpy()], 1e-15)) * w).sum())
            n += float(w.sum())
        yield pa.record_batch({"loss": pa.array([loss]), "n": pa.array([n])})

    return run


_CODED = "label int, weight double, valid boolean, bins binary, scores array<double>"


def _coded(df: DataFrame, model: Trees, label: str, weight: str | None, valid) -> DataFrame:
    cols = [F.col(label).cast("int").alias("label"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), F.coalesce(valid, F.lit(False)).alias("valid"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(model.features)]]
    k = model.classes

    def run(batches):
        for b in batches:
            x = np.stack([b.column(3 + i).fill_null(float("nan")).to_numpy(zero_copy_only=False) for i in range(len(model.features))], 1)
            packed = [r.tobytes() for r in model.bins(x)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(packed, pa.binary()), pa.array([[0.0] * k] * len(packed), pa.list_(pa.float64()))], names=["label", "weight", "valid", "bins", "scores"])

    return written(df.where(F.col(label).isNotNull()).select(cols).mapInArrow(run, _CODED), "binned")


def quantile_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Up to ``bins - 1`` cuts of each feature; a row comes to the driver."""
    shares = [i / bins for i in range(1, bins)]
    known = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    r = df.agg(*[F.percentile_approx(known(f), shares, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(r[f"q{i}"] or [])) for i in range(len(features))]


def fit_boosted(df: DataFrame, features: list[str], label: str, classes: int, valid=None, weight: str | None = None, rounds: int = 2_000, depth: int = 6, bins: int = 64, rate: float = 0.1, reg: float = 1.0, least: int = 20, patience: int = 100) -> Trees:
    """Boosted trees from the rows of ``df`` where ``valid`` (a boolean column) is not true.

    The others measure the loss after every round; fitting stops ``patience``
    rounds after the least loss, and rounds behind it are dropped.  Without
    ``valid`` all rounds run.  Rows without a label are left out, labels are 0
    to ``classes - 1``; a missing value (null, NaN) goes left at every split.
    """
    if not 2 <= bins <= 255:
        raise ValueError("2 to 255 bins")
    spark, held = df.sparkSession, F.lit(False) if valid is None else valid
    learn = df.where(~F.coalesce(held, F.lit(False)))
    model = Trees(list(features), classes, quantile_edges(learn, features, bins), depth)
    most = max(len(e) for e in model.edges) + 2 if model.edges else 2
    coded = _coded(df, model, label, weight, held)
    recent: list[list[dict]] = []
    best, best_at = np.inf, 0
    for r in range(rounds):
        growing = [model.blank() for _ in range(classes)]
        for level in range(depth + 1):
            shared = spark.sparkContext.broadcast((model, recent, growing))
            sums = coded.where("not valid").mapInArrow(_histograms(shared, level, most), "class int, node int, feature int, sums binary")
            one = sums.groupBy("class", "node", "feature").applyInArrow(_splits(reg, least, most), "class int, node int, feature int, gain double, bin int, g double, h double")
            top = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "g", "h")).alias("s")
            found, split = one.groupBy("class", "node").agg(top).collect(), False
            for x in found:
                tree, s = growing[x["class"]], x["s"]
                tree["value"][x["node"]] = -rate * s["g"] / (s["h"] + reg)
                if s["gain"] > 0 and level < depth:
                    tree["feature"][x["node"]], tree["bin"][x["node"]], split = -s["f"], -s["b"], True
            if not split:
                break
        model.rounds.append(growing)
        recent.append(growing)
        if valid is not None:
            shared = spark.sparkContext.broadcast((model, recent))
            s = coded.where("valid").mapInArrow(_losses(shared), "loss double, n double").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
            model.losses.append(s["loss"] / s["n"] if s["n"] else 0.0)
            if model.losses[-1] < best - 1e-12:
                best, best_at = model.losses[-1], r
            elif r - best_at >= patience:
                break
        if len(recent) >= REWRITE:
            shared, ddl = spark.sparkContext.broadcast((model, recent)), _CODED
            coded, recent = written(coded.mapInArrow(_rewrite(shared), ddl), "scores"), []
    if valid is not None:
        model.rounds = model.rounds[: best_at + 1]
    return model


def _rewrite(shared):
    def run(batches):
        model, recent = shared.value
        for b in batches:
            _, scores = _scored(model, b, recent)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(scores.tolist(), pa.list_(pa.float64()))], names=["label", "weight", "valid", "bins", "scores"])

    return run


def predict_boosted(df: DataFrame, model: Trees) -> DataFrame:
    """Adds ``scores`` (class probabilities), ``pred_label`` (ties to the smallest) and ``confidence``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    wide = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in model.features])

    @F.pandas_udf("array<double>")
    def chances(rows):
        import pandas as pd

        m = shared.value
        x = np.array(rows.tolist(), np.float64).reshape(len(rows), len(m.features))
        return pd.Series(softmax(m.scores(m.bins(x))).tolist())

    out = df.withColumn("scores", chances(wide))
    top = F.array_max("scores")
    return out.withColumn("pred_label", (F.array_position("scores", top) - 1).cast("int")).withColumn("confidence", top)
