"""Vector operators: scaling, PCA, nearest neighbours, contrastive loss, reducer."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .neighbours import knn, matrix, vectors_of

#: Rows of a block of anchors, and a side of the square of similarities in memory at once.
LOSS_BLOCK, SIDE = 16_384, 1_024
#: Similarities are at most 1; up to this many times them, their exponentials need no common factor.
PLAIN = 300.0


def moments(df: DataFrame, vec: str) -> DataFrame:
    """Mean and population deviation per dimension."""
    return df.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def standardize(df: DataFrame, vec: str, out: str = "scaled") -> DataFrame:
    """Centred and divided by the population deviation (1 where it is 0); the moments are one row."""
    m = moments(df, vec).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("_m"))
    scale = lambda x, s: (x - s["mean"]) / F.when(s["std"] > 0, s["std"]).otherwise(1.0)
    return df.crossJoin(F.broadcast(m)).withColumn(out, F.zip_with(vec, "_m", scale)).drop("_m")


def pca(df: DataFrame, vec: str, k: int, out: str = "reduced") -> tuple[DataFrame, np.ndarray]:
    """Centred projection on the first ``k`` axes (not more than dimensions or rows); null and NaN elements count as 0.

    One pass sums outer products per batch of rows; only that d by d table
    comes to the driver.  An axis points so that its largest part is positive.
    """
    clean = F.transform(vec, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x.cast("double")))
    rows = df.withColumn("_v", clean)

    def sums(batches):
        total = None
        for b in batches:
            x = np.array(b.column(0).to_pylist(), np.float64)
            if len(x):
                x = np.hstack([np.ones((len(x), 1)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.record_batch({"g": pa.array([total.ravel().tolist()])})

    got = rows.select("_v").mapInArrow(sums, "g array<double>").select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    d = int(np.sqrt(len(got)))
    if d < 2:
        return rows.withColumn(out, F.array().cast("array<double>")).drop("_v"), np.zeros((0, 0))
    g = np.zeros(d * d)
    for r in got:
        g[r.i] = r.x
    g = g.reshape(d, d)
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    w, axes = np.linalg.eigh(g[1:, 1:] / n - np.outer(mean, mean))
    axes = axes[:, np.argsort(-w)[: min(k, d - 1, int(n))]].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    shift = axes @ mean
    parts = [F.aggregate(F.zip_with("_v", F.array(*[F.lit(float(x)) for x in a]), lambda p, q: p * q), F.lit(float(-s)), lambda t, x: t + x) for a, s in zip(axes, shift, strict=True)]
    return rows.withColumn(out, F.array(*parts)).drop("_v"), axes


def knn_classify(queries: DataFrame, base: DataFrame, vec: str, id_col: str, label: str, k: int = 5) -> DataFrame:
    """Majority label of the ``k`` nearest base rows, ties to the smallest label."""
    from .metrics import majority_vote

    near = knn(queries, base, vec, id_col, k)
    return majority_vote(near.join(base.select(F.col(id_col).alias("neighbour_id"), F.col(label).alias("pred_label")), "neighbour_id"), "query_id", "pred_label")


def contrastive_loss(df: DataFrame, vec: str, label: str, id_col: str, temperature: float = 0.1, block: int = LOSS_BLOCK, class_weighted: bool = False) -> DataFrame:
    """Supervised contrastive loss over all rows: mean over anchors that have a partner of their label.

    With ``class_weighted`` every anchor weighs as the inverse of its label's rows.

    Rows are dealt into blocks by id; every pair of blocks is a task that
    multiplies two bounded matrices once and gives sums for the anchors of both,
    which are merged.  No pair is a row and no row comes to the driver.  Rows of
    one id are never compared; a null label has no partner; rows without a
    vector are left out.
    """
    rows = df.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), vectors_of(df, vec).alias("v"), F.col(label).alias("label"))
    parts = max(1, -(-rows.count() // block))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), "anchors")
    left = rows.withColumnRenamed("part", "a").withColumn("b", F.explode(F.sequence("a", F.lit(parts - 1))))
    right = rows.withColumnRenamed("part", "b").withColumn("a", F.explode(F.sequence(F.lit(0), "b")))
    out = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_log_sums(temperature), "anchor long, top double, total double, same double, partners long")
    per = out.groupBy("anchor").agg(F.collect_list(F.struct("top", "total")).alias("s"), F.sum("same").alias("same"), F.sum("partners").alias("m")).where("m > 0")
    top = F.array_max(F.transform("s", lambda x: x["top"]))
    total = F.aggregate("s", F.lit(0.0), lambda t, x: t + x["total"] * F.exp(x["top"] - F.col("top")))
    loss = per.withColumn("top", top).select("anchor", (F.col("top") + F.log(total) - F.col("same") / F.col("m")).alias("l"))
    if class_weighted:
        share = rows.groupBy("label").agg((1 / F.count(F.lit(1))).alias("w"))
        loss = loss.join(rows.select(F.col("row").alias("anchor"), "label"), "anchor").join(share, "label")
        return loss.agg(F.coalesce(F.round(F.sum(F.col("l") * F.col("w")) / F.sum("w"), 6), F.lit(0.0)).alias("loss"), F.count(F.lit(1)).alias("anchors"))
    return loss.agg(F.coalesce(F.round(F.avg("l"), 6), F.lit(0.0)).alias("loss"), F.count(F.lit(1)).alias("anchors"))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _add_exp(top: np.ndarray, total: np.ndarray, s: np.ndarray) -> None:
    """Rows' further similarities into their greatest and the sum of exponentials below it."""
    new = np.maximum(top, s.max(1))
    ok = np.isfinite(new)
    total[ok] = total[ok] * np.exp(top[ok] - new[ok]) + np.exp(s[ok] - new[ok, None]).sum(1)
    top[:] = new


def _partners(q: np.ndarray, y: np.ndarray, x: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``q`` the sum and number of similarities to rows of ``x`` of its label: products with the labels' sums. Labels below 0 have none."""
    n = int(max(y.max(), by.max(), 0)) + 1
    sums, known = np.zeros((n, x.shape[1])), by >= 0
    np.add.at(sums, by[known], x[known])
    count = np.bincount(by[known], minlength=n)
    return np.where(y >= 0, (q * sums[y]).sum(1), 0.0), np.where(y >= 0, count[y], 0)


def _log_sums(temperature: float):
    """Of a pair of blocks, for the anchors of both: greatest similarity, sum of exponentials below it, sum and number of partners' similarities.

    Rows of one id are in one block, so only a block's pair with itself looks for them.
    """
    plain = 1 / temperature <= PLAIN

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"anchor": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in ("top", "total", "same")}, "partners": pa.array([], pa.int64())})
        itself = left["a"][0].as_py() == left["b"][0].as_py()
        labels = {}
        y, by = (np.array([-1 if x is None else labels.setdefault(x, len(labels)) for x in t["label"].to_pylist()]) for t in (left, right))
        q, x = _unit(matrix(left["v"])) / temperature, _unit(matrix(right["v"]))
        same, partners = _partners(q, y, x, by)
        top, total = (np.full(len(q), 0.0 if plain else -np.inf), np.full(len(x), 0.0 if plain else -np.inf)), (np.zeros(len(q)), np.zeros(len(x)))
        if itself:
            ids = {}
            own, other = (np.array([ids.setdefault(v, len(ids)) for v in t["id"].to_pylist()]) for t in (left, right))
        for i in range(0, len(q), SIDE):
            for j in range(0, len(x), SIDE):
                s = q[i : i + SIDE] @ x[j : j + SIDE].T
                if itself:
                    k, m = np.nonzero(own[i : i + SIDE, None] == other[None, j : j + SIDE])
                    pair = (y[i + k] == by[j + m]) & (y[i + k] >= 0)
                    np.subtract.at(same, i + k[pair], s[k[pair], m[pair]])
                    np.subtract.at(partners, i + k[pair], 1)
                    s[k, m] = -np.inf
                if plain:
                    np.exp(s, out=s)
                    total[0][i : i + SIDE] += s.sum(1)
                    total[1][j : j + SIDE] += s.sum(0)
                else:
                    _add_exp(top[0][i : i + SIDE], total[0][i : i + SIDE], s)
                    _add_exp(top[1][j : j + SIDE], total[1][j : j + SIDE], s.T)
        found = [(left["row"], top[0], total[0], same, partners)]
        if not itself:
            found.append((right["row"], top[1], total[1], *_partners(x / temperature, by, q * temperature, y)))
        return pa.concat_tables([_sums(*f) for f in found])

    return run


def _sums(row: pa.ChunkedArray, top: np.ndarray, total: np.ndarray, same: np.ndarray, partners: np.ndarray) -> pa.Table:
    ok = np.flatnonzero(total > 0)
    return pa.table({"anchor": row.combine_chunks().take(pa.array(ok)), "top": pa.array(top[ok]), "total": pa.array(total[ok]), "same": pa.array(same[ok]), "partners": pa.array(partners[ok].astype(np.int64))})


class Reducer:
    """A linear reducer: one map, used both ways, fitted with labels to values in memory.

    ``fit`` minimises reconstruction plus supervised contrastive loss by
    gradient descent; ``transform`` runs the map over a DataFrame with the
    weights broadcast.  :mod:`.reducer` has the network trained over Spark.
    """

    FORMAT = 2

    def __init__(self, latent: int = 64, seed: int = 7, epochs: int = 30, batch: int = 128, rate: float = 0.01, temperature: float = 0.1, weight: float = 0.1, patience: int = 5):
        self.cfg = dict(latent=latent, seed=seed, epochs=epochs, batch=batch, rate=rate, temperature=temperature, weight=weight, patience=patience)
        self.columns: list[str] | None = None

    def fit(self, values, labels, columns, val_values=None, val_labels=None) -> Reducer:
        x, y = np.asarray(values, np.float64), np.asarray(labels)
        if x.ndim != 2 or x.shape[1] != len(columns) or len(x) != len(y) or not np.isfinite(x).all():
            raise ValueError("values must be finite, one row per label, one column per name")
        c, rng = self.cfg, np.random.default_rng(self.cfg["seed"])
        self.columns, self.mean, self.std = list(columns), x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        z = (x - self.mean) / self.std
        v = None if val_values is None else (np.asarray(val_values, np.float64) - self.mean) / self.std
        self.w = np.linalg.svd(z, full_matrices=False)[2][: c["latent"]].T.copy()
        if self.w.shape[1] < c["latent"]:
            self.w = np.hstack([self.w, rng.normal(0, 0.01, (x.shape[1], c["latent"] - self.w.shape[1]))])
        share = 1.0 / np.bincount(np.unique(y, return_inverse=True)[1])[np.unique(y, return_inverse=True)[1]]
        share /= share.sum()
        best, kept, bad = np.inf, self.w.copy(), 0
        for _ in range(c["epochs"]):
            for _ in range(max(1, len(z) // c["batch"])):
                pick = rng.choice(len(z), min(c["batch"], len(z)), p=share)
                _, g = self._loss(z[pick], y[pick])
                self.w -= c["rate"] * g * min(1.0, 5.0 / max(np.linalg.norm(g), 1e-12))
            loss = self._loss(z if v is None else v, y if v is None else np.asarray(val_labels))[0]
            if loss < best - 1e-6:
                best, kept, bad = loss, self.w.copy(), 0
            else:
                bad += 1
                if bad >= c["patience"]:
                    break
        self.w = kept
        return self

    def _loss(self, z, y):
        c, h = self.cfg, z @ self.w
        miss = h @ self.w.T - z
        grad = 2 * (z.T @ (miss @ self.w) + miss.T @ h) / z.size
        norm = np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-9)
        u = h / norm
        s = u @ u.T / c["temperature"]
        np.fill_diagonal(s, -np.inf)
        e = np.exp(s - s.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        same = (y[:, None] == y[None]) & ~np.eye(len(y), dtype=bool)
        m = same.sum(1, keepdims=True)
        log = np.log(np.maximum(p, 1e-300))
        loss = float((miss**2).mean()) - c["weight"] * float((np.where(same, log, 0).sum(1)[m[:, 0] > 0] / m[m > 0]).mean() if (m > 0).any() else 0)
        ds = np.where(m > 0, p - same / np.maximum(m, 1), 0) / max(1, int((m > 0).sum())) / c["temperature"]
        du = (ds + ds.T) @ u
        dh = (du - u * (du * u).sum(1, keepdims=True)) / norm
        return loss, grad + c["weight"] * z.T @ dh

    def encode(self, values) -> np.ndarray:
        return (np.asarray(values, np.float64) - self.mean) / self.std @ self.w

    def transform(self, df: DataFrame, columns, out: str = "reduced") -> DataFrame:
        """Adds the reduced vector; the columns must be those of the fit, in order."""
        if list(columns) != self.columns:
            raise ValueError("columns differ from those the reducer was fitted on")
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def encode(v: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.encode(np.array(v.tolist(), np.float64))))

        return df.withColumn(out, encode(F.array(*[F.col(c).cast("double") for c in columns])))

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"format": self.FORMAT, "cfg": self.cfg, "columns": self.columns, "mean": self.mean.tolist(), "std": self.std.tolist(), "w": self.w.tolist()}, f)

    @classmethod
    def load(cls, path: str) -> Reducer:
        with open(path) as f:
            d = json.load(f)
        if d.get("format") != cls.FORMAT:
            raise ValueError("unknown reducer format")
        out = cls(**d["cfg"])
        out.columns, out.mean, out.std, out.w = d["columns"], np.array(d["mean"]), np.array(d["std"]), np.array(d["w"])
        return out
