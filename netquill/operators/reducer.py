"""Supervised contrastive autoencoder over DataFrames.

Encoder and decoder are layers with normalisation, ReLU and dropout between, a
projector feeds the contrastive loss.  Training is data-parallel: an epoch deals
the rows, drawn with equal weight a class, into groups of ``batch`` rows by
hash; a step is a Spark job over some groups, each of which returns the gradient
of its own batch.  Gradients are added up in a few groups before they reach the
driver, which holds the weights and takes the optimiser's step; rows never leave
the executors.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written

#: Defaults of the model and its training.
DEFAULTS = {
    "latent_dim": 64,
    "hidden_dims": [256, 128],
    "proj_dim": 64,
    "dropout": 0.1,
    "temperature": 0.1,
    "reconstruction_weight": 1.0,
    "contrastive_weight": 1.0,
    "learning_rate": 1e-3,
    "weight_decay": 1e-5,
    "batch_size": 256,
    "epochs": 30,
    "early_stopping_patience": 5,
    "min_delta": 1e-4,
    "balance_classes": True,
    "seed": 42,
    # variants: anchors weighted by class, a falling rate, a contrastive weight that moves in a line over the epochs
    "class_weighted": False,
    "schedule": "constant",
    "contrastive_weight_end": None,
}
SCHEDULES = ("constant", "cosine")
FORMAT = 2
CLIP = 5.0
#: Batches of one step, and groups their gradients are added up in before the driver.
GROUPS_A_STEP, SUMS = 64, 8
EPS = 1e-5


class Stack:
    """Linear layers; all but the last are followed by normalisation, ReLU and dropout, or by ReLU alone."""

    def __init__(self, name: str, dims: list[int], norm: bool = True):
        self.name, self.dims, self.norm = name, dims, norm

    def initial(self, rng: np.random.Generator) -> dict[str, np.ndarray]:
        out = {}
        for i, (a, b) in enumerate(zip(self.dims[:-1], self.dims[1:], strict=True)):
            r = 1 / np.sqrt(a)
            out[f"{self.name}.w{i}"], out[f"{self.name}.b{i}"] = rng.uniform(-r, r, (a, b)), rng.uniform(-r, r, b)
            if self.norm and i < len(self.dims) - 2:
                out[f"{self.name}.g{i}"], out[f"{self.name}.s{i}"] = np.ones(b), np.zeros(b)
        return out

    def forward(self, p: dict, x: np.ndarray, drop: float = 0.0, rng: np.random.Generator | None = None):
        kept = []
        for i in range(len(self.dims) - 1):
            y, c = x @ p[f"{self.name}.w{i}"] + p[f"{self.name}.b{i}"], {"x": x}
            if i < len(self.dims) - 2:
                if self.norm:
                    mean = y.mean(1, keepdims=True)
                    c["dev"] = np.sqrt(((y - mean) ** 2).mean(1, keepdims=True) + EPS)
                    c["hat"] = (y - mean) / c["dev"]
                    y = c["hat"] * p[f"{self.name}.g{i}"] + p[f"{self.name}.s{i}"]
                c["mask"] = (y > 0).astype(np.float64)
                if drop and rng is not None and self.norm:
                    c["mask"] *= (rng.random(y.shape) >= drop) / (1 - drop)
                y = y * c["mask"]
            kept.append(c)
            x = y
        return x, kept

    def backward(self, p: dict, kept: list, d: np.ndarray, grad: dict) -> np.ndarray:
        for i in range(len(self.dims) - 2, -1, -1):
            c = kept[i]
            if "mask" in c:
                d = d * c["mask"]
                if self.norm:
                    grad[f"{self.name}.g{i}"], grad[f"{self.name}.s{i}"] = (d * c["hat"]).sum(0), d.sum(0)
                    d = d * p[f"{self.name}.g{i}"]
                    d = (d - d.mean(1, keepdims=True) - c["hat"] * (d * c["hat"]).mean(1, keepdims=True)) / c["dev"]
            grad[f"{self.name}.w{i}"], grad[f"{self.name}.b{i}"] = c["x"].T @ d, d.sum(0)
            d = d @ p[f"{self.name}.w{i}"].T
        return d


def class_weights(counts) -> np.ndarray:
    """A weight a class, inverse to its rows (at least one), 1 on average."""
    share = 1 / np.maximum(np.asarray(counts, np.float64), 1)
    return share / share.sum() * len(share)


def contrastive(z: np.ndarray, y: np.ndarray, temperature: float, weights: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Supervised contrastive loss of unit projections of ``z`` and its gradient; 0 where no row has a partner.

    ``weights`` of classes make the mean over anchors a weighted one.
    """
    norm = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    u = z / norm
    s = u @ u.T / temperature
    np.fill_diagonal(s, -np.inf)
    same = (y[:, None] == y[None]) & ~np.eye(len(y), dtype=bool)
    partners = same.sum(1, keepdims=True)
    some = partners[:, 0] > 0
    if not some.any():
        return 0.0, np.zeros_like(z)
    top = s.max(1, keepdims=True)
    e = np.exp(s - top)
    log = s - top - np.log(e.sum(1, keepdims=True))
    share = np.where(some, 1.0 if weights is None else np.asarray(weights)[y], 0.0)
    share /= share.sum()
    loss = -(np.where(same, log, 0).sum(1) / np.maximum(partners[:, 0], 1) * share).sum()
    ds = (e / e.sum(1, keepdims=True) - same / np.maximum(partners, 1)) * share[:, None] / temperature
    du = (ds + ds.T) @ u
    return float(loss), (du - u * (du * u).sum(1, keepdims=True)) / norm


class Network:
    """Encoder, decoder and projector with their weights."""

    def __init__(self, width: int, cfg: dict, weights: dict | None = None):
        h, latent = list(cfg["hidden_dims"]), cfg["latent_dim"]
        self.cfg, self.width = cfg, width
        self.encoder, self.decoder = Stack("enc", [width, *h, latent]), Stack("dec", [latent, *h[::-1], width])
        self.projector = Stack("proj", [latent, latent, cfg["proj_dim"]], norm=False)
        rng = np.random.default_rng(cfg["seed"])
        self.weights = weights or {k: v for s in (self.encoder, self.decoder, self.projector) for k, v in s.initial(rng).items()}

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self.encoder.forward(self.weights, x)[0]

    def loss(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None, want_gradient: bool = True):
        """Weighted reconstruction and contrastive loss of a batch, and the gradient of all weights."""
        c, p = self.cfg, self.weights
        z, enc = self.encoder.forward(p, x, c["dropout"], rng)
        back, dec = self.decoder.forward(p, z, c["dropout"], rng)
        proj, pro = self.projector.forward(p, z)
        apart, d_proj = contrastive(proj, y, c["temperature"], c.get("anchor_weights"))
        miss = back - x
        total = c["reconstruction_weight"] * float((miss**2).mean()) + c["contrastive_weight"] * apart
        if not want_gradient:
            return total, {}
        grad: dict[str, np.ndarray] = {}
        dz = self.decoder.backward(p, dec, c["reconstruction_weight"] * 2 * miss / miss.size, grad)
        dz = dz + self.projector.backward(p, pro, c["contrastive_weight"] * d_proj, grad)
        self.encoder.backward(p, enc, dz, grad)
        return total, grad


def flat(weights: dict) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unflat(values: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


class AdamW:
    def __init__(self, rate: float, decay: float):
        self.rate, self.decay, self.t, self.m, self.v = rate, decay, 0, 0.0, 0.0

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g * min(1.0, CLIP / max(float(np.linalg.norm(g)), 1e-12))
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        w = w * (1 - self.rate * self.decay)
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


_PART = "slot int, n long, loss double, gradient binary"


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _gradients(shared, epoch: int, train: bool):
    def run(table: pa.Table) -> pa.Table:
        net = shared.value
        group = table["group"][0].as_py()
        table = table.sort_by([("key", "ascending"), ("copy", "ascending")])
        rng = np.random.default_rng((net.cfg["seed"], epoch, group)) if train else None
        loss, grad = net.loss(_matrix(table["x"].combine_chunks()), table["y"].to_numpy(), rng, train)
        return pa.table({"slot": pa.array([group % SUMS], pa.int32()), "n": pa.array([len(table)], pa.int64()), "loss": pa.array([loss * len(table)]), "gradient": pa.array([(flat(grad) * len(table)).tobytes() if train else b""], pa.binary())})

    return run


def _added(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["n"].to_pylist(), table["loss"].to_pylist(), table["gradient"].to_pylist(), strict=True))  # one order whatever comes first
    total = sum(np.frombuffer(g) for _, _, g in rows)
    return pa.table({"slot": table["slot"].slice(0, 1), "n": pa.array([sum(r[0] for r in rows)], pa.int64()), "loss": pa.array([sum(r[1] for r in rows)]), "gradient": pa.array([np.asarray(total, np.float64).tobytes()], pa.binary())})


class SupConReducer:
    """Fit, transform, save and load."""

    def __init__(self, **config):
        unknown = set(config) - set(DEFAULTS)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        self.cfg = {**DEFAULTS, **config}
        if self.cfg["schedule"] not in SCHEDULES:
            raise ValueError(f"unknown schedule: {self.cfg['schedule']}")
        self.history: list[tuple[float, float]] = []

    def _rows(self, df: DataFrame, id_col: str, label: str) -> DataFrame:
        wide = F.array(*[F.col(f"`{c}`").cast("double") for c in self.columns])
        scaled = F.zip_with(F.zip_with(wide, F.lit(self.mean), lambda x, m: x - m), F.lit(self.std), lambda x, s: x / s)
        return df.select(F.xxhash64(F.col(id_col), wide).alias("key"), F.col(label).alias("label"), scaled.alias("x"))

    def settings(self, epoch: int) -> tuple[float, float]:
        """Learning rate and contrastive weight of an epoch."""
        c = self.cfg
        last, rate, weight = max(1, c["epochs"] - 1), c["learning_rate"], c["contrastive_weight"]
        if c["schedule"] == "cosine":
            rate *= (1 + np.cos(np.pi * epoch / max(1, c["epochs"]))) / 2
        if c["contrastive_weight_end"] is not None:
            weight += (c["contrastive_weight_end"] - weight) * epoch / last
        return float(rate), float(weight)

    def fit(self, train: DataFrame, val: DataFrame, columns: list[str], label: str = "label", id_col: str = "flow_uid") -> SupConReducer:
        """Train until the validation loss has not fallen for some epochs; the weights of the best epoch stay.

        Values must be finite; validation rows of a class that training lacks
        are refused.
        """
        if not columns:
            raise ValueError("no columns")
        c, spark = self.cfg, train.sparkSession
        self.columns = list(columns)
        col = lambda x: F.col(f"`{x}`").cast("double")
        wide = F.array(*[col(x) for x in columns])
        bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        if train.where(bad).limit(1).count() or val.where(bad).limit(1).count():
            raise ValueError("values must be finite")
        r = train.agg(*[F.avg(col(x)).alias(f"m{i}") for i, x in enumerate(columns)], *[F.stddev_pop(col(x)).alias(f"s{i}") for i, x in enumerate(columns)]).first()
        self.mean = np.array([r[f"m{i}"] for i in range(len(columns))], np.float64)
        self.std = np.array([r[f"s{i}"] or 1.0 for i in range(len(columns))], np.float64)
        counts = {x["label"]: x["count"] for x in train.groupBy(F.col(label).alias("label")).count().collect()}
        self.classes = sorted(counts)
        absent = [x[0] for x in val.select(label).distinct().collect() if x[0] not in counts]
        if absent:
            raise ValueError(f"validation has classes that training lacks: {absent}")
        number = F.create_map(*[v for i, k in enumerate(self.classes) for v in (F.lit(k), F.lit(i))])
        n = sum(counts.values())
        share = F.create_map(*[v for k in self.classes for v in (F.lit(k), F.lit(n / (len(counts) * counts[k])))]) if c["balance_classes"] else None
        rows = written(self._rows(train, id_col, label).withColumn("y", number[F.col("label")]).withColumn("share", share[F.col("label")] if share is not None else F.lit(1.0)).drop("label"), "train")
        held = written(self._rows(val, id_col, label).withColumn("y", number[F.col("label")]).drop("label"), "validation")
        if c["class_weighted"]:
            c = {**c, "anchor_weights": class_weights([counts[k] for k in self.classes])}
        net, adam = Network(len(columns), c), AdamW(c["learning_rate"], c["weight_decay"])
        # epochs are compared by one loss, that of the last epoch's weight
        final = {**c, "contrastive_weight": self.settings(c["epochs"] - 1)[1]}
        groups = max(1, -(-n // c["batch_size"]))
        held_groups = max(1, -(-held.count() // c["batch_size"]))
        best, kept, stale = np.inf, None, 0
        for epoch in range(c["epochs"]):
            draw = lambda salt: F.pmod(F.xxhash64("key", "copy", F.lit(c["seed"]), F.lit(epoch), F.lit(salt)), F.lit(1 << 30))  # noqa: B023, E731
            copies = F.floor(F.col("share") + F.pmod(F.xxhash64("key", F.lit(c["seed"]), F.lit(epoch)), F.lit(1 << 20)) / float(1 << 20)).cast("int")
            drawn = rows.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
            drawn = written(drawn.withColumn("group", (draw(1) % groups).cast("int")).drop("share"), "epoch")
            losses = []
            adam.rate, weight = self.settings(epoch)
            now = {**c, "contrastive_weight": weight}
            for low in range(0, groups, GROUPS_A_STEP):
                shared = spark.sparkContext.broadcast(Network(net.width, now, net.weights))
                part = drawn.where(F.col("group").between(low, low + GROUPS_A_STEP - 1)).groupBy("group").applyInArrow(_gradients(shared, epoch, True), _PART)
                parts = sorted(part.groupBy("slot").applyInArrow(_added, _PART).collect(), key=lambda x: x["slot"])
                if parts:
                    total = sum(x["n"] for x in parts)
                    losses.append(sum(x["loss"] for x in parts) / total)
                    gradient = sum(np.frombuffer(x["gradient"]) for x in parts) / total
                    net = Network(net.width, c, unflat(adam.step(flat(net.weights), gradient), net.weights))
            shared = spark.sparkContext.broadcast(Network(net.width, final, net.weights))
            mine = held.withColumn("copy", F.lit(1)).withColumn("group", F.pmod(F.xxhash64("key"), F.lit(held_groups)).cast("int"))
            v = mine.groupBy("group").applyInArrow(_gradients(shared, epoch, False), _PART).agg(F.sum("loss").alias("l"), F.sum("n").alias("n")).first()
            loss = v["l"] / v["n"] if v["n"] else float(np.mean(losses))
            if not np.isfinite(loss):
                raise FloatingPointError("the loss is no longer finite")
            self.history.append((float(np.mean(losses)) if losses else float("nan"), float(loss)))
            if loss < best - c["min_delta"]:
                best, kept, stale = loss, net, 0
            else:
                stale += 1
                if stale >= c["early_stopping_patience"]:
                    break
        self.net, self.best_loss = kept if kept is not None else net, best
        return self

    def transform(self, df: DataFrame, columns: list[str], out: str = "reduced") -> DataFrame:
        """Adds the latent vector; the columns must be those of the fit, in order."""
        if list(columns) != self.columns:
            raise ValueError("columns differ from those the reducer was fitted on")
        shared = df.sparkSession.sparkContext.broadcast((self.net, self.mean, self.std))

        @F.pandas_udf("array<double>")
        def encode(v: pd.Series) -> pd.Series:
            net, mean, std = shared.value
            return pd.Series(net.encode((np.array(v.tolist(), np.float64) - mean) / std).tolist())

        return df.withColumn(out, encode(F.array(*[F.col(f"`{c}`").cast("double") for c in columns])))

    def save(self, spark: SparkSession, path: str) -> None:
        state = {"format": FORMAT, "cfg": self.cfg, "columns": self.columns, "classes": self.classes, "mean": self.mean.tolist(), "std": self.std.tolist(), "history": self.history, "weights": {k: v.tolist() for k, v in self.net.weights.items()}}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SupConReducer:
        d = json.loads(spark.read.option("wholetext", "true").text(path).first()[0])
        if d.get("format") != FORMAT:
            raise ValueError("unknown reducer format")
        out = cls(**d["cfg"])
        out.columns, out.classes, out.history = d["columns"], d["classes"], [tuple(x) for x in d["history"]]
        out.mean, out.std = np.array(d["mean"]), np.array(d["std"])
        out.net = Network(len(out.columns), out.cfg, {k: np.array(v) for k, v in d["weights"].items()})
        return out
