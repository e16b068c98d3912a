"""Document quality by nearest-neighbour voting in a latent semantic space.

Terms are hashed words, word endings and word shapes, plus a few terms that
bucket a text's repetition and make-up.  A bounded sample of labelled
documents gives the term weights and, by randomized singular value
decomposition, the latent axes; its projections are the labelled vectors.
These are broadcast (a few MB, fixed by the parameters).  Every document is
projected, and its exact cosines with all labelled vectors come from blocked
matrix products; the nearest vote with their similarity as weight.
"""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .toxicity import training_sample

#: Bound of the training sample and of what is broadcast: documents of each label, and characters of these together.
SAMPLE_PER_LABEL, SAMPLE_CHARS = 1_500, 10_000_000
TERM_BITS = 13
AXES, NEIGHBOURS, BLOCK = 48, 15, 256
MEMO_WORDS = 400_000
DIM = 1 << TERM_BITS
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _term(name: str) -> int:
    return zlib.crc32(name.encode()) & (DIM - 1)


def word_terms(word: str) -> int:
    """Three term numbers of a word, packed: the word, its last three letters, its shape."""
    low = word.lower()
    letters = "A" if word.isupper() and len(word) > 1 else "a"
    shape = _DIGITS.sub("0", _LETTERS.sub(letters, word))[:8]
    return _term("w" + low) | _term("e" + low[-3:]) << 16 | _term("s" + shape) << 32


def text_terms(text: str, words: list[str]) -> list[int]:
    """Terms of the whole text: length, repetition of words and of lines, share of letters."""
    n_words = len(words)
    again = int(40 * sum(map(eq, words, words[1:])) / n_words) if n_words else 0
    lines = [x for x in text.split("\n") if x.strip()]
    dup = 1 - len(set(lines)) / len(lines) if lines else 0.0
    kind = int(8 * len(set(words)) / n_words) if n_words else -1
    odd = sum(map(text.count, "%$#*&!|{}<>"))
    share = min(9, int(40 * odd / max(1, len(text))))
    return [_term(f"len{min(12, n_words.bit_length())}"), _term(f"dup{int(8 * dup)}"), _term(f"dup{int(8 * dup)}+"), _term(f"div{kind}.{min(8, n_words.bit_length())}"), _term(f"odd{share}"), _term(f"odd{share}+"), *[_term(f"rep{i}>{j}") for i in range(4) for j in (0, 1, 3, 8, 16) if again > j]]


class Counter:
    """Term counts of texts as dense rows."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        memo = self.memo
        out = np.empty((len(texts), DIM), np.float32)
        for i, text in enumerate(texts):
            words = text.split()
            for w in set(words):
                if w not in memo:
                    memo[w] = word_terms(w)
            packed = np.array([memo[w] for w in words], np.int64)
            ids = np.concatenate([packed & 0xFFFF, packed >> 16 & 0xFFFF, packed >> 32])
            row = np.bincount(ids, minlength=DIM).astype(np.float32)
            row[text_terms(text, words)] += max(2.0, len(words) / 20)
            out[i] = row
        return out


def fit(texts: list[str], good: list[int], axes: int = AXES, seed: int = 5) -> dict:
    """``idf``, latent axes ``v``, labelled ``vectors`` (unit rows) and their ``labels``."""
    if not texts:
        return {"idf": np.ones(DIM, np.float32), "v": np.zeros((DIM, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": np.zeros(0, np.float32)}
    count = Counter()
    a = np.concatenate([count(texts[i : i + BLOCK]) for i in range(0, len(texts), BLOCK)])
    idf = np.log((1 + len(texts)) / (1 + (a > 0).sum(0))).astype(np.float32) + 1
    a = weigh(a, idf)
    rng = np.random.default_rng(seed)
    k = min(axes + 8, len(texts), DIM)
    q = np.linalg.qr(a.T @ (a @ rng.standard_normal((DIM, k), np.float32)))[0]
    for _ in range(3):
        q = np.linalg.qr(a.T @ (a @ q))[0]
    _, _, vt = np.linalg.svd(a @ q, full_matrices=False)
    v = (q @ vt.T)[:, :axes].astype(np.float32)
    return {"idf": idf, "v": v, "vectors": unit(a @ v), "labels": np.array(good, np.float32)}


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(counts) * idf)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def vote(model: dict, vectors: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the ``k`` nearest labelled vectors; 0.5 without any."""
    labels = model["labels"]
    if not len(labels):
        return np.full(len(vectors), 0.5)
    k = min(k, len(labels))
    sim = vectors @ model["vectors"].T
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(sim, near, 1), 1e-6).astype(np.float64) ** 4
    return (w * labels[near]).sum(1) / w.sum(1)


def fit_from_tables(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, chars: int = SAMPLE_CHARS) -> dict:
    rows = training_sample(docs, labels, "quality", per_label, chars)
    return fit([r.text for r in rows], [int(r.y) for r in rows])


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` of every document.

    Null and empty texts are scored by the terms of an empty text.  Repeated
    rows are scored each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: dict = {}

    def run(batches):
        count = made.setdefault("count", Counter())
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows = weigh(count([t or "" for t in part.column(1).to_pylist()]), model["idf"])
                score = vote(model, unit(rows @ model["v"]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(score, 0, 1), pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_from_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
