"""Toxic spans by a linear-chain conditional random field.

Labels exist for documents only, so labelled tokens are derived first: a word
feature (the word, its first 4 to 6 characters) whose document counts in toxic
and clean training documents differ far beyond chance marks the tokens that
bear it in toxic documents.  A two-state CRF is then fitted to the labelled
tokens by its exact log-likelihood gradient.  Scoring runs forward-backward
over whole texts; a document's score joins the marginals of its spans, and the
spans' character offsets are kept.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, lean_batches, own_columns, trim

#: Bound of the training sample: documents of each label, by the md5 order of their ids, and characters of each label's
#: documents together. Texts are taken whole; one longer than a tenth of that is not taken.
SAMPLE_PER_LABEL, SAMPLE_CHARS = 1_500, 10_000_000
DIM_BITS = 19
SEGMENT = 48
MEMO_WORDS = 150_000
CUE_BITS = 23
SPAN_AT = 0.5
_STRIP = "\"'.,;:!?()[]{}<>«»„“”‚‘’*#%$&|+=~^`_/\\-"


def word_features(word: str) -> list[int]:
    """Hashed features of a token: word, first 4/5/6 and last 3 characters, shape."""
    w = word.lower().strip(_STRIP) or word
    shape = "u" if word.isupper() else "t" if word[:1].isupper() else "d" if w.isdigit() else "l"
    names = [f"w={w}", f"3>{w[-3:]}", f"s={shape}{len(w) != len(word)}"] + [f"{n}<{w[:n]}" for n in (4, 5, 6) if len(w) >= n]
    mask = (1 << DIM_BITS) - 1
    return [zlib.crc32(x.encode()) & mask for x in names]


def _cues(word: str) -> list[int]:
    """Hashed cues of a token: the word, then its first 4, 5 and 6 characters."""
    w = word.lower().strip(_STRIP) or word
    return [zlib.crc32(x.encode()) >> (32 - CUE_BITS) for x in (w, *[f"{w[:n]}<" for n in (4, 5, 6) if len(w) >= n])]


def copies(split: list[list[str]]) -> list[int]:
    """Group number of each text; texts that share a smallest hash of three-word runs count as copies of one."""
    group, seen = list(range(len(split))), {}

    def root(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, words in enumerate(split):
        runs = [zlib.crc32(" ".join(words[j : j + 3]).encode()) for j in range(max(1, len(words) - 2))]
        for salt in (0, 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35):
            low = min(((r ^ salt) * 0x9E3779B1) & 0xFFFFFFFF for r in runs)
            j = seen.setdefault((salt, low), i)
            group[root(i)] = root(j)
    return [root(i) for i in range(len(split))]


def label_tokens(texts: list[str], toxic: list[int]) -> list[np.ndarray]:
    """0/1 for every token, from document labels.

    A cue counts once per group of copies.  It is taken if its counts in toxic
    and clean groups differ by a log-likelihood ratio beyond what the best of
    that many cues would reach by chance.  Beginnings of words are counted over
    words that are not cues themselves, so one frequent word does not drag in
    all that begin alike.
    """
    split = [t.split() for t in texts]
    groups: dict[tuple, list[int]] = {}
    for i, (g, y) in enumerate(zip(copies(split), toxic, strict=True)):
        groups.setdefault((g, y), []).append(i)
    n1 = sum(y for _, y in groups)
    n0 = len(groups) - n1

    def select(pick) -> np.ndarray:
        counts = np.zeros((2, 1 << CUE_BITS), np.uint16)  # a bounded sample: counts stay small
        for (_, y), members in groups.items():
            cues = {c for i in members for w in set(split[i]) for c in pick(_cues(w))}
            counts[y, np.fromiter(cues, np.int64, len(cues))] += 1
        seen = counts.any(0)
        a0, a1 = counts[:, seen].astype(np.float64)
        least = 2 * np.log(seen.sum() + 1) + 2
        share = (a0 + a1) / max(1, n0 + n1)
        with np.errstate(divide="ignore", invalid="ignore"):
            llr = 2 * (a1 * np.log(a1 / (n1 * share)) + np.where(a0 > 0, a0 * np.log(a0 / (n0 * share)), 0))
        good = np.zeros(1 << CUE_BITS, bool)
        good[np.flatnonzero(seen)[(a1 * max(n0, 1) > 20 * a0 * max(n1, 1)) & (llr >= least)]] = True
        return good

    words = select(lambda c: c[:1])
    starts = select(lambda c: () if words[c[0]] else c[1:])

    def tag(word: str) -> int:
        c = _cues(word)
        return int(words[c[0]] or starts[c[1:]].any())

    return [np.array([tag(w) for w in t] if y else np.zeros(len(t)), np.int8) for t, y in zip(split, toxic, strict=True)]


def _segments(texts, tags):
    """Segments of at most SEGMENT tokens of all texts."""
    for text, tag in zip(texts, tags, strict=True):
        words = text.split()
        for a in range(0, len(words), SEGMENT):
            yield words[a : a + SEGMENT], tag[a : a + SEGMENT]


def fit_crf(texts: list[str], toxic: list[int], epochs: int = 6, batch: int = 256, rate: float = 0.3, l2: float = 1e-6) -> dict:
    """Weights of the CRF: ``w`` (tagged minus untagged, per feature), ``trans`` (2x2 logs), ``start`` (2 logs).

    Every segment of the sample counts; steps work on the features that occur in it.
    """
    tags = label_tokens(texts, toxic)
    trans, start = np.zeros((2, 2)), np.zeros(2)
    total = np.zeros(1 << DIM_BITS)
    n_segs = sum(-(-len(t) // SEGMENT) for t in tags)
    if not n_segs:
        return {"w": total, "trans": trans, "start": start}
    memo: dict[str, list[int]] = {}
    place: dict[int, int] = {}  # of a feature among those that occur; 0 is padding
    width = 6
    feats = np.zeros((n_segs, SEGMENT, width), np.int32)
    y = np.zeros((n_segs, SEGMENT), np.int8)
    length = np.zeros(n_segs, np.int64)
    for i, (words, tag) in enumerate(_segments(texts, tags)):
        length[i] = len(words)
        y[i, : len(words)] = tag
        for j, word in enumerate(words):
            f = memo.get(word)
            if f is None:
                f = memo[word] = [place.setdefault(x, len(place) + 1) for x in word_features(word)]
            feats[i, j, : len(f)] = f
    dim = len(place) + 1
    w = np.zeros(dim)
    gw, gt, gs = np.full(dim, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(n_segs)
        for at in range(0, len(order), batch):
            b = order[at : at + batch]
            n = int(length[b].max())
            f, tag, size = feats[b, :n], y[b, :n].astype(np.float64), length[b]
            u = w[f].sum(axis=2)
            inside = np.arange(n)[None, :] < size[:, None]
            p1, pair = _batch_marginals(u, inside, trans, start)
            miss = (tag - p1) * inside
            grad = np.bincount(f.ravel(), np.repeat(miss.ravel(), width), dim)
            grad[0] = 0
            grad = grad / len(b) - l2 * w
            seen = np.zeros((2, 2))
            both = inside[:, 1:]
            for i in (0, 1):
                for j in (0, 1):
                    seen[i, j] = (((tag[:, :-1] == i) & (tag[:, 1:] == j)) * both).sum()
            dt = (seen - pair) / len(b)
            ds = (np.array([(tag[:, 0] == 0).sum(), (tag[:, 0] == 1).sum()]) - np.array([(1 - p1[:, 0]).sum(), p1[:, 0].sum()])) / len(b)
            for g, acc, x in ((grad, gw, w), (dt, gt, trans), (ds, gs, start)):
                acc += g * g
                x += rate * g / np.sqrt(acc)
            w[0] = 0
    total[np.fromiter(place, np.int64, len(place))] = w[1:]
    return {"w": total, "trans": trans, "start": start}


def _batch_marginals(u, inside, trans, start):
    """Token marginals of state 1, and expected transition counts, of padded segments."""
    m, n = u.shape
    a, e = np.exp(trans), np.exp(np.clip(u, -30, 30))
    fwd, bwd = np.zeros((n, m, 2)), np.ones((n, m, 2))
    s = np.exp(start)
    fwd[0] = np.stack([np.full(m, s[0]), s[1] * e[:, 0]], 1)
    fwd[0] /= fwd[0].sum(1, keepdims=True)
    for t in range(1, n):
        x = fwd[t - 1] @ a
        x[:, 1] *= e[:, t]
        fwd[t] = x / x.sum(1, keepdims=True)
    for t in range(n - 2, -1, -1):
        x = bwd[t + 1].copy()
        x[:, 1] *= e[:, t + 1]
        x = x @ a.T
        bwd[t] = np.where(inside[:, t + 1][:, None], x / x.sum(1, keepdims=True), 1.0)
    g = fwd * bwd
    p1 = (g[:, :, 1] / g.sum(2)).T
    pair = np.zeros((2, 2))
    for t in range(1, n):
        right = bwd[t].copy()
        right[:, 1] *= e[:, t]
        x = fwd[t - 1][:, :, None] * a[None] * right[:, None, :]
        x /= x.sum((1, 2), keepdims=True)
        pair += (x * inside[:, t][:, None, None]).sum(0)
    return p1, pair


def chain_marginals(u: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Exact marginals of state 1 over many documents laid end to end.

    ``first`` marks document starts, where the chain begins anew.  The row of
    tokens is folded into about sqrt(n) equal pieces handled side by side:
    matrix products carry the messages across piece ends, then every piece is
    run with its true message.  Cost is linear, memory is a few vectors.
    """
    n = len(u)
    if not n:
        return np.empty(0)
    steps = max(1, int(np.sqrt(n)))
    rows = -(-n // steps)
    pad = rows * steps - n
    e = np.exp(np.clip(np.concatenate([u, np.zeros(pad)]), -30, 30)).reshape(rows, steps).T.copy()
    fresh = np.concatenate([first, np.ones(pad, bool)]).reshape(rows, steps).T.copy()
    a, s = np.exp(trans), np.exp(start)
    s = s / s.sum()
    A00, A01, A10, A11 = (np.where(fresh, x, y) for x, y in ((s[0], a[0, 0]), (s[1], a[0, 1]), (s[0], a[1, 0]), (s[1], a[1, 1])))
    A01, A11 = A01 * e, A11 * e
    # products of each piece
    p = [np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)]
    for t in range(steps):
        q = [p[0] * A00[t] + p[1] * A10[t], p[0] * A01[t] + p[1] * A11[t], p[2] * A00[t] + p[3] * A10[t], p[2] * A01[t] + p[3] * A11[t]]
        norm = q[0] + q[1] + q[2] + q[3]
        p = [x / norm for x in q]
    enter = np.empty((rows, 2))
    x0, x1 = 0.5, 0.5
    for r in range(rows):
        enter[r] = x0, x1
        y0, y1 = x0 * p[0][r] + x1 * p[2][r], x0 * p[1][r] + x1 * p[3][r]
        x0, x1 = y0 / (y0 + y1), y1 / (y0 + y1)
    leave = np.empty((rows, 2))
    x0, x1 = 0.5, 0.5
    for r in range(rows - 1, -1, -1):
        leave[r] = x0, x1
        y0, y1 = p[0][r] * x0 + p[1][r] * x1, p[2][r] * x0 + p[3][r] * x1
        x0, x1 = y0 / (y0 + y1), y1 / (y0 + y1)
    fwd = np.empty((steps, rows))  # share of state 1
    f0, f1 = enter[:, 0], enter[:, 1]
    for t in range(steps):
        g0, g1 = f0 * A00[t] + f1 * A10[t], f0 * A01[t] + f1 * A11[t]
        norm = g0 + g1
        f0, f1 = g0 / norm, g1 / norm
        fwd[t] = f1
    out = np.empty((steps, rows))
    b0, b1 = leave[:, 0], leave[:, 1]
    for t in range(steps - 1, -1, -1):
        x1 = fwd[t] * b1
        out[t] = x1 / (x1 + (1 - fwd[t]) * b0)
        c0, c1 = A00[t] * b0 + A01[t] * b1, A10[t] * b0 + A11[t] * b1
        norm = c0 + c1
        b0, b1 = c0 / norm, c1 / norm
    return out.T.ravel()[:n]


class Tagger:
    """Scores texts with fitted weights; remembers words' potentials."""

    def __init__(self, model: dict):
        self.model, self.memo = model, {}

    def __call__(self, texts: list[str]) -> list[tuple[float, int, list[tuple[int, int, float]]]]:
        """``(score, number of tagged tokens, spans)`` of each text; a span is start, end (characters) and probability."""
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        memo, w = self.memo, self.model["w"]
        split = [t.split() for t in texts]
        for words in split:
            for x in words:
                if x not in memo:
                    memo[x] = float(w[word_features(x)].sum())
        sizes = np.array([len(x) for x in split], np.int64)
        ends = np.cumsum(sizes)
        u = np.array([memo[x] for words in split for x in words], np.float64)
        first = np.zeros(len(u), bool)
        first[(ends - sizes)[sizes > 0]] = True
        p = chain_marginals(u, first, self.model["trans"], self.model["start"])
        out = []
        for text, n, end in zip(texts, sizes, ends, strict=True):
            mine = p[end - n : end]
            if not n:
                out.append((0.0, 0, []))
                continue
            hot = np.flatnonzero(mine >= SPAN_AT)
            if not len(hot):
                out.append((float(mine.max()), 0, []))
                continue
            at = [m.span() for m in re.finditer(r"\S+", text)]
            if len(at) != n:  # str.split() and \S disagree on a few separators
                at, here = [], 0
                for x in text.split():
                    here = text.index(x, here)
                    at.append((here, here + len(x)))
                    here += len(x)
            spans, miss = [], 1.0
            for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1):
                q = float(mine[run].max())
                spans.append((at[run[0]][0], at[run[-1]][1], q))
                miss *= 1 - q
            out.append((1 - miss, len(hot), spans))
        return out


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, chars: int) -> list:
    """At most ``per_label`` documents of each label outside the held-out fold, by md5 of the id.

    Whole texts, as many as ``chars`` characters a label hold together; none
    longer than a tenth of that.  Rows without id, text or label 0 or 1 are
    left out; an id labelled twice counts as 1 if one of them is, and of an
    id's texts the least in code points is taken.
    """
    lab = own_columns(labels, id="doc_id", y=label).where(F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    order = F.md5(F.col("id").cast("string"))
    picked = None
    for y in (0, 1):
        part = lab.where(F.col("y") == y).orderBy(order).limit(per_label)
        picked = part if picked is None else picked.unionByName(part)
    text = own_columns(docs, id="doc_id", text="text").where(F.col("text").isNotNull() & (F.length("text") * 10 <= chars))
    got = text.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    # a window over 2 * per_label rows at most
    so_far = F.sum(F.length("text")).over(Window.partitionBy("y").orderBy(order, "id"))
    got = got.withColumn("so_far", so_far).where(F.col("so_far") <= chars).drop("so_far")
    return sorted(got.collect(), key=lambda r: r.id)


def fit_from_tables(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, chars: int = SAMPLE_CHARS) -> dict:
    rows = training_sample(docs, labels, "toxic", per_label, chars)
    return fit_crf([r.text for r in rows], [int(r.y) for r in rows])


_DDL = "score double, n_toxic_tokens long, spans array<struct<start:int,end:int,p:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def score_documents(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``score``, ``n_toxic_tokens`` and ``spans`` (character offsets).

    Null and empty texts score 0.  Columns of those three names are replaced.
    The model is bounded (2^19 weights) and travels with the broadcast.
    """
    lean_batches(docs.sparkSession)
    docs = docs.drop("score", "n_toxic_tokens", "spans")
    model = {k: np.asarray(v, np.float32) for k, v in model.items()}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    made: dict = {}

    def run(batches):
        if "tag" not in made:
            trim()
            made["tag"] = Tagger({k: v.astype(np.float64) for k, v in shared.value.items()})
        for batch in batches:
            texts = [t or "" for t in batch.column(names.index(text_col)).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 2_000_000):
                    size += len(texts[end])
                    end += 1
                found = made["tag"](texts[at:end])
                part = batch.slice(at, end - at)
                spans = pa.array([[{"start": a, "end": b, "p": p} for a, b, p in f[2]] for f in found], _SPANS)
                cols = [part.column(i) for i in range(part.num_columns)] + [pa.array([min(1.0, f[0]) for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), spans]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "score", "n_toxic_tokens", "spans"])
                at = end
        made.clear()
        trim()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {_DDL}")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_from_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_tokens", "spans")
