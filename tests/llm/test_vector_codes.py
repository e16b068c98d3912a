"""Product codes against a plain loop over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from netquill.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id int, q string, code string, part int, _label string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "q", "c", 3, "l") for i, v, y in rows], SCHEMA)


def brute(rows, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(q) for _, q, _ in kept), default=0)
    kept = [k for k in kept if len(k[1]) == width]
    part = width // 8
    cut = lambda q, p: q[p * part : (p + 1) * part]
    order = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[1]))[:16]
    books = [[cut(k[1], p) for k in order] for p in range(8)]
    near = lambda x, b: min((sum((s - t) ** 2 for s, t in zip(x, e, strict=True)), j) for j, e in enumerate(b))
    for _ in range(rounds):
        for p in range(8):
            own = {}
            for _, q, _ in kept:
                own.setdefault(near(cut(q, p), books[p])[1], []).append(cut(q, p))
            for j, xs in own.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, q, y in kept:
        best = [near(cut(q, p), books[p]) for p in range(8)]
        out.append((i, y, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best)))
    sums = {}
    for _, y, _, e in out:
        sums[y] = sums.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((*r, sums[r[1]]) for r in out), key=str), digest


def vectors(seed, n, width=16):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 0.3) for c in r.choice(centre)], r.choice([0, 0, 0, 1, 2, None])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [float("nan")] * width, 1), (n + 2, [float("inf")] + [0.0] * (width - 1), 2), (n + 3, [None] + [0.0] * (width - 1), 2), (n + 4, [], None), (n + 5, [0.25] * (width - 1), 0)]
    rows += [(None, [0.0] * width, None), (3, rows[3][1], rows[3][2]), (3, rows[4][1], 1), (n + 6, rows[5][1], 2), (n + 7, [-0.0001] * width, 7)]
    return rows


@pytest.mark.parametrize("seed,n", [(1, 120), (2, 9), (3, 40)])
def test_against_all_entries(spark, seed, n):
    rows = vectors(seed, n)
    got, books = vector_codes.encode_vectors(frame(spark, rows).repartition(5))
    want, digest = brute(rows)
    assert sorted(((r["id"], r["label"], r["code"], r["error"], r["label_error"]) for r in got.collect()), key=str) == want
    assert vector_codes.codebooks_digest(books) == digest


def test_hot_and_rare_labels(spark, monkeypatch):
    rows = vectors(4, 60)
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 3)
    got, _ = vector_codes.encode_vectors(frame(spark, rows))
    assert sorted(((r["id"], r["label"], r["code"], r["error"], r["label_error"]) for r in got.collect()), key=str) == brute(rows)[0]


def test_annulus_is_exact_and_prunes():
    r = np.random.default_rng(5)
    entries = r.integers(-3000, 3000, (16, 4)) * np.array([1, 1, 1, 1]) // (1 + np.arange(16))[:, None]
    entries[7] = entries[3]  # a tie goes to the lower index
    parts = np.concatenate([r.integers(-3000, 3000, (500, 4)), entries, np.zeros((3, 4), np.int64)])
    book = vector_codes.Codebook(entries)
    index, distance = book.nearest(parts)
    d = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (distance == d.min(1)).all()
    book = vector_codes.Codebook(entries)
    book.nearest(entries[r.integers(0, 16, 500)] + r.integers(-50, 51, (500, 4)))
    assert book.evaluated < 0.4 * 500 * 16  # near an entry the annulus is thin


def test_empty_and_odd(spark):
    assert vector_codes.encode_vectors(frame(spark, []))[0].count() == 0
    assert vector_codes.encode_vectors(frame(spark, [(1, None, 1)]))[0].count() == 0
    got = vector_codes.encode_vectors(frame(spark, [(1, [], 1), (1, [], 1)]))[0].collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in got] == [("00" * 8, 0, 0)] * 2
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.encode_vectors(frame(spark, [(1, [0.5] * 7, 1)]))
    with pytest.raises(ValueError, match="exact"):
        vector_codes.encode_vectors(frame(spark, [(1, [1e9] * 8, 1)]))


def test_query_columns(spark):
    got = vector_codes.op11_vector_codes(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
