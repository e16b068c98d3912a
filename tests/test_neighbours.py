"""Pivot k-NN against all pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netquill.operators import neighbours


def brute(q, b, k):
    out = set()
    for i, v in q:
        near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in b if j != i)[:k]
        out |= {(i, r + 1, j, round(d, 4)) for r, (d, j) in enumerate(near)}
    return out


def rows(seed, n, width=6, kinds=8):
    r = np.random.default_rng(seed)
    centre = r.normal(0, 10, (kinds, width))
    return [(i, (centre[i % kinds] + r.normal(0, 0.5, width)).tolist()) for i in range(n)]


def run(spark, q, b, k=5, **more):
    frame = lambda x: spark.createDataFrame(x, "i long, v array<double>").repartition(4)
    return {tuple(r) for r in neighbours.knn(frame(q), frame(b), "v", "i", k, **more).collect()}


@pytest.mark.parametrize("pivots", [1, 7, 64])
def test_all_rows_as_queries(spark, pivots):
    b = rows(1, 300)
    b += [(1000 + i, b[3][1]) for i in range(60)] + [(2000, [0.0] * 6), (2001, [1e3] * 6)]  # many copies, a far row
    assert run(spark, b, b, pivots=pivots) == brute(b, b, 5)


def test_few_rows_nulls_and_other_queries(spark):
    b = rows(2, 4)
    q = [(99, [0.0] * 6), (0, b[0][1]), (5, None)]
    assert run(spark, q, [*b, (50, None)]) == brute([x for x in q if x[1]], b, 5)
    assert run(spark, q, [(1, None)]) == set() and run(spark, [(5, None)], b) == set()


def test_blocks_of_a_hot_cell(spark, monkeypatch):
    b = [(i, [float(i % 3), 0.0]) for i in range(400)]
    frame = spark.createDataFrame(b, "i long, v array<double>")
    found = neighbours.candidates(frame, frame, "v", "i", 3, pivots=4, block=50)
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, 3)
    got = {(r["query_id"], j + 1, x["neighbour_id"], x["distance"]) for r in found.groupBy("query_id").agg(best.alias("b")).collect() for j, x in enumerate(r["b"])}
    assert got == brute(b, b, 3)


def test_bounds_spare_comparisons(spark):
    b = rows(3, 1_500, kinds=30)
    frame = spark.createDataFrame(b, "i long, v array<double>")
    evaluated = neighbours.candidates(frame, frame, "v", "i", 5).agg(F.sum("evaluated")).first()[0]
    assert evaluated < 0.15 * len(b) ** 2


def test_memory_of_a_block():
    """All rows of a block against each other: products in small squares, differences of the few that matter."""
    r = np.random.default_rng(9)
    n, width = 3_000, 64
    v = r.normal(0, 1, (n, width))
    v[100:140] = v[100]  # copies are ties
    ids = pa.array(range(n), pa.int64())
    far = pa.array(np.full(n, 1e9))
    left = pa.table({"id": ids, "v": pa.array(v.tolist()), "d": pa.array(np.zeros(n)), "bound": far})
    right = pa.table({"id": ids, "v": pa.array(v.tolist()), "r": pa.array(np.zeros(n))})
    tracemalloc.start()
    got = neighbours._compare(3)(left, right)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 60 << 20 and len(got) == 3 * n
    found = {}
    for q, j in zip(got["query_id"].to_pylist(), got["neighbour_id"].to_pylist(), strict=True):
        found.setdefault(q, []).append(j)
    for i in (0, 100, 139, 2_999):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        assert found[i] == [j for j in np.lexsort((np.arange(n), d)) if j != i][:3]
