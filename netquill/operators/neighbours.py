"""Exact nearest neighbours by pivots: cells, bounds from the triangle inequality, and blocked comparison.

1. A few base rows are pivots; every base row goes to the cell of its nearest
   pivot, at distance ``r`` from it.
2. A cell's summary is its count, its radius and its least distances ``r``.  An
   object of cell j is no further from a query than the query from pivot j plus
   ``r``, so the summaries bound the distance of the k-th neighbour.
3. A query goes only to cells that reach into that bound: neither too far from
   the cell's pivot by its radius, nor beyond the plane between the query's own
   pivot and the cell's.
4. Inside a cell only objects whose ``r`` differs from the query's distance to
   the pivot by no more than the bound are compared.  Cells and their queries
   are dealt in blocks, so a cell with a third of all rows is many tasks; a
   block gives the k best of each query, and those are merged.

The driver sees pivots and summaries, whose number is a parameter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

PIVOTS = 64
#: Base rows and queries that one group compares.
BLOCK = 16_384
#: Pairs whose products, and whose differences, are in memory at once; queries whose products are made together.
PAIRS, EXACT, TOGETHER = 1 << 20, 1 << 14, 128


def vectors_of(df: DataFrame, vec: str):
    """The column as it is stored if it holds floats, else as doubles; a float is half to move and exact either way."""
    return F.col(vec) if df.select(vec).dtypes[0][1] == "array<float>" else F.col(vec).cast("array<double>")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles; null elements are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("vectors differ in length")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), len(values) // max(1, len(column)))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rounded by less than what bounds allow for (:func:`_wide`)."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T, 0))


def _wide(bound: np.ndarray, scale: float) -> np.ndarray:
    """A bound with room for rounding: products of length ``scale`` squared are exact to 2^-50, their roots to 2^-25."""
    return bound + 1e-6 * (scale + 1)


def _cells(pivots: np.ndarray):
    def run(batches):
        for b in batches:
            if not len(b):
                continue
            d = _distances(matrix(b.column(1)), pivots)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell], pa.float64())], names=["id", "v", "cell", "r"])

    return run


def _routes(pivots: np.ndarray, radius: np.ndarray, least: np.ndarray, k: int, scale: float):
    """One row per query and cell it has to look at: the cell, its distance to the pivot, the bound."""
    between = _distances(pivots, pivots)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            d = _distances(matrix(b.column(1)), pivots)
            # distances no object of the summaries exceeds; the query itself may be one of them
            bounds = (d[:, :, None] + least[None]).reshape(len(d), -1)
            bound = _wide(np.partition(bounds, min(k, bounds.shape[1] - 1), axis=1)[:, k] if bounds.shape[1] > k else np.full(len(d), np.inf), scale)
            own = d.argmin(1)
            plane = (d * d - (d[np.arange(len(d)), own] ** 2)[:, None]) / np.maximum(2 * between[own], 1e-300)
            reach = (d - radius[None] <= bound[:, None]) & ((plane <= bound[:, None] + 1e-6 * (scale + 1) ** 2 / np.maximum(between[own], 1e-300)) | (between[own] == 0)) & (radius >= 0)[None]
            q, c = np.nonzero(reach)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(q)), b.column(1).take(pa.array(q)), pa.array(c, pa.int32()), pa.array(d[q, c]), pa.array(bound[q])], names=["id", "v", "cell", "d", "bound"])

    return run


def _least(cells: int, n: int):
    """A task's ``n`` least distances of every cell."""

    def run(batches):
        low = np.full((cells, n), np.inf)
        for b in batches:
            cell, r = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in np.unique(cell).tolist():
                low[c] = np.sort(np.concatenate([low[c], r[cell == c]]))[:n]
        found = np.flatnonzero(np.isfinite(low[:, 0]))
        yield pa.record_batch({"cell": pa.array(found, pa.int32()), "low": pa.array([low[c][np.isfinite(low[c])].tolist() for c in found], pa.list_(pa.float64()))})

    return run


def _compare(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """``left``: queries; ``right``: base rows of the block.

        Products of matrices give every squared distance but for rounding; what
        may be among a query's k best by them is measured by differences.
        """
        out = {"query_id": [], "neighbour_id": [], "distance": [], "evaluated": []}
        if len(left) and len(right):
            left, right = left.sort_by("d"), right.sort_by("r")
            base, ids, r = matrix(right["v"]), right["id"].to_numpy(), right["r"].to_numpy()
            q, own, d, bound = matrix(left["v"]), left["id"].to_numpy(), left["d"].to_numpy(), left["bound"].to_numpy()
            low, high = np.searchsorted(r, d - bound, side="left"), np.searchsorted(r, d + bound, side="right")
            # seen from the rows' middle products are small, and so is their rounding
            whole = np.isfinite(base).all(1)
            middle = base[whole].sum(0) / max(1, int(whole.sum()))
            near, far = base - middle, q - middle
            near2, far2 = (near * near).sum(1), (far * far).sum(1)
            slack = 1e-12 * (near2[whole].max(initial=0) + far2) + 1e-17 * (base[whole] ** 2).sum(1).max(initial=0)
            at = 0
            while at < len(q):
                # queries of like windows together, as many as fit
                many = TOGETHER
                while many > 1 and many * (high[at : at + many].max() - low[at : at + many].min()) > PAIRS:
                    many //= 2
                end = min(at + many, len(q))
                a, e = int(low[at:end].min()), int(high[at:end].max())
                if a < e:
                    row, place = _likely(far[at:end], far2[at:end], near[a:e], near2[a:e], slack[at:end], bound[at:end], k)
                    row, place = row + at, place + a
                    dist = np.empty(len(row))
                    for i in range(0, len(row), EXACT):
                        step = base[place[i : i + EXACT]] - q[row[i : i + EXACT]]
                        dist[i : i + EXACT] = np.sqrt((step * step).sum(1))
                    other = ids[place]
                    keep = (other != own[row]) & (dist <= bound[row])
                    row, other, dist = row[keep], other[keep], dist[keep]
                    order = np.lexsort((other, dist, row))
                    row, other, dist = row[order], other[order], dist[order]
                    best = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
                    out["query_id"].append(own[row[best]])
                    out["neighbour_id"].append(other[best])
                    out["distance"].append(dist[best])
                    count = np.zeros(int(best.sum()), np.int64)
                    count[:1] = (end - at) * (e - a)
                    out["evaluated"].append(count)
                at = end
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table({c: pa.array(np.concatenate(v) if v else [], kind) for (c, v), kind in zip(out.items(), kinds, strict=True)})

    return run


def _likely(q: np.ndarray, q2: np.ndarray, x: np.ndarray, x2: np.ndarray, slack: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a row that may be among its k best, itself not counted, or as near as those: squared distances off by no more than ``slack``."""
    d2 = q @ x.T
    d2 *= -2
    d2 += q2[:, None]
    d2 += x2[None]
    most = bound * bound + slack
    if d2.shape[1] > k + 1:
        most = np.minimum(most, np.partition(d2, k, axis=1)[:, k] + 2 * slack)
    return np.nonzero(d2 <= most[:, None])


def candidates(queries: DataFrame, base: DataFrame, vec: str, id_col: str, k: int, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame | None:
    """``query_id``, ``neighbour_id``, ``distance``, ``evaluated``: the k best of every query in every block it meets; None without base rows."""
    slim = lambda df: df.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vectors_of(df, vec).alias("v"))
    rows, asked = slim(base), slim(queries)
    chosen = rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(pivots).collect()
    if not chosen:
        return None
    p = np.unique(np.array([x["v"] for x in chosen], np.float64), axis=0)
    stored = lambda df: dict(df.dtypes)["v"]
    dealt = written(rows.mapInArrow(_cells(p), f"id long, v {stored(rows)}, cell int, r double"), "cells")
    n, radius, least = np.zeros(len(p), np.int64), np.full(len(p), -1.0), np.full((len(p), k + 1), np.inf)
    for s in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("radius")).collect():
        n[s["cell"]], radius[s["cell"]] = s["n"], s["radius"]
    lowest = F.slice(F.array_sort(F.flatten(F.collect_list("low"))), 1, k + 1)
    for s in dealt.select("cell", "r").mapInArrow(_least(len(p), k + 1), "cell int, low array<double>").groupBy("cell").agg(lowest.alias("low")).collect():
        least[s["cell"], : len(s["low"])] = s["low"]
    scale = float(np.abs(p).max(initial=0) * np.sqrt(p.shape[1]) + radius.max(initial=0))
    # a query's vector is repeated for every cell it goes to: the routes are made again rather than kept
    routed = asked.mapInArrow(_routes(p, radius, least, k, scale), f"id long, v {stored(asked)}, cell int, d double, bound double")
    asked_of = np.zeros(len(p), np.int64)
    for s in routed.groupBy("cell").count().collect():
        asked_of[s["cell"]] = s["count"]
    parts = lambda counts: F.get(F.lit(np.maximum(1, -(-counts // block)).tolist()), F.col("cell"))
    base_part, query_part = F.pmod(F.xxhash64("id", F.lit(1)), parts(n)).cast("int"), F.pmod(F.xxhash64("id", F.lit(2)), parts(asked_of)).cast("int")
    # every block of a cell meets every block of its queries
    left = routed.withColumn("qp", query_part).withColumn("bp", F.explode(F.sequence(F.lit(0), parts(n).cast("int") - 1)))
    right = dealt.withColumn("bp", base_part).withColumn("qp", F.explode(F.sequence(F.lit(0), parts(asked_of).cast("int") - 1)))
    keys = ["cell", "bp", "qp"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compare(k), "query_id long, neighbour_id long, distance double, evaluated long")


def knn(queries: DataFrame, base: DataFrame, vec: str, id_col: str, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """The ``k`` nearest base rows (Euclidean, ties to the smaller id) of every query, never a row of its own id.

    Rows without a vector are left out; ids are those of one row each in either
    table.  Vectors have one length.
    """
    found = candidates(queries, base, vec, id_col, k, pivots)
    if found is None:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, neighbour_id long, distance double")
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k)
    merged = found.groupBy("query_id").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("r", "n"))
    return merged.select("query_id", (F.col("r") + 1).alias("rank"), F.col("n.neighbour_id").alias("neighbour_id"), F.round("n.distance", 4).alias("distance"))
