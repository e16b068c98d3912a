"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


class Forest:
    """Union-find over any hashable keys; roots are the smallest keys."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


def _contract(batches):
    """Edges of one partition as stars; the forest is emptied before it grows past a bound."""
    forest, kind = Forest(), None

    def stars():
        pairs = [(x, forest.root(x)) for x in list(forest.up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)], names=["a", "b"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > 500_000:
            yield stars()
            forest = Forest()
    if kind is not None:
        yield stars()


def components(edges: DataFrame, rounds: int = 60, contract: bool = True) -> DataFrame:
    """``id`` and ``root`` (smallest id reachable) of every id that has an edge to another.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; loops and
    nulls are ignored.  With ``contract`` every partition's edges become stars
    first; leave it out where edges come as forests from Python already, which
    would keep a second Python worker beside the first.  Every round is a table in the shared folder, so a lost
    executor costs one round at most; no edge comes to the driver, only counts.
    Stars are built from per-node minima, so a hub is aggregated before it is
    shuffled and its edges can be split.
    """
    kind = edges.schema["a"].dataType.simpleString()
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    e = stash(e.mapInArrow(_contract, f"a {kind}, b {kind}") if contract else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    mark = None
    for _ in range(rounds):
        e, seen = _small_star(_large_star(e))
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _large_star(e: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the smallest node it knows. Edges are (larger, smaller)."""
    both = e.union(e.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    sent = e.join(low, e["b"] == low["n"]).select(F.col("a"), F.col("m").alias("b"))
    return sent.where("a <> b").distinct()


def _small_star(e: DataFrame):
    """Every node sends its smaller neighbours, and itself, to the smallest of them."""
    e = stash(e, "edges")
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    sent = e.join(low.withColumnRenamed("a", "n"), e["a"] == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    out = stash(sent.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
    r = out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return out, (r.n, r.h)
