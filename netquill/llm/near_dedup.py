"""MinHash near-dedup with an LSH forest, links confirmed on whole shingle sets.

1. Every text gets its set of word shingles, a digest of the set and a MinHash
   signature.  Equal sets are one node from here on.
2. The signature's values are read in 24 orders (trees), each starting at its
   own three values.  A region of a tree is all nodes with one longest common
   prefix; it starts at depth three.  A region of one node ends; one too large
   to compare is deepened (3, 6, 12, 24 values, the whole signature) until its
   parts are small enough, so crowded regions are told apart by as many values
   as it takes and others are not.
3. Inside a region all pairs are compared; pairs whose signatures agree enough
   join loose regions of all trees (components of far fewer edges than pairs).
   Nodes of one whole signature are joined without comparing.
4. Inside a loose region the whole shingle sets decide: an inverted list counts
   the intersections of every pair, and a spanning forest of the links is kept.
   A region too large for one task is split into pairs of blocks.
5. Components of the links are the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_batches, own_columns, stash, trim
from .components import Forest, components
from .repeats import mix, new_seed, word_names

TREES, START = 24, 3
VALUES = TREES * START
#: Values of the common prefix at which a region may be settled, one after another.
DEPTHS = (3, 6, 12, 24)
#: Nodes of a region that are compared pair by pair at the first depth; a larger one is deepened. Deeper regions,
#: of which there are fewer, may have up to 4, 16 and 16 times as many.
CROWD = 256
#: Signatures of a pair of similarity 0.8 agree in at least this share but for about 1 pair in 10^6.
LOOSE = 0.55
#: Nodes of a region, or of each of two blocks of it, that one task compares.
BLOCK = 2_000
#: Shingles likewise.
BLOCK_SHINGLES = 3_000_000
#: Nodes in regions up to which their list is broadcast to fetch texts; beyond it the texts are joined by shuffle.
BROADCAST_NODES = 200_000
_MULT = (np.random.default_rng(11).integers(1, 1 << 63, VALUES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_STEPS = np.random.default_rng(12).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], k: int, seed: int) -> list[np.ndarray]:
    """Per text its sorted distinct 64-bit names of ``k``-word shingles, keyed by ``seed``; fewer words make one shingle, none none."""
    words, at = word_names([t.lower() for t in texts], seed)  # bytes.lower() changes A-Z only
    n = max(0, len(words) - k + 1)
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = (s ^ (s >> np.uint64(29))) * _STEPS[i % 16] + words[i : i + n]
    s = mix(s)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=int(b - a))] if b > a else [], np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values (their upper 32 bits) of a set that is not empty."""
    low = np.full(VALUES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 4096):
        low = np.minimum(low, (_MULT[:, None] * s[None, at : at + 4096]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def _sign(k: int, seed: int):
    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = shingle_sets(part.column(1).to_pylist(), k, seed)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s).astype(">u4").tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["id", "print", "n", "node", "sig"],
                )
        trim()

    return sign


def _prefixes(depth: int):
    """One row per (tree, node): a 64-bit name of the tree and its first ``depth`` values; ``tree`` null stands for all trees."""

    def name(batches):
        for batch in batches:
            keys, trees, rows = [], [], []
            for i, (sig, tree) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                twice = sig + sig
                for t in range(TREES) if tree is None else (tree,):
                    at = t * START * 4
                    keys.append(xxhash.xxh3_64_intdigest(twice[at : at + depth * 4], seed=t))
                    trees.append(t)
                    rows.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(trees, pa.int32()), batch.column(0).take(pa.array(rows, pa.int64()))], names=["start", "tree", "node"])

    return name


def _compare(table: pa.Table) -> pa.Table:
    """Loose edges inside the regions of a group of regions, as a forest."""
    table = table.sort_by([("tree", "ascending"), ("start", "ascending"), ("node", "ascending")])
    nodes, sigs = table["node"].to_pylist(), np.frombuffer(b"".join(table["sig"].to_pylist()), ">u4").reshape(-1, VALUES).astype(np.uint32)
    start, tree = table["start"].to_numpy(), table["tree"].to_numpy()
    cut = np.flatnonzero((np.diff(start) != 0) | (np.diff(tree) != 0)) + 1
    forest, out = Forest(), []
    for a, e in zip([0, *cut.tolist()], [*cut.tolist(), len(nodes)], strict=True):
        for i in range(a + 1, e):
            agree = (sigs[a:i] == sigs[i]).mean(axis=1)
            for j in np.flatnonzero(agree >= LOOSE):
                if forest.join(nodes[i], nodes[a + int(j)]):
                    out.append((nodes[i], nodes[a + int(j)]))
    trim()
    return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})


def loose_edges(nodes: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` of nodes (``node``, ``sig``) that some tree brings together and whose signatures agree enough.

    A round per depth: regions that are not crowded are settled, larger ones go
    one depth further; at the last their nodes all join the least of them, and
    whole shingle sets decide.  So every pair with a common prefix of the last
    depth in some tree meets.  Sizes are counted before any node is moved, and only
    the names of crowded regions are joined back.
    """
    found, left = None, nodes.withColumn("tree", F.lit(None).cast("int"))
    for i, depth in enumerate(DEPTHS):
        crowd = CROWD * min(4**i, 16)
        starts = stash(left.select("node", "sig", "tree").mapInArrow(_prefixes(depth), "start long, tree int, node binary"), "starts")
        sizes = stash(starts.groupBy("start").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "sizes")
        # one plan at any size: the rows are many, and which of them are alone is not known before
        small = starts.join(sizes.where(F.col("c") <= crowd).select("start").hint("merge"), "start")
        # regions share groups of some hundred nodes; a region is never split
        groups = max(1, (sizes.where(F.col("c") <= crowd).agg(F.sum("c")).first()[0] or 0) // 2_000)
        dealt = small.join(nodes.select("node", "sig"), "node").withColumn("group", F.pmod("start", F.lit(groups)))
        edges = stash(dealt.groupBy("group").applyInArrow(_compare, "a binary, b binary"), "loose")
        found = edges if found is None else found.unionByName(edges)
        crowded = sizes.where(F.col("c") > crowd).select("start")
        if not crowded.limit(1).count():
            return found
        if depth == DEPTHS[-1]:
            inside = stash(starts.join(crowded, "start", "left_semi").select("start", F.col("node").alias("a")), "crowded")
            low = stash(inside.groupBy("start").agg(F.min("a").alias("b")), "lowest")
            return found.unionByName(inside.join(low, "start").where("a <> b").select("a", "b").distinct())
        again = stash(starts.join(crowded, "start", "left_semi").select("node", "tree"), "crowded")
        # deeper rounds never touch the signatures of settled nodes
        nodes = stash(nodes.join(again.select("node").distinct(), "node", "left_semi").select("node", "sig"), "deeper")
        left = again.join(nodes, "node").select("node", "sig", "tree")
    return found


def linked(sets: list[np.ndarray], blocks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs with ``100 * intersection >= percent * union``.

    With two kinds in ``blocks`` only pairs across them count (the others are
    another task's).
    """
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, number = np.unique(flat, return_inverse=True)
    order = np.argsort(number, kind="stable")
    posts = owner[order]
    starts = np.searchsorted(number[order], np.arange(number.max() + 2))
    often = starts[number + 1] - starts[number] > 1
    across = blocks.min() != blocks.max()
    forest, out, at = Forest(), [], np.concatenate([[0], np.cumsum(sizes)])
    for i in range(len(sets)):
        mine = number[at[i] : at[i + 1]][often[at[i] : at[i + 1]]]
        if not len(mine):
            continue
        both = np.bincount(np.concatenate([posts[starts[m] : starts[m + 1]] for m in mine]), minlength=len(sets))
        ok = 100 * both >= percent * (sizes[i] + sizes - both)
        ok[: i + 1] = False
        if across:
            ok &= blocks != blocks[i]
        for j in np.flatnonzero(ok):
            if forest.join(i, int(j)):
                out.append((i, int(j)))
    return out


def _confirm(k: int, percent: int, seed: int):
    def confirm(table: pa.Table) -> pa.Table:
        rows, edges = table.select(["root", "node", "block", "text"]).to_pylist(), []
        regions: dict = {}
        for r, s in zip(rows, (x for at in range(0, len(rows), 200) for x in shingle_sets([q["text"] for q in rows[at : at + 200]], k, seed)), strict=True):
            if xxhash.xxh3_128_digest(s.tobytes()) == r["node"]:  # two texts of an id may share a print
                regions.setdefault(r["root"], {})[r["node"]] = (s, r["block"])
        for members in regions.values():
            if len(members) > 1:
                nodes = list(members)
                for i, j in linked([members[x][0] for x in nodes], np.array([members[x][1] for x in nodes]), percent):
                    edges.append((nodes[i], nodes[j]))
        trim()
        return pa.table({"a": pa.array([e[0] for e in edges], pa.binary()), "b": pa.array([e[1] for e in edges], pa.binary())})

    return confirm


def text_print(text):
    """What tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b"")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, with_print: bool = False) -> DataFrame:
    """One row per input row: ``id``, ``n_shingles``, ``component_id``, ``kept``, and ``print`` of the text if asked for.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  Texts
    link if their shingle sets' intersection is ``percent`` of their union or
    more; ``component_id`` is the smallest id of the component.  A text of
    fewer words than a shingle is one shingle; null and empty texts have none,
    link with nothing and are their own component.  Null ids count as larger
    than any other.  Repeated rows share a component, and all rows that bear
    its id are kept.  Other columns are ignored; an empty table gives none.
    """
    lean_batches(docs.sparkSession)
    seed = new_seed()
    texts = own_columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    texts = texts.withColumn("print", text_print(F.col("text")))
    signed = stash(texts.select("id", "text", "print").mapInArrow(_sign(shingle, seed), "id long, print long, n long, node binary, sig binary"), "signatures")
    # a node's text is that of the row with the least id and print
    nodes = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("id", "print")).alias("row"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    nodes = stash(nodes.select("node", "sig", "n", "row.id", "row.print"), "nodes")
    found = components(loose_edges(nodes), contract=False)
    regions = stash(found.select(F.col("id").alias("node"), "root").union(found.select(F.col("root"), F.col("root"))).distinct().join(nodes.drop("sig"), "node"), "regions")
    # stored, so that a join with a hot region's rows can be split
    sizes = stash(regions.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")), "sizes")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    wanted = stash(regions.join(sizes, "root").withColumn("blocks", blocks).select("id", "print", "node", "n", "root", "blocks"), "wanted")
    r = wanted.agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_tasks = max(1, r.c // 500, r.n // BLOCK_SHINGLES)
    few = r.c <= BROADCAST_NODES
    side = wanted.select(F.col("id").alias("_id"), F.col("print").alias("_print"), "node", "root", "blocks")
    rows = texts.join(F.broadcast(side) if few else side, texts["id"].eqNullSafe(F.col("_id")) & (texts["print"] == F.col("_print")))
    # repeated rows meet map-side, so one text of a node moves on
    fetched = rows.groupBy("node", "root", "blocks").agg(F.first("text").alias("text"))
    fetched = fetched.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # block b of n takes part in the pairs (b, 0), (b, 1) ... (b, n - 1)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = fetched.withColumn("other", other).select("root", "node", "text", "block", "blocks", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # small regions share groups of a few hundred nodes; a pair of blocks is a group of its own
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(n_tasks))).otherwise(F.xxhash64("root"))
    links = dealt.withColumn("task", task).groupBy("task", "i", "j").applyInArrow(_confirm(shingle, percent, seed), "a binary, b binary")
    groups = components(links, contract=False)
    more = ["print"] if with_print else []
    members = stash(signed.join(groups.select(F.col("id").alias("node"), "root"), "node", "left").select("id", "n", F.coalesce("root", "node").alias("root"), *more), "members")
    # most components have one member and need no second look
    first = stash(members.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "components")
    out = members.join(first.hint("merge"), "root", "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), *more)


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4).withColumnRenamed("id", "doc_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
