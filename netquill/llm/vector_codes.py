"""Product codes of vectors in integers, nearest entries found by annular norm pruning.

Components become integers, vectors are cut into parts, and every part position
has a codebook of 16 entries refined by rounds of assignment and averaging.

By the triangle inequality an entry at distance d of a part has a norm within d
of the part's.  So a codebook's entries are sorted by norm; the entry next in
norm gives a first distance, binary search gives the interval of norms it
allows, both ends included, and only entries of that annulus are evaluated, in
exact integers.

A round is one pass of the stored integers; tasks return sums per entry, which
Spark adds up, and 8 x 16 entries come back to the driver whatever the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, stash

#: Scale, parts, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Integers beyond would not leave exact 64-bit squares.
LARGEST = 1 << 26
#: Vectors handled at once.
BLOCK = 4_096
#: A label held by a larger share of the rows (one in so many) is joined by broadcast; there are fewer such labels than this.
HOT_SHARE = 1_000


class Codebook:
    """Entries of one part position, sorted by norm for the search."""

    def __init__(self, entries: np.ndarray):
        norm = np.sqrt((entries * entries).sum(1).astype(np.float64))
        self.order = np.argsort(norm, kind="stable")
        self.norms, self.entries = norm[self.order], entries[self.order]
        self.evaluated = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, ties to the lower index, and its squared distance."""
        n, count = len(parts), len(self.norms)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        own = np.sqrt((parts * parts).sum(1).astype(np.float64))
        right = np.searchsorted(self.norms, own).clip(0, count - 1)
        left = np.maximum(right - 1, 0)
        first = np.where(np.abs(self.norms[left] - own) < np.abs(self.norms[right] - own), left, right)
        step = parts - self.entries[first]
        best = np.sqrt((step * step).sum(1).astype(np.float64))
        # rounded norms are off by far less than 1, so one more on either side includes all
        lo = np.searchsorted(self.norms, own - best - 1, side="left")
        size = np.searchsorted(self.norms, own + best + 1, side="right") - lo
        start = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(lo - start, size)
        step = np.repeat(parts, size, axis=0) - self.entries[at]
        # distance and index in one number: the least of them is the nearest, lowest entry
        both = (step * step).sum(1) * ENTRIES + self.order[at]
        self.evaluated += len(at)
        found = np.minimum.reduceat(both, start)
        return found % ENTRIES, found // ENTRIES


def assign(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entry indexes and squared distances of all vectors (rows) and parts (columns)."""
    width = vectors.shape[1] // PARTS
    found = [Codebook(b).nearest(vectors[:, p * width : (p + 1) * width]) for p, b in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, width)


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id``, ``label`` and ``q``, the vector in integers, of all rows without a null or non-finite component."""
    rows = own_columns(vectors, id=id_col, v=vector_col, label=label_col).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), "label")
    good = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return good.select("id", "label", F.transform("v", lambda x: F.floor(x * SCALE)).alias("q"))


def _sums(books: list[np.ndarray], width: int):
    def run(batches):
        part = width // PARTS
        total = np.zeros((PARTS, len(books[0]), part), object)  # Python's integers: no task is too large
        count = np.zeros((PARTS, len(books[0])), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column(0).slice(at, BLOCK), width)
                index, _ = assign(x, books)
                for p in range(PARTS):
                    new = np.zeros(total.shape[1:], np.int64)
                    np.add.at(new, index[:, p], x[:, p * part : (p + 1) * part])
                    total[p] += new
                    count[p] += np.bincount(index[:, p], minlength=len(books[0]))
        p, e = np.nonzero(count)
        sums = [[str(v) for v in total[i, j]] for i, j in zip(p, e, strict=True)]
        yield pa.record_batch({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(count[p, e], pa.int64()), "sums": pa.array(sums, pa.list_(pa.string()))})

    return run


def refine(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round: every used entry becomes the floored mean of its parts."""
    part = width // PARTS
    sums = rows.select("q").mapInArrow(_sums(books, width), "part int, entry int, n long, sums array<string>")
    adds = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(part)]
    out = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *adds).collect():
        out[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(part)]
    return out


def _encode(books: list[np.ndarray], width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                index, distance = assign(_matrix(b.column(2), width), books)
                code = [bytes(r).hex() for r in index.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(distance.sum(1), pa.int64())], names=["id", "label", "code", "error"])

    return run


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` over rows of one label, nulls together.

    Labels that hold more than one row in HOT_SHARE number less than HOT_SHARE
    and are joined by broadcast; the others, none of them hot, by shuffle.
    """
    sums = stash(rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    n = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = (F.col("_n") * HOT_SHARE > n).alias("_hot")
    side = sums.select(F.col("label").alias("_label"), "label_error", hot)
    same = F.col("label").eqNullSafe(F.col("_label"))
    near = rows.join(F.broadcast(side.where("_hot")), same, "left")
    done = near.where("_hot")
    rest = near.where("_hot is null").select("id", "label", "code", "error").join(side.where("not _hot").hint("merge"), same)
    return done.unionByName(rest).drop("_label", "_hot")


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``(rows, codebooks)``: ``id``, ``label``, ``code``, ``error``, ``label_error`` of every vector kept, and the final entries.

    Left out are rows whose vector is null, holds null or non-finite components,
    or is shorter than the longest kept, that is, lacks components.  The longest
    must cut into 8 equal parts, and integers must stay below 2^26, else a
    ValueError says so.  Codebooks start as the parts of the 16 rows of smallest
    id (rows of one id by vector and label, null ids last); fewer rows make
    smaller codebooks.  Repeated rows count each; vectors of no components have
    code 0 and error 0; an empty table gives no rows.  Other columns are ignored.
    """
    rows = stash(integers(vectors, id_col, vector_col, label_col), "integers")
    most = F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))
    r = rows.agg(F.max(F.size("q")).alias("width"), most.alias("most")).first()
    width = r.width or 0
    if width % PARTS:
        raise ValueError(f"vectors of {width} components do not cut into {PARTS} equal parts")
    if (r.most or 0) >= LARGEST:
        raise ValueError(f"a component's integer reaches {LARGEST}, so squared distances would not be exact")
    rows = rows.where(F.size("q") == width)
    first = np.array([x["q"] for x in rows.orderBy(F.col("id").asc_nulls_last(), "q", "label").limit(ENTRIES).collect()], np.int64)
    first = first.reshape(len(first), width)
    part = width // PARTS
    books = [first[:, p * part : (p + 1) * part].copy() for p in range(PARTS)]
    zero = F.lit(0).cast("long")
    if not width or not len(first):  # no rows, or none with a component
        return rows.select("id", "label", F.lit("00" * PARTS).alias("code"), zero.alias("error"), zero.alias("label_error")), books
    for _ in range(rounds):
        books = refine(rows, books, width)
    kind = rows.schema["label"].dataType.simpleString()
    return with_label_error(stash(rows.select("id", "label", "q").mapInArrow(_encode(books, width), f"id long, label {kind}, code string, error long"), "codes")), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    rows, books = encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    out = []
    for r in range(ROUNDS + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM (SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) AS d FROM p JOIN b{r} b USING (part))
 QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)""")
        if r < ROUNDS:
            out.append(f"""u{r} AS (SELECT part, entry, i, CAST(floor(sum(v)::DOUBLE / count(*)) AS BIGINT) AS v FROM (SELECT a.part, a.entry, unnest(range(len(p.x))) AS i, unnest(p.x) AS v FROM a{r} a JOIN p USING (vec_id, part)) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(u.x, b.x) AS x FROM b{r} b LEFT JOIN (SELECT part, entry, list(v ORDER BY i) AS x FROM u{r} GROUP BY ALL) u USING (part, entry))""")
    return ",\n".join(out)


OP11_SQL = f"""
WITH q AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, q[part * (len(q) // 8) + 1 : (part + 1) * (len(q) // 8)] AS x FROM (SELECT vec_id, q, unnest(range(8)) AS part FROM q)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p JOIN (SELECT vec_id FROM q ORDER BY vec_id LIMIT 16) USING (vec_id)),
{_rounds_sql()},
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(list_aggregate(x, 'string_agg', ','), ',' ORDER BY part, entry)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c JOIN q USING (vec_id), h
"""
