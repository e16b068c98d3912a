"""Exact dedup by exchange of Golomb-coded fingerprints.

1. Every part of the table turns its texts into 256-bit digests.  The first
   64 bits are the fingerprint; the top of a fingerprint names its owner.
2. A part sends each owner its sorted distinct fingerprints as one
   Golomb-Rice coded gap list, never the texts.
3. An owner decodes what it got, finds fingerprints that occur twice, and
   answers each part with a bitmap over the list it had sent.
4. Parts apply the bitmaps: rows whose fingerprint occurs twice are suspects,
   all others are proven single.
5. Only suspects' texts move; grouping by the text itself compares the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, own_columns, stash

#: Distinct suspect digests that may be broadcast to filter the second scan (32 bytes each); beyond it the scan is joined by shuffle.
BROADCAST_DIGESTS = 200_000
#: Fingerprints an owner holds at once, about.
OWNER_ROWS = 2_000_000


def rice_encode(values: np.ndarray) -> tuple[int, int, bytes]:
    """Golomb-Rice code of sorted distinct uint64 values: ``(first value, parameter, bits of the gaps)``."""
    if not len(values):
        return 0, 0, b""
    gaps = np.diff(values)
    mean = max(1.0, float(values[-1] - values[0]) / len(values))
    k = min(63, int(np.log2(mean)))
    quot = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quot + 1)  # a unary part is quot zeros and a one
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
    return int(values[:1].view(np.int64)[0]), k, np.packbits(np.concatenate([unary, low.ravel()])).tobytes()


def rice_decode(n: int, base: int, k: int, blob: bytes) -> np.ndarray:
    """Inverse of :func:`rice_encode` for ``n`` values."""
    if not n:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    out = np.empty(n, np.uint64)
    out[:1] = np.array([base], np.int64).view(np.uint64)
    if n > 1:
        ends = np.flatnonzero(bits)[: n - 1]
        quot = np.diff(ends, prepend=-1) - 1
        low = bits[ends[-1] + 1 : ends[-1] + 1 + (n - 1) * k].reshape(n - 1, k)
        rest = (low.astype(np.uint64) << np.arange(k, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
        out[1:] = (quot.astype(np.uint64) << np.uint64(k)) + rest
    return np.cumsum(out, dtype=np.uint64)


def _prints(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([int.from_bytes(x[:8], "big") for x in column.to_pylist()], np.uint64)


def _owners(prints: np.ndarray, n: int) -> np.ndarray:
    return ((prints >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _send(n_owners: int):
    def send(table: pa.Table) -> pa.Table:
        prints = np.unique(_prints(table["digest"]))
        owner = _owners(prints, n_owners)
        rows = []
        for o in np.unique(owner):
            mine = prints[owner == o]
            base, k, blob = rice_encode(mine)
            rows.append({"owner": int(o), "part": table["part"][0].as_py(), "n": len(mine), "base": base, "k": k, "blob": blob})
        return pa.Table.from_pylist(rows, schema=pa.schema([("owner", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("base", pa.int64()), ("k", pa.int32()), ("blob", pa.binary())]))

    return send


def _answer(table: pa.Table) -> pa.Table:
    lists = [rice_decode(r["n"], r["base"], r["k"], r["blob"]) for r in table.select(["n", "base", "k", "blob"]).to_pylist()]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = values[counts > 1]
    maps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
    return pa.table({"part": table["part"], "owner": table["owner"], "bitmap": pa.array(maps, pa.binary())})


def _apply(n_owners: int):
    def apply(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({"digest": pa.array([], pa.binary())})
        prints = _prints(rows["digest"])
        values, counts = np.unique(prints, return_counts=True)
        owner, suspect = _owners(values, n_owners), counts > 1
        for r in answers.to_pylist():
            at = np.flatnonzero(owner == r["owner"])
            suspect[at] |= np.unpackbits(np.frombuffer(r["bitmap"], np.uint8))[: len(at)].astype(bool)
        hit = suspect[np.searchsorted(values, prints)]
        return pa.table({"digest": rows["digest"].filter(pa.array(hit)).unique()})

    return apply


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts equal after lower-casing A-Z only.

    Returns one row per input row: ``id``, ``keep_id`` (largest id of the
    group), ``group_size``, ``kept``, ``text_sha256``.

    Null text counts as empty.  Null ids are never the largest; a group of
    null ids only keeps them.  Repeated rows with one id all say ``kept`` when
    their id is the group's largest.  An empty table gives an empty result;
    other columns are ignored.
    """
    texts = own_columns(docs, id=id_col, text=text_col).select("id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    digest = F.unhex(F.sha2(F.col("norm").cast("binary"), 256))
    table = stash(texts.select(F.spark_partition_id().cast("long").alias("part"), "id", digest.alias("digest")), "digests")
    rows = table.count()
    n_owners = max(1, -(-rows // OWNER_ROWS), min(12, rows))
    sent = table.groupBy("part").applyInArrow(_send(n_owners), "owner long, part long, n long, base long, k int, blob binary")
    answers = sent.groupBy("owner").applyInArrow(_answer, "part long, owner long, bitmap binary")
    suspects = stash(table.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_apply(n_owners), "digest binary").distinct(), "suspects")
    few = suspects.count() <= BROADCAST_DIGESTS
    moved = texts.withColumn("digest", digest).join(F.broadcast(suspects) if few else suspects, "digest", "left_semi")
    # Grouping by the text compares bytes; copies meet map-side first, so a hot text moves once per task.
    same = moved.groupBy("digest", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    checked = same.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.count(F.lit(1)).alias("texts"),
    ).withColumn("group_size", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest"))).otherwise(F.col("group_size")))
    keep = F.coalesce("keep_id", "id")
    return table.join(checked.drop("texts"), "digest", "left").select(
        "id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


OP9_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, coalesce(g.keep_id, n.doc_id) AS keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       n.doc_id IS NOT DISTINCT FROM coalesce(g.keep_id, n.doc_id) AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
