"""Removal of long repeated byte strings by bucket-pointer refinement.

Positions are sampled by minimizers (of 64 neighbouring 8-grams the smallest
hash), so a 400-byte string contains the sample of its first 64 starts with 336
bytes behind it, and no string escapes.  The samples are bucket-sorted as a
suffix sorter does:

* initial buckets: the 72-grams at all samples are sorted over the cluster and
  numbered in that order;
* a bucket is refined by sorting its members on the pair of their own bucket
  and the bucket of the 1st, 2nd, 4th sample behind, numbers being those of the
  round before, so every refinement is reused by the next and reach doubles;
* a member whose later sample reaches beyond its 336 bytes is closed and keeps
  its bucket; a bucket of one member is retired with its strings, and while it
  is open with all strings that hold its bytes.

What 336 bytes fix, sample distances, reach and bucket, is the same wherever
they stand, so equal strings end in one bucket.  The strings of a bucket are
then compared by 128-bit names, all of a sample's strings together first, one
by one where that leaves a bucket mixed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, text_volume
from .repeats import CHUNK_BYTES, U, Blocks, Names, WideNames, blocks_of, chunks, covered_tokens, eights, keys, mix, new_seed, spans_of, valid_windows

LENGTH = 400
SAMPLE = 64
_TABLE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    doc_start = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), doc_start


class Buckets:
    """Sampled positions of a chunk and their buckets.

    State, in text order: ``n`` (number of the sample; documents are apart by
    more than any step), ``a`` (its position), ``lo`` and ``hi`` (first and
    last start of the strings it stands for that are left), ``b`` (bucket),
    ``e`` (where the bytes end that its bucket says) and ``closed``.
    """

    def __init__(self, length: int):
        self.seed = new_seed()
        self.length, self.sample = length, max(1, min(SAMPLE, length // 4))
        self.gram = self.sample + 8
        self.right = length - self.sample  # bytes behind a sample that all its strings hold
        if self.right < self.gram:
            raise ValueError("strings are too short to be sampled")
        self.rounds = 1 + max(0, int(np.log2(2 * self.right / self.sample)))

    def begin(self, texts: list[bytes]) -> dict:
        data, doc_start = _tokens(texts)
        n, full = len(data), valid_windows(doc_start, self.gram)
        if not full.any():
            none = np.empty(0, np.int32)
            return {"n": none, "a": none, "lo": none, "hi": none, "e": none, "b": np.empty(0, U), "closed": np.empty(0, np.uint8)}
        # packed (hash of the 8-gram, position); the minimum over a window of starts is the leftmost smallest
        grams = np.zeros(n, U)
        m = n - 7
        for i in range(8):
            grams[:m] |= data[i : i + m].astype(U) << U(8 * i)
        packed = (mix(grams) & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
        width = 1
        while width < self.sample:
            step = min(width, self.sample - width)
            packed[: n - step] = np.minimum(packed[: n - step], packed[step:])
            width += step
        anchor = (packed & U(0xFFFFFFFF)).astype(np.int64)
        lo, hi = blocks_of(anchor, full)
        a = anchor[lo]
        doc = np.searchsorted(doc_start, a, side="right") - 1
        end = doc_start[doc + 1]
        number = np.arange(len(a)) + 64 * doc
        whole = a + self.gram <= end
        state = {"n": number, "a": a, "lo": lo, "hi": np.minimum(hi, end - self.length), "e": a + self.gram}
        state = {k: v[whole].astype(np.int32) for k, v in state.items()}
        at = a[whole]
        return state | {"b": Names(_TABLE[data])(at, at + self.gram), "closed": np.zeros(len(at), np.uint8)}

    def _later(self, round_: int, s: dict) -> tuple[np.ndarray, np.ndarray]:
        """Of each sample the later one to sort on, and whether it may: known, open, and not beyond the bytes all its strings hold."""
        want = s["n"] + (1 << (round_ - 2))
        j = np.minimum(np.searchsorted(s["n"], want), max(0, len(want) - 1))
        ok = (s["n"][j] == want) & (s["closed"] == 0) & (s["closed"][j] == 0) & (s["e"][j] <= s["a"] + self.right)
        return j, ok

    def keys(self, round_: int, s: dict) -> np.ndarray:
        if round_ == 1 or not len(s["n"]):
            return s["b"]
        j, ok = self._later(round_, s)
        return np.where(ok, mix(s["b"] * U(3) + mix(s["b"][j] * U(5) + (s["a"][j] - s["a"]).astype(U))), mix(s["b"] * U(7) + U(1)))

    def hear(self, round_: int, s: dict, numbers: np.ndarray) -> dict:
        s = dict(s, b=numbers)
        if not len(numbers):
            return s
        if round_ > 1:
            j, ok = self._later(round_, s)
            s["e"] = np.where(ok, np.maximum(s["e"], s["e"][j]), s["e"])
            s["closed"] = np.where(ok, s["closed"], 1).astype(np.uint8)
        gone = numbers == 0
        if gone.any():
            # an open sample's bucket is a function of its bytes: strings that hold them, and the start that makes it a sample, stand once;
            # so do all strings from nearest_end - length on (samples behind are samples within them)
            dead = gone & (s["closed"] == 0)
            ends = np.append(np.minimum.accumulate(s["e"][dead].astype(np.int64)[::-1])[::-1], np.int64(1) << 40)
            nearest_end = ends[np.searchsorted(s["a"][dead], s["a"])]
            # a closed sample's bucket says so of its own strings only
            hi = np.where(gone, -1, np.minimum(s["hi"], nearest_end - self.length - 1))
            s["hi"] = np.maximum(hi, -1).astype(np.int32)
        keep = ~gone
        if round_ == self.rounds:
            keep &= s["hi"] >= s["lo"]
        return {k: v[keep] for k, v in s.items()}

    def blocks(self, texts: list[bytes], s: dict) -> Blocks:
        data, doc_start = _tokens(texts)
        # a token is the eight bytes from a place on; those of a string are all inside it
        names = WideNames(mix(eights(data) ^ keys(self.seed, 1)))
        within = lambda a, e: names(a, e - 7)
        lo, hi = s["lo"].astype(np.int64), s["hi"].astype(np.int64)
        window = lambda at: within(at, at + self.length)
        # what the strings cover, and where in it the first one stands
        where = (hi - lo).astype(U) * U(4096) + (s["a"] - lo).astype(U)
        one, two = within(lo, hi + self.length)
        name = (mix(mix(one + where) + two), two)
        return Blocks(lo, hi, mix(s["b"]), name, window, doc_start)


_DDL = "id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _finish(with_text: bool):
    def finish(table: pa.Table, doc_start: np.ndarray, covered: np.ndarray) -> pa.Table:
        texts = table["text"].to_pylist()
        spans, kept = spans_of(covered, doc_start), []
        for text, cut in zip(texts, spans, strict=True):
            at, parts = 0, []
            for s, e in cut:
                parts.append(text[at:s])
                at = e
            kept.append(b"".join([*parts, text[at:]]))
        return pa.table(
            {
                "id": table["id"].cast(pa.int64()),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_removed": pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()),
                "spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPANS),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                "kept": pa.array(kept if with_text else [None] * len(kept), pa.binary()),
            }
        )

    return finish


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts elsewhere.

    Returns ``id``, ``n_bytes``, ``n_removed``, ``spans`` (byte offsets),
    ``kept_sha256`` and ``kept`` (null without ``with_text``).

    Null text is empty.  Overlapping and self-overlapping repeats count, whole
    copies of a text vanish if long enough, also where a row is repeated.
    Texts shorter than ``length`` stay.  Null ids are allowed; other columns
    are ignored; an empty table gives an empty result.
    """
    rows, volume = text_volume(docs, text_col)
    texts = own_columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    chunked, n_owners = chunks(texts, volume, rows, chunk_bytes)
    return covered_tokens(chunked, Buckets(length), _finish(with_text), _DDL, n_owners, length, first_stays=False)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: Every string of 400 bytes is a row here, so this is for small tables.
OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, unnest(list_transform(range(0, CAST(length(h) / 2 AS BIGINT) - 399), lambda i: struct_pack(i := i, k := md5_number(substr(h, 2 * i + 1, 800))))) AS x FROM d WHERE length(h) >= 800),
m AS (SELECT x.k AS k FROM k GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT doc_id, x.i AS i FROM k WHERE x.k IN (SELECT k FROM m)),
g AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 400 AS new FROM r),
n AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS e FROM n GROUP BY doc_id, run),
p AS (SELECT d.doc_id, s.a, s.e, coalesce(lag(s.e) OVER (PARTITION BY d.doc_id ORDER BY s.a), 0) AS before, d.h FROM d JOIN s USING (doc_id)),
o AS (SELECT doc_id, sum(e - a) AS gone, count(*) AS n, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(e) AS last FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)
"""
