"""Removal of repeated word windows by recompression.

Rounds of recompression rename a text's words: a run of one symbol becomes a
run symbol; then symbols are split in two classes by a bit of their name, and
every left symbol followed by a right one becomes a pair symbol.  The first two
levels are made inside documents, with names that are functions of the words.
From then on every level is a Spark round: owners number the distinct symbols
of all documents globally, and the next level's runs and pairs are made of
those numbers.  A symbol that stands once gets no number; it is taken out like
a document's end, and so are all windows that hold it.

Equal substrings get equal symbols, except near their ends, where a symbol may
depend on words outside.  For each symbol the range of words it depends on is
kept exactly; a symbol whose range lies inside a window is *interior* to it and
appears wherever the window's words appear.  A window's anchor is its interior
symbol of smallest hash among the highest level it has; windows without one
(such as long runs) are anchors themselves.  Shared high-level symbols show the
candidates, and 128-bit names of whole windows verify them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, text_volume
from .repeats import CHUNK_BYTES, U, Blocks, WideNames, blocks_of, chunks, covered_tokens, mix, new_seed, spans_of, valid_windows, word_names

WORDS = 20
#: Levels made inside documents, and levels numbered by Spark rounds (the first of these is the last of those).
LOCAL, ROUNDS = 2, 2
_FAR = 1 << 30


def recompress(s, doc, lo, hi, level: int):
    """One round over symbols ``s`` of documents ``doc`` that depend on words ``[lo, hi)``.

    A document's ends count as words outside, so symbols that depend on them
    are interior to no window.
    """
    # runs
    same = np.zeros(len(s), bool)
    same[1:] = (s[1:] == s[:-1]) & (doc[1:] == doc[:-1])
    at = np.flatnonzero(~same)
    last = np.append(at[1:], len(s)) - 1
    length = last - at + 1
    t = np.where(length > 1, mix(s[at] * U(7) + length.astype(U) * U(0x632BE59BD9B4E019)), s[at])
    d = doc[at]
    inner = np.zeros(len(at) + 1, bool)  # is there a neighbour across boundary i
    inner[1:-1] = d[1:] == d[:-1]
    # a run depends on the symbols that end it
    far = np.int64(1) << 40
    a = np.minimum.reduceat(lo, at)
    b = np.maximum.reduceat(hi, at)
    left = np.where(inner[:-1], lo[np.maximum(at - 1, 0)], -far)
    right = np.where(inner[1:], hi[np.minimum(last + 1, len(s) - 1)], far)
    a, b = np.minimum(a, left), np.maximum(b, right)
    # pairs
    salt = U(level * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)
    bit = (mix(t + salt) >> U(63)).astype(bool)  # True: right class
    join = np.zeros(len(t) + 1, bool)  # merge across boundary i
    join[1:-1] = inner[1:-1] & ~bit[:-1] & bit[1:]
    left = np.where(inner[:-1], np.append([-far], a[:-1]), -far)
    right = np.where(inner[1:], np.append(b[1:], [far]), far)
    alone = ~join[1:] & ~join[:-1]
    a2 = np.where(alone & bit, np.minimum(a, left), a)
    b2 = np.where(alone & ~bit, np.maximum(b, right), b)
    head = np.flatnonzero(~join[:-1])
    pair = join[1:][head]
    nxt = np.minimum(head + 1, len(t) - 1)
    name = np.where(pair, mix(t[head] * U(3) + mix(t[nxt])), t[head])
    return name, d[head], np.where(pair, np.minimum(a2[head], a2[nxt]), a2[head]), np.where(pair, np.maximum(b2[head], b2[nxt]), b2[head])


def _interval_flags(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in an interval ``[lo, hi]``."""
    ok = (hi >= 0) & (lo < n) & (lo <= hi)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(lo[ok], 0), 1)
    np.add.at(edge, np.minimum(hi[ok], n - 1) + 1, -1)
    return np.cumsum(edge)[:n] > 0


class Symbols:
    """Symbols of a chunk and the windows that are left.

    State: ``left`` (a bit per word: does a window that is left start there)
    with ``n`` words; the numbered symbols of all levels so far, in text order
    by level: ``level``, ``num``, ``seg`` (stretches without a gap), ``first``
    and ``last`` (words they depend on).  A level's names are made anew from the
    numbers below, so only numbers move.  After the last round: blocks.
    """

    rounds = ROUNDS

    def __init__(self, size: int):
        self.size, self.seed = size, new_seed()

    def begin(self, texts: list[bytes]) -> dict:
        words, doc_start = word_names(texts, self.seed)
        n = int(doc_start[-1])
        s, doc, lo = words, np.repeat(np.arange(len(texts)), np.diff(doc_start)), np.arange(n, dtype=np.int64)
        hi = lo + 1
        for level in range(1, LOCAL + 1):
            if len(s):
                s, doc, lo, hi = recompress(s, doc, lo, hi, level)
        none = np.empty(0, np.int32)
        state = {"left": np.packbits(valid_windows(doc_start, self.size)), "n": np.array([n], np.int32), "level": none, "num": np.empty(0, U), "seg": none, "first": none, "last": none}
        return state | {"now": (s, doc, np.clip(lo, -_FAR, _FAR), np.clip(hi, -_FAR, _FAR))}

    def _now(self, round_: int, s: dict) -> tuple:
        """The symbols of a round: names, stretches, and the words they depend on."""
        if "now" not in s:
            mine = s["level"] == round_ - 1
            below = s["num"][mine], s["seg"][mine].astype(np.int64), s["first"][mine].astype(np.int64), s["last"][mine].astype(np.int64)
            s["now"] = recompress(*below, LOCAL + round_ - 1) if mine.any() else below
        return s["now"]

    def keys(self, round_: int, s: dict) -> np.ndarray:
        return mix(self._now(round_, s)[0] + U(round_))

    def hear(self, round_: int, s: dict, numbers: np.ndarray) -> dict:
        n = int(s["n"][0])
        left = np.unpackbits(s["left"])[:n].astype(bool)
        _, seg, lo, hi = self._now(round_, s)
        inner = (hi - lo <= self.size) & (lo >= 0)
        # windows that hold the words of a symbol that stands once stand once
        once = inner & (numbers == 0)
        left &= ~_interval_flags(hi[once] - self.size, lo[once], n)
        # a symbol is kept while a window that is left holds its words
        before = np.concatenate([[0], np.cumsum(left)])
        a, b = np.clip(hi - self.size, 0, n), np.clip(lo + 1, 0, n)
        keep = inner & (numbers > 0) & (before[np.maximum(a, b)] > before[a])
        gap = np.cumsum(~keep) + seg * 2
        mine = {
            "level": np.full(int(keep.sum()), round_, np.int32),
            "num": numbers[keep],
            "seg": np.cumsum(np.diff(gap[keep], prepend=-1) != 0).astype(np.int32),
            "first": lo[keep].astype(np.int32),
            "last": hi[keep].astype(np.int32),
        }
        out = {"left": np.packbits(left), "n": s["n"]} | {k: np.concatenate([s[k], v]) for k, v in mine.items()}
        return self._anchors(out, left, n) if round_ == self.rounds else out

    def _anchors(self, s: dict, left: np.ndarray, n: int) -> dict:
        """Blocks of windows with one anchor: ``lo``, ``hi``, the anchor's number, level (0: the window itself) and first word."""
        # packed: level from the top, hash of the number, which symbol
        best, which = np.full(n, U(0xFFFFFFFFFFFFFFFF), U), np.arange(len(s["num"]), dtype=U)
        p, last = s["first"].astype(np.int64), s["last"].astype(np.int64)
        room, r = self.size - (last - p), ((ROUNDS - s["level"]).astype(U) << U(60)) | ((mix(s["num"]) >> U(38)) << U(34)) | which
        for back in range(self.size):
            near = (room >= back) & (p >= back)
            p, room, r = p[near], room[near], r[near]
            if not len(p):
                break
            np.minimum.at(best, p - back, r)
        chosen = best != U(0xFFFFFFFFFFFFFFFF)
        symbol = (best & U((1 << 34) - 1)).astype(np.int64)
        lo, hi = blocks_of(np.where(chosen, symbol, len(which) + np.arange(n, dtype=np.int64)), left)
        own = ~chosen[lo]
        if not len(which):
            none = np.zeros(len(lo), np.int32)
            return {"lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "num": np.zeros(len(lo), U), "level": none, "where": lo.astype(np.int32)}
        k = np.where(own, 0, symbol[lo])
        found = {"lo": lo, "hi": hi, "level": np.where(own, 0, s["level"][k]), "where": np.where(own, lo, s["first"][k])}
        return {c: v.astype(np.int32) for c, v in found.items()} | {"num": np.where(own, U(0), s["num"][k])}

    def blocks(self, texts: list[bytes], s: dict) -> Blocks:
        words, doc_start = word_names(texts, self.seed)
        names = WideNames(mix(words))
        window = lambda at: names(at, at + self.size)
        lo, hi, where = (s[c].astype(np.int64) for c in ("lo", "hi", "where"))
        key = np.where(s["level"] == 0, names.both[0](lo, lo + self.size), mix(s["num"] * U(4) + s["level"].astype(U)))
        shape = (hi - lo).astype(U) * U(64) + (where - lo + self.size).astype(U)
        one, two = names(lo, hi + self.size)
        name = (mix(mix(one * U(3) + shape) + two), two)
        return Blocks(lo, hi, key, name, window, doc_start)


_DDL = "id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _finish(with_text: bool):
    def finish(table: pa.Table, doc_start: np.ndarray, covered: np.ndarray) -> pa.Table:
        spans, kept = spans_of(covered, doc_start), []
        for text, cut in zip(table["text"].to_pylist(), spans, strict=True):
            words, at, left = text.split(), 0, []
            for s, e in cut:
                left += words[at:s]
                at = e
            kept.append(b" ".join(left + words[at:]))
        return pa.table(
            {
                "id": table["id"].cast(pa.int64()),
                "n_words": pa.array(np.diff(doc_start), pa.int64()),
                "n_removed": pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()),
                "spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPANS),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                "kept": pa.array(kept if with_text else [None] * len(kept), pa.binary()),
            }
        )

    return finish


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, with_text: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Remove every word covered by a window of ``size`` words that also starts earlier.

    Earlier: a smaller id, or earlier in the document.  Returns ``id``,
    ``n_words``, ``n_removed``, ``spans`` (word offsets), ``kept_sha256`` and
    ``kept`` (kept words joined by a space; null without ``with_text``).

    Null text has no words.  Null ids come before all others, repeated ids are
    ordered by text, rows equal in both stand in either order, which gives the
    same results.  Texts below ``size`` words stay whole.  Other columns are
    ignored; an empty table gives an empty result.
    """
    rows, volume = text_volume(docs, text_col)
    texts = own_columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    chunked, n_owners = chunks(texts, volume, rows, chunk_bytes)
    return covered_tokens(chunked, Symbols(size), _finish(with_text), _DDL, n_owners, size, first_stays=True)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
k AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: struct_pack(i := i, k := md5(array_to_string(w[i:i+19], ' '))))) AS x FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, x.i AS i FROM k QUALIFY row_number() OVER (PARTITION BY x.k ORDER BY doc_id, x.i) > 1),
c AS (SELECT doc_id, list(DISTINCT j) AS c FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM r) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(c), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN c IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(c, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
