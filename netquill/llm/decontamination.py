"""Benchmark decontamination by q-gram lemma filtering.

Every stretch of 100 characters of a benchmark item is looked for.  A text
region within k edits of a stretch of m characters shares at least
``m - q + 1 - k q`` of its q-grams with it, all on diagonals (text offset minus
item offset) at most k apart.  Shared q-grams are counted for whole items in
diagonal bands that overlap by k; in bands that reach the bound they are counted
again per stretch, and a banded alignment decides.

The benchmark is indexed by a Spark job in files of bounded size; a search task
holds one of them at a time.  Shared q-grams are counted slice by slice, so
memory does not grow with how often a q-gram stands in texts and items.
"""

from __future__ import annotations

import pickle
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh_dir, lean_batches, own_columns, range_bounds, shard_of, stash, trim
from .repeats import U, Names, mix

Q = 12
PASSAGE, STEP = 100, 50
#: One edit for so many characters of a passage.
CHARS_PER_EDIT = 20
#: Width of the diagonal bands without their overlap.
BAND = 16
#: Benchmark bytes of one index file.
BLOCK_CHARS = 4 << 20
FILTER_BITS = 22
#: Characters searched at once; a longer text is cut into pieces that overlap by more than a match with its band is long.
TEXT_CHARS, OVERLAP = 1 << 18, 512
#: Pairs of equal q-grams (text, item) that are expanded at once.
SLICE = 1 << 20
#: Text that meets one index file after another, where there are several.
GROUP_BYTES = 32 << 20
#: A character repeated more often in a row counts so many times: rules and padding are layout.
REPEAT = 8
#: Runs of a period of so many characters at most are searched as if they were about KEPT characters long, which is
#: three times a match and its band: all places of a rule meet all places of another.
PERIOD, KEPT = 32, 640
_RUNS = re.compile(r"(.)\1{%d,}" % REPEAT, re.DOTALL)


def normalise(text: str | None) -> str:
    """Lower case, runs of white space as one space, REPEAT of a character at most in a row."""
    return _RUNS.sub(lambda m: m[1] * REPEAT, " ".join((text or "").lower().replace("\0", " ").split()))


def squeeze(text: str) -> tuple[str, list[tuple[int, int]]]:
    """``text`` with every long run of one period cut to about KEPT characters, and what was cut: (place in the result, characters).

    Whole periods go from the inside of a run, so it keeps every stretch of a
    match's length that it has, and the text around it is as far away.
    """
    if len(text) < 2 * KEPT:
        return text, []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    # a run that long covers one of these places with 2 * PERIOD characters behind it
    near = np.lib.stride_tricks.sliding_window_view(codes[: len(codes) - len(codes) % (KEPT // 2)].reshape(-1, KEPT // 2)[:, : 2 * PERIOD], PERIOD, axis=1)
    periods = np.flatnonzero((near[:, 1:] == near[:, :1]).all(axis=2).any(axis=0)) + 1
    cut = np.zeros(len(codes), bool)
    for p in periods.tolist():
        same = np.concatenate([[False], codes[p:] == codes[:-p], [False]])
        edge = np.flatnonzero(np.diff(same.astype(np.int8)))
        for a, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            drop = (e + p - a - KEPT) // p * p  # the run is [a, e + p)
            if drop > 0 and not cut[a : e + p].any():
                cut[a + KEPT // 2 : a + KEPT // 2 + drop] = True
    if not cut.any():
        return text, []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8)))
    cuts, gone = [], 0
    for a, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        cuts.append((a - gone, e - a))
        gone += e - a
    return codes[~cut].tobytes().decode("utf-32-le", "surrogatepass"), cuts


def _unsqueezed(a: int, e: int, cuts: list[tuple[int, int]]) -> tuple[int, int]:
    """A span of the whole text: one that reaches across a cut covers it."""
    return a + sum(n for at, n in cuts if at <= a), e + sum(n for at, n in cuts if at < e)


def passages(text: str) -> list[str]:
    """Pieces of PASSAGE characters every STEP; the last ends with the text. Below Q characters: none."""
    if len(text) < Q:
        return []
    if len(text) <= PASSAGE + STEP // 2:
        return [text]
    starts = [*range(0, len(text) - PASSAGE, STEP), len(text) - PASSAGE]
    return [text[a : a + PASSAGE] for a in starts]


def stretches(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of all that is looked for: every PASSAGE characters in a row, and the whole text if it is one piece."""
    start, size = [], []
    if len(text) > PASSAGE:
        start = list(range(len(text) - PASSAGE + 1))
        size = [PASSAGE] * len(start)
    if passages(text) == [text]:
        start, size = [*start, 0], [*size, len(text)]
    return np.array(start, np.int64), np.array(size, np.int64)


def budget(m: int) -> int:
    """Edits allowed in a passage of ``m`` characters: one in CHARS_PER_EDIT, fewer where the lemma would say nothing."""
    return max(0, min(m // CHARS_PER_EDIT, (m - Q) // Q))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _grams(codes: np.ndarray) -> np.ndarray:
    if len(codes) < Q:
        return np.empty(0, U)
    at = np.arange(len(codes) - Q + 1)
    return Names(mix(codes + U(1)))(at, at + Q)


@dataclass
class Index:
    """Items of one block of the benchmark and where their q-grams stand."""

    items: list
    texts: list[str]
    grams: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    table: np.ndarray
    codes: list[np.ndarray]

    @classmethod
    def build(cls, rows: list[tuple]) -> Index:
        items, texts = [], []
        for item, text in rows:
            t, _ = squeeze(normalise(text))
            if len(t) >= Q:
                items.append(item)
                texts.append(t)
        codes = [_codes(t) for t in texts]
        g = [_grams(c) for c in codes]
        flat = np.concatenate(g) if g else np.empty(0, U)
        owner = np.repeat(np.arange(len(g)), [len(x) for x in g])
        offset = np.concatenate([np.arange(len(x)) for x in g]) if g else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        grams, first = np.unique(flat[order], return_index=True)
        table = np.zeros(1 << FILTER_BITS, bool)
        table[grams >> U(64 - FILTER_BITS)] = True
        return cls(items, texts, grams, np.append(first, len(flat)), owner[order], offset[order], table, codes)


def align(patterns: list[np.ndarray], text: np.ndarray, start: np.ndarray, width: int, bounds: np.ndarray | None = None) -> np.ndarray:
    """Least edits between each pattern and a substring of ``text``, on the ``width`` diagonals from ``start`` on.

    Entry w of row j stands for pattern[:j] against text that ends at
    ``start + j + w``.  Only the band is held; all pairs advance together.
    Outside its bounds, which ``bounds`` may narrow for each pair, ``text``
    matches nothing.
    """
    if not patterns:
        return np.empty(0, np.int64)
    m = np.array([len(p) for p in patterns])
    pat = np.zeros((len(patterns), int(m.max())), np.uint64)
    for i, p in enumerate(patterns):
        pat[i, : len(p)] = p
    at = start[:, None] + np.arange(pat.shape[1] + width)[None]
    low, high = (0, len(text)) if bounds is None else (bounds[:, :1], bounds[:, 1:])
    inside = (at >= low) & (at < high)
    near = np.where(inside, text[np.clip(at, 0, len(text) - 1)], U(0xFFFFFFFF))
    row, step, best = np.zeros((len(patterns), width), np.int32), np.arange(width, dtype=np.int32), np.zeros(len(patterns), np.int64)
    for j in range(pat.shape[1]):
        new = row + (near[:, j : j + width] != pat[:, j : j + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = (np.minimum.accumulate(new - step, axis=1) + step).astype(np.int32)
        done = m == j + 1
        if done.any():
            best[done] = row[done].min(axis=1)
    return best


def _pieces(texts: list[str]):
    """``(text number, offset, piece)`` in groups of about TEXT_CHARS characters."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - OVERLAP), TEXT_CHARS - OVERLAP):
            piece = t[a : a + TEXT_CHARS]
            if group and size + len(piece) > TEXT_CHARS:
                yield group
                group, size = [], 0
            group.append((i, a, piece))
            size += len(piece)
    if group:
        yield group


def _slices(size: np.ndarray):
    """Ranges of entries whose sizes sum to about SLICE (one entry may have more)."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        yield at, end
        at = end


def find(texts: list[str], index: Index) -> list[list[tuple]]:
    """``(item, start, end)`` of the matches in each normalised text; bounds are those of the band, overlapping matches of an item are one."""
    hits: dict = {}
    if len(index.grams):
        short = [squeeze(t) for t in texts]
        for group in _pieces([t for t, _ in short]):
            for d, i, a, e in _search([g[2] for g in group], index):
                doc, offset, _ = group[d]
                hits.setdefault((doc, i), []).append(_unsqueezed(offset + a, offset + e, short[doc][1]))
    found: list[list[tuple]] = [[] for _ in texts]
    for (doc, i), own in sorted(hits.items()):
        spans: list[list[int]] = []
        for a, e in sorted(own):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([a, e])
        found[doc] += [(index.items[i], a, e) for a, e in spans]
    return found


def _search(texts: list[str], index: Index) -> set[tuple]:
    """``(text, item number, start, end)`` of the bands that hold a stretch of the item."""
    whole = "\0".join(texts)
    codes = _codes(whole)
    grams = _grams(codes)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    at = np.flatnonzero(index.table[grams >> U(64 - FILTER_BITS)])
    slot = np.searchsorted(index.grams, grams[at])
    slot[slot == len(index.grams)] = 0
    real = index.grams[slot] == grams[at]
    at, slot = at[real], slot[real]
    if not len(at):
        return set()
    size = index.starts[slot + 1] - index.starts[slot]
    # of an item's stretches the whole has the most edits, PASSAGE characters need the fewest q-grams
    m = np.array([len(t) for t in index.texts])
    k = np.array([budget(len(t) if passages(t) == [t] else PASSAGE) for t in index.texts])
    need = np.array([_need(min(len(t), PASSAGE)) for t in index.texts])
    pad = int(m.max()) + BAND
    n_bands = (len(whole) + pad) // BAND + 3

    def pairs(a, b):
        """Band and item offset of every pair of equal q-grams among text q-grams ``a`` to ``b``; a band is (text, item, band)."""
        s = size[a:b]
        posts = np.repeat(index.starts[slot[a:b]] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
        where = np.repeat(at[a:b], s)
        item, offset = index.item[posts], index.offset[posts]
        low = where - offset + pad  # never negative
        band = ((np.searchsorted(begin, where, side="right") - 1) * len(m) + item) * n_bands + low // BAND + 1
        # a diagonal also counts for the band before it if it lies in the overlap
        again = low % BAND <= k[item]
        return np.concatenate([band, band[again] - 1]), np.concatenate([offset, offset[again]])

    bands, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for a, b in _slices(size):
        new, n = np.unique(pairs(a, b)[0], return_counts=True)
        bands, inverse = np.unique(np.concatenate([bands, new]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([counts, n]), len(bands)).astype(np.int64)
    bands = bands[counts >= need[bands // n_bands % len(m)]] if len(bands) else bands
    if not len(bands):
        return set()
    # per band the item's offsets that are shared: a bit each, so a q-gram met often in a band is kept once
    shared: list[set] = [set() for _ in bands]
    for a, b in _slices(size):
        band, offset = pairs(a, b)
        slot_of = np.searchsorted(bands, band)
        slot_of[slot_of == len(bands)] = 0
        hit = bands[slot_of] == band
        for i, o in set(zip(slot_of[hit].tolist(), offset[hit].tolist(), strict=True)):
            shared[i].add(o)
    sure, rest = set(), []

    def settle():
        edits = align([index.codes[i][f : f + n] for _, i, f, n, _, _ in rest], codes, np.array([x[5] for x in rest], np.int64), BAND + 3 * int(k.max()) + 1, np.array([(begin[x[0]], begin[x[0] + 1] - 1) for x in rest], np.int64).reshape(-1, 2))
        sure.update((d, i, *span) for (d, i, _, n, span, _), c in zip(rest, edits, strict=True) if c <= budget(n))
        rest.clear()

    wanted: dict = {}  # per item its stretches, their lengths and the q-grams they need
    covered: dict = {}  # per (text, item) the last range of sure spans that join up
    for number, own in zip(bands.tolist(), shared, strict=True):
        d, i, b = number // n_bands // len(m), number // n_bands % len(m), number % n_bands - 1
        if i not in wanted:
            start, long = stretches(index.texts[i])
            wanted[i] = start, long, np.array([_need(x) for x in long.tolist()], np.int64)
        start, long, least = wanted[i]
        have = np.zeros(int(m[i]) + 1, np.int64)
        have[np.fromiter(own, np.int64, len(own)) + 1] = 1
        have = np.cumsum(have)
        enough = have[start + long - Q + 1] - have[start] >= least
        first, size_of = start[enough], long[enough]
        diagonal = b * BAND - pad - int(k[i])
        low = np.maximum(int(begin[d]), diagonal + first)
        high = np.minimum(int(begin[d + 1]) - 1, diagonal + first + BAND + 3 * int(k[i]) + size_of)

        def stands(j):
            """Whether a stretch stands as it is; then its span joins what is covered."""
            a, e, f = int(low[j]), int(high[j]), int(first[j])
            if whole.find(index.texts[i][f : f + int(size_of[j])], a, e) < 0:
                return False
            sure.add((d, i, a - int(begin[d]), e - int(begin[d])))
            before = covered.get((d, i))
            joins = before is not None and before[0] <= a <= before[1]
            covered[d, i] = (before[0], max(e, before[1])) if joins else (a, e)
            return True

        at_ = 0
        while at_ < len(first):
            reach = covered.get((d, i))
            if reach and reach[0] <= low[at_] <= reach[1]:
                if high[at_] <= reach[1]:  # adds nothing, nor do those that end before
                    at_ = int(np.searchsorted(high, reach[1], side="right"))
                    continue
                # the furthest stretch that still joins: if it stands, those before it add nothing
                far = int(np.searchsorted(low, reach[1], side="right")) - 1
                if far > at_ and stands(far):
                    at_ = far + 1
                    continue
            if not stands(at_):
                f, n = int(first[at_]), int(size_of[at_])
                rest.append((d, i, f, n, (int(low[at_] - begin[d]), int(high[at_] - begin[d])), diagonal + f))
                if len(rest) >= 500:
                    settle()
            at_ += 1
    settle()
    return sure


def _need(m: int) -> int:
    """Shared q-grams without which no region is within the budget of ``m`` characters."""
    return max(1, m - Q + 1 - budget(m) * Q)


def write_index(benchmark: DataFrame, block_bytes: int) -> list[str]:
    """Index files of a benchmark (``id``, ``text``), of bounded size each; the driver sees their names only."""
    spark = benchmark.sparkSession
    root = fresh_dir(spark, "benchmark-index")
    fs, path = filesystem(root)
    fs.create_dir(path, recursive=True)
    rows = benchmark.where("text is not null")
    bounds = range_bounds(rows.select("id", (F.octet_length("text") + 8).alias("w")), "id", "w", block_bytes)
    dealt = rows.select(shard_of("id", bounds).cast("int").alias("block"), "id", "text").repartitionById(max(1, len(bounds)), F.col("block"))

    def build(batches):
        fs, path = filesystem(root)
        block, size, made = [], 0, []

        def close():
            name = f"{path}/index-{uuid.uuid4().hex}"
            with fs.open_output_stream(name, compression=None) as f:
                f.write(pickle.dumps(Index.build(block)))
            made.append(name)

        for batch in batches:
            for i, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                block.append((i, t))
                size += len(t)
                if size >= 2 * block_bytes:
                    close()
                    block, size = [], 0
        if block:
            close()
        yield pa.record_batch({"name": pa.array(made, pa.string())})

    # a repeated task may leave a file behind; only names that were reported are read
    names = stash(dealt.sortWithinPartitions("block", F.col("id").asc_nulls_first(), "text").mapInArrow(build, "name string"), "benchmark-index")
    return sorted(r["name"] for r in names.collect())


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", bench_text_col: str = "text", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``bench_items`` (ids found, ascending) and ``bench_spans``.

    A document is found with an item if it holds any 100 characters in a row of
    the item (or the whole item if it has no more than 125) with at most one
    edit in 20 characters, lower-cased, with runs of white space as one space
    and no character more than 8 times in a row.  Spans are offsets into the
    text so normalised, as wide as the band.

    Null and empty texts hold nothing; null items and items of fewer than 12
    characters cannot be found; items of one text are all reported.  Columns of
    the added names are replaced.  Whole texts are searched, long ones in
    overlapping pieces.
    """
    lean_batches(docs.sparkSession)
    docs = docs.drop("bench_items", "bench_spans")
    columns, at = docs.columns, docs.columns.index(text_col)
    span = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    items = own_columns(benchmark, id=id_col, text=bench_text_col).withColumn("id", F.col("id").cast("long"))
    files = write_index(items, BLOCK_CHARS)
    root = fresh_dir(docs.sparkSession, "")

    def run(batches):
        fs, _ = filesystem(root)
        kept: dict = {}

        def load(name):
            if name not in kept:
                kept.clear()
                with fs.open_input_file(name) as f:
                    kept[name] = pickle.loads(f.read())
            return kept[name]

        def search(group):
            texts = [[normalise(t) for t in b.column(at).to_pylist()] for b in group]
            found = [[[] for _ in t] for t in texts]
            for name in files:
                for t, own in zip(texts, found, strict=True):
                    for old, new in zip(own, find(t, load(name)), strict=True):
                        old += new
            for b, own in zip(group, found, strict=True):
                rows = [[{"item": x, "start": a, "end": e} for x, a, e in f] for f in own]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, span)], names=[*columns, "bench_spans"])

        group, size = [], 0
        for batch in batches:
            group.append(batch)
            size += batch.nbytes
            if len(files) < 2 or size >= GROUP_BYTES:
                yield from search(group)
                group, size = [], 0
        if group:
            yield from search(group)
        trim()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInArrow(run, f"{fields}, bench_spans array<struct<item:long,start:long,end:long>>")
    return out.withColumn("bench_items", F.array_sort(F.array_distinct(F.transform("bench_spans", lambda x: x["item"]))))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select("doc_id", (F.size("bench_items") > 0).alias("contaminated"), F.size("bench_items").cast("long").alias("n_items"), "bench_items")
