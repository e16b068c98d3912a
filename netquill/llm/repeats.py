"""Repeated windows of token sequences, found by rounds of numbering and of key exchange.

Shared by suffix-array dedup (tokens are bytes) and substring dedup (tokens
are words).  A *window* is ``size`` consecutive tokens of one document.  The
two differ in the *items* they number and in how a window picks its *anchor*
among them, which depends on the window's content alone, so equal windows have
equal anchors wherever they stand.

Documents are dealt into chunks by a hash.  Every round is a shuffle from
chunks to owners of key ranges and one back; a chunk sends sorted distinct
keys only, so a passage that a third of all rows share costs one entry a chunk.

* Numbering rounds: owners sort the keys of all items and number, in that
  order, those that stand more than once; what stands once is retired, and so
  are the windows that hold it.  The next round's keys are made of the numbers.
* Consecutive windows left with one anchor form a *block*, with ``key`` (the
  anchor's number) and ``name`` (of everything the block's windows cover).
  Owners answer: alone; all blocks of the key repeat as they are; mixed.
* Chunks spell out the windows of mixed blocks, one message a distinct window;
  owners answer which windows stand elsewhere, and chunks mark covered tokens.

What decides is 112 bits of a block (48 of its anchor's number, 64 of an
independent name of all it covers) or 128 of a window (two independent names).
Names are keyed by a secret of the run, so they meet by chance only, whatever
the texts are; bytes are not compared.  All rounds read one shuffle of the texts by chunk; between numbering
rounds only the items that are left move.
"""

from __future__ import annotations

import pickle
import secrets
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 3 << 20
#: Text whose keys one owner gets, about.
OWNER_BYTES = 32 << 20
U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SINGLE, COVERED, SPELL, COVERED_SPELL, FIRST_HERE = range(5)
ASK, STATE, ANSWER, BLOCK, CODES, WINDOW, HITS = range(7)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(n, U(b), U)
            t[0] = 1
            tables.append(np.cumprod(t))
        _POWERS[base] = (tables[0], tables[1])
    return _POWERS[base][0][:n], _POWERS[base][1][:n]


class Names:
    """Names of ranges of a row of 64-bit token names, by one running sum."""

    def __init__(self, tokens: np.ndarray, base: int = _BASES[0]):
        up, self.down = powers(len(tokens) + 1, base)
        self.sums = np.zeros(len(tokens) + 1, U)
        np.cumsum(tokens * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


class WideNames:
    """Two names of each range, the second from tokens scrambled anew."""

    def __init__(self, tokens: np.ndarray):
        self.both = [Names(tokens, _BASES[0]), Names(mix(tokens + U(_BASES[1])), _BASES[1])]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.both[0](start, end), self.both[1](start, end)


#: Keeps the first 0 to 8 bytes of a little-endian number.
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def new_seed() -> int:
    """A run's secret: names are keyed by it, so no text can be written to make two of them meet."""
    return secrets.randbits(63)


def keys(seed: int, n: int) -> np.ndarray:
    return mix(U(seed) + np.arange(1, n + 1, dtype=U) * U(0xA0761D6478BD642F))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place of ``data`` but its last seven, as numbers."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def word_names(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of the texts in a row, and the number of words before each text (and in all).

    Every eight bytes of a word are scrambled with a key of their place, so a
    name is no linear function of the bytes; words of up to eight bytes have
    different names if they differ at all in bytes of one length.
    """
    padded = np.frombuffer(b" ".join(texts) + b" " * 8, np.uint8)
    data = padded[: len(padded) - 7]
    edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True))
    start, end = edge[::2], edge[1::2]
    text_start = np.cumsum([0] + [len(t) + 1 for t in texts])
    size = end - start
    pieces = (size + 7) >> 3
    first = np.cumsum(pieces) - pieces
    j = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    at = np.repeat(start, pieces) + 8 * j
    x = eights(padded)[at] & _FIRST_BYTES[np.minimum(np.repeat(end, pieces) - at, 8)]
    x = mix(x ^ keys(seed, int(pieces.max(initial=0)))[j])
    names = mix((np.add.reduceat(x, first) if len(first) else x) + size.astype(U) * U(0x9E3779B97F4A7C15))
    return names, np.searchsorted(start, text_start).astype(np.int64)


@dataclass
class Blocks:
    """Blocks of a chunk in document order; ``lo`` and ``hi`` are window starts counted over the chunk's tokens."""

    lo: np.ndarray
    hi: np.ndarray
    key: np.ndarray
    name: tuple[np.ndarray, np.ndarray]
    window: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    doc_start: np.ndarray  # first token of each document, and the end


def blocks_of(anchor: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start of each run of valid windows with one anchor."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(anchor[at].astype(np.int64)) != 0)) + 1
    return at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]


def valid_windows(doc_start: np.ndarray, size: int) -> np.ndarray:
    ok = np.zeros(int(doc_start[-1]), bool)
    for a, b in zip(doc_start[:-1], doc_start[1:], strict=True):
        if b - a >= size:
            ok[a : b - size + 1] = True
    return ok


def _groups(*keys: np.ndarray):
    """Of rows with several keys: the order of distinct rows (each by its first), their counts, every row's group, and whether it is the first of it."""
    n = len(keys[0])
    order = np.lexsort((np.arange(n), *keys[::-1]))
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.zeros(n, bool)
    first[order[new]] = True
    return order[new], np.bincount(number, minlength=int(new.sum())), number, first


def _spelled(b: Blocks, codes: np.ndarray, number: np.ndarray, first: np.ndarray):
    """Window starts of the first of each block to spell out, and the windows' names."""
    pick = np.flatnonzero(first & ((codes[number] == SPELL) | (codes[number] == COVERED_SPELL)))
    size = (b.hi - b.lo + 1)[pick]
    at = np.repeat(b.lo[pick] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return at, b.window(at)


def _slices(keys: np.ndarray, n_owners: int):
    owner = ((keys >> U(32)) * U(n_owners) >> U(32)).astype(np.int64)
    at = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, e in zip(at, np.append(at, len(owner))[1:], strict=True):
        yield int(owner[a]), a, e


_ROW = "to int, sender int, kind int, a binary, b binary, c binary"
_FIELDS = [("to", pa.int32()), ("sender", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.table([pa.array(c, k) for c, (_, k) in zip(cols, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def _of(table: pa.Table, kind: int) -> list[dict]:
    return sorted((r for r in table.to_pylist() if r["kind"] == kind), key=lambda r: r["sender"])


def _pack(state: dict[str, np.ndarray]) -> bytes:
    """Arrays as planes of bytes, signed ones as steps, so that shuffles can compress them."""
    out = {}
    for k, v in state.items():
        x = np.diff(v, prepend=v.dtype.type(0)) if v.dtype.kind == "i" else v
        out[k] = (v.dtype.str, np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"")
    return pickle.dumps(out)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    out = {}
    for k, (kind, planes) in pickle.loads(blob).items():
        width = np.dtype(kind).itemsize
        x = np.frombuffer(planes, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()
        out[k] = np.cumsum(x, dtype=x.dtype) if x.dtype.kind == "i" else x
    return out


#: Bits of a key that are asked with: two keys that agree in 48 bits get one number, which costs a comparison and loses nothing.
_ASKED = U(0xFFFFFFFFFFFF0000)


def _asked(keys: np.ndarray, chunk: int, n_owners: int) -> list[tuple]:
    values, count = np.unique(keys & _ASKED, return_counts=True)
    steps = lambda a, e: _pack({"k": (values[a:e] >> U(16)).astype(np.int64)})
    return [(o, chunk, ASK, steps(a, e), np.packbits(count[a:e] > 1).tobytes(), None) for o, a, e in _slices(values, n_owners)]


def _numbers(keys: np.ndarray, answers: list[dict], n_owners: int) -> np.ndarray:
    """Every key's global number, 0 for those that stand once."""
    values, inverse = np.unique(keys & _ASKED, return_inverse=True)
    found = np.zeros(len(values), U)
    by_owner = {r["sender"]: r for r in answers}
    for o, a, e in _slices(values, n_owners):
        r = by_owner[o]
        again = np.unpackbits(np.frombuffer(r["a"], np.uint8))[: e - a].astype(bool)
        found[a:e][again] = (U(o) << U(32)) | np.frombuffer(r["b"], np.uint32).astype(U)
    return found[inverse]


def _number(table: pa.Table) -> pa.Table:
    """An owner's part of a numbering round; states only pass."""
    asks, out = _of(table, ASK), [(r["to"], r["sender"], STATE, r["a"], None, None) for r in _of(table, STATE)]
    if asks:
        keys = [_unpack(r["a"])["k"] for r in asks]
        many = np.concatenate([np.unpackbits(np.frombuffer(r["b"], np.uint8))[: len(k)] for r, k in zip(asks, keys, strict=True)])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        again = (np.bincount(inverse) > 1) | (np.bincount(inverse, many) > 0)
        rank, at = (np.cumsum(again) * again).astype(np.uint32)[inverse], 0
        for r, k in zip(asks, keys, strict=True):
            mine = rank[at : at + len(k)]
            out.append((r["sender"], r["to"], ANSWER, np.packbits(mine > 0).tobytes(), mine[mine > 0].tobytes(), None))
            at += len(k)
    return _rows(out)


def _received(rows: list[dict]):
    """Keys, names, order of document and whether a chunk has it more than once, of all entries; and entries per row."""
    a = [np.stack([*_unpack(r["a"]).values()], 1).astype(U) for r in rows]
    sizes = [len(x) for x in a]
    many = np.concatenate([np.unpackbits(np.frombuffer(r["b"], np.uint8))[:n] for r, n in zip(rows, sizes, strict=True)]).astype(bool)
    order = [np.stack([*_unpack(r["c"]).values()], 1) if r["c"] else np.zeros((n, 2), U) for r, n in zip(rows, sizes, strict=True)]
    return np.concatenate(a).T, np.concatenate(order).T, many, sizes


def _replies(rows: list[dict], kind: int, codes: np.ndarray, sizes: list[int]) -> pa.Table:
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return _rows([(r["sender"], r["to"], kind, codes[a:b].astype(np.uint8).tobytes(), None, None) for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True)])


def _judge_blocks(first_stays: bool):
    def judge(table: pa.Table) -> pa.Table:
        rows = _of(table, BLOCK)
        (key, *name), order_of, many, sizes = _received(rows)
        order = np.lexsort((*order_of[::-1], *name, key))
        k = key[order]
        new_k = np.ones(len(order), bool)
        new_k[1:] = k[1:] != k[:-1]
        new_n = new_k.copy()
        for n in name:
            new_n[1:] |= n[order][1:] != n[order][:-1]
        gk, gn = np.cumsum(new_k) - 1, np.cumsum(new_n) - 1
        entries = np.bincount(gn) + np.bincount(gn, many[order])
        repeats = entries[gn] > 1
        kinds = np.bincount(gk, new_n)[gk]  # distinct names under the key
        codes = np.full(len(order), SINGLE, np.uint8)
        if first_stays:
            codes[repeats & ~new_n] = COVERED  # stands in an earlier document as it is
            codes[repeats & new_n & (kinds == 1)] = FIRST_HERE
            codes[new_n & (kinds > 1)] = SPELL
        else:
            all_repeat = (np.bincount(gk, ~repeats) == 0)[gk]
            codes[repeats] = COVERED
            codes[repeats & new_n & ~all_repeat] = COVERED_SPELL  # one chunk speaks for all
            codes[~repeats & (kinds > 1)] = SPELL
        back = np.empty(len(order), np.uint8)
        back[order] = codes
        return _replies(rows, CODES, back, sizes)

    return judge


def _judge_windows(first_stays: bool):
    def judge(table: pa.Table) -> pa.Table:
        rows = _of(table, WINDOW)
        name, order_of, many, sizes = _received(rows)
        order = np.lexsort((*order_of[::-1], *name[::-1]))
        new = np.ones(len(order), bool)
        new[1:] = (name[:, order][:, 1:] != name[:, order][:, :-1]).any(axis=0)
        g = np.cumsum(new) - 1
        hit = ~new if first_stays else (np.bincount(g) + np.bincount(g, many[order]))[g] > 1
        back = np.empty(len(order), np.uint8)
        back[order] = hit
        return _replies(rows, HITS, back, sizes)

    return judge


def _doc_order(table: pa.Table) -> np.ndarray:
    """Two numbers a document that sort as (id, text) does: the id, nulls first, and the text's first three bytes."""
    ids = np.array([0 if i is None else max(1, i + (1 << 63)) for i in table["id"].to_pylist()], U)
    return np.stack([ids, np.array([int.from_bytes(t[:3].ljust(3, b"\0"), "big") for t in table["text"].to_pylist()], U)])


def chunks(texts: DataFrame, volume: int, rows: int, chunk_bytes: int) -> tuple[DataFrame, int]:
    """``texts`` (``id``, ``text``) with a ``chunk``, and the number of owners.

    Texts of one id that begin alike share a chunk, so that the order of their
    documents is the order of the whole texts.
    """
    n = max(1, min(rows, -(-volume // min(chunk_bytes, max(1 << 18, volume // 12)))))
    return texts.select(F.pmod(F.xxhash64("id", F.substring("text", 1, 3)), F.lit(n)).cast("int").alias("chunk"), "id", "text"), max(1, min(n, -(-volume // OWNER_BYTES)))


def covered_tokens(chunked: DataFrame, items, finish: Callable, result_ddl: str, n_owners: int, size: int, first_stays: bool) -> DataFrame:
    """Run all rounds.

    ``chunked`` has ``chunk`` (int), ``id`` and ``text`` (binary).  ``items``
    says what is numbered: ``rounds``, ``begin(texts)`` (state of a chunk),
    ``keys(round, state)``, ``hear(round, state, numbers)`` (next state) and
    ``blocks(texts, state)``.  ``finish(table, doc_start, covered)`` turns a
    chunk and its covered tokens into result rows.
    """

    def ordered(table: pa.Table) -> pa.Table:
        return table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_start"))

    def begin(table: pa.Table) -> pa.Table:
        table = ordered(table)
        return _rows(_asked(items.keys(1, items.begin(table["text"].to_pylist())), table["chunk"][0].as_py(), n_owners))

    def heard(round_: int, state: dict, answers: list[dict], chunk: int) -> pa.Table:
        state = items.hear(round_, state, _numbers(items.keys(round_, state), answers, n_owners))
        packed = _pack(state)
        asks = _asked(items.keys(round_ + 1, state), chunk, n_owners) if round_ < items.rounds else []
        return _rows([*asks, (chunk, chunk, STATE, packed, None, None)])

    def hear_first(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _rows([])
        table = ordered(table)
        return heard(1, items.begin(table["text"].to_pylist()), _of(answers, ANSWER), table["chunk"][0].as_py())

    def hear(round_: int):
        def step(table: pa.Table) -> pa.Table:
            states = _of(table, STATE)
            return heard(round_, _unpack(states[0]["a"]), _of(table, ANSWER), states[0]["to"]) if states else _rows([])

        return step

    def parsed(table: pa.Table, replies: pa.Table):
        table = ordered(table)
        b = items.blocks(table["text"].to_pylist(), _unpack(_of(replies, STATE)[0]["a"]))
        b.key &= _ASKED
        order, count, number, first = _groups(b.key, b.name[0])
        return table, b, order, count, number, first, np.frombuffer(b"".join(r["a"] for r in _of(replies, CODES)), np.uint8)

    def places(table: pa.Table, b: Blocks, at: np.ndarray) -> np.ndarray | None:
        return _doc_order(table)[:, np.searchsorted(b.doc_start, at, side="right") - 1] if first_stays else None

    def message(kind: int, chunk: int, cols: np.ndarray, many: np.ndarray, order_of) -> pa.Table:
        # sorted by their first column, whose upper 48 bits (a block's key has no more) go as steps
        pack = lambda x: _pack({"0": (x[0] >> U(16)).astype(np.int64), **({} if kind == BLOCK else {"low": x[0] & U(0xFFFF)}), "1": x[1]})
        return _rows([(o, chunk, kind, pack(cols[:, a:e]), np.packbits(many[a:e]).tobytes(), None if order_of is None else _pack({"id": order_of[0, a:e], "text": order_of[1, a:e]})) for o, a, e in _slices(cols[0], n_owners)])

    def send_blocks(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return _rows([])
        table, b, order, count, *_ = parsed(table, replies)
        return message(BLOCK, table["chunk"][0].as_py(), np.stack([b.key, b.name[0]])[:, order], count > 1, places(table, b, b.lo[order]))

    def send_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return _rows([])
        table, b, _, _, number, first, codes = parsed(table, replies)
        if not len(b.lo):
            return _rows([])
        at, names = _spelled(b, codes, number, first)
        order, count, _, _ = _groups(*names)
        return message(WINDOW, table["chunk"][0].as_py(), np.stack(names)[:, order], count > 1, places(table, b, at[order]))

    def cover(table: pa.Table, replies: pa.Table) -> pa.Table:
        table, b, _, _, number, first, codes = parsed(table, replies)
        n = int(b.doc_start[-1])
        edge = np.zeros(n + 1, np.int64)  # window starts covered, as a difference row
        if len(b.lo):
            mine = codes[number]
            whole = (mine == COVERED) | (mine == COVERED_SPELL)
            if first_stays:
                whole |= ~first & ((mine == FIRST_HERE) | (mine == SPELL))
            np.add.at(edge, b.lo[whole], 1)
            np.add.at(edge, b.hi[whole] + size, -1)
            at, names = _spelled(b, codes, number, first)
            if len(at):
                _, _, group, lead = _groups(*names)
                hit = np.frombuffer(b"".join(r["a"] for r in _of(replies, HITS)), np.uint8).astype(bool)[group]
                if first_stays:
                    hit |= ~lead  # windows stand in document order, so the first is the earliest
                np.add.at(edge, at[hit], 1)
                np.add.at(edge, at[hit] + size, -1)
        return finish(table, b.doc_start, np.cumsum(edge)[:n] > 0)

    def judged(rows: DataFrame, judge: Callable) -> DataFrame:
        # an exchange of its own, which all later rounds read again
        return rows.groupBy("to").applyInArrow(judge, _ROW).repartition("to")

    by_chunk = chunked.groupBy("chunk")
    answers = by_chunk.applyInArrow(begin, _ROW).groupBy("to").applyInArrow(_number, _ROW)
    state = by_chunk.cogroup(answers.groupBy("to")).applyInArrow(hear_first, _ROW)
    for r in range(2, items.rounds + 1):
        state = state.groupBy("to").applyInArrow(_number, _ROW).groupBy("to").applyInArrow(hear(r), _ROW)
    state = state.repartition("to")
    codes = judged(by_chunk.cogroup(state.groupBy("to")).applyInArrow(send_blocks, _ROW), _judge_blocks(first_stays))
    known = state.unionByName(codes)
    hits = judged(by_chunk.cogroup(known.groupBy("to")).applyInArrow(send_windows, _ROW), _judge_windows(first_stays))
    return by_chunk.cogroup(known.unionByName(hits).groupBy("to")).applyInArrow(cover, result_ddl)


def spans_of(covered: np.ndarray, doc_start: np.ndarray) -> list[list[tuple[int, int]]]:
    """Maximal covered runs of each document, counted from its first token."""
    out = []
    for a, b in zip(doc_start[:-1], doc_start[1:], strict=True):
        c = np.concatenate([[0], covered[a:b].astype(np.int8), [0]])
        d = np.flatnonzero(np.diff(c))
        out.append(list(zip(d[::2].tolist(), d[1::2].tolist(), strict=True)))
    return out
