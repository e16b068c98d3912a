"""Language-model scores by a hidden Markov model trained over all documents.

A token is a word or the end of a text.  States emit *classes* of tokens: every
frequent word is a class of its own, other words share hashed classes, the end
is a class.  Given its class a rare word has its smoothed share of the class's
corpus counts, so the model is a distribution over all token sequences, words
never seen included, while what is broadcast (states x classes) is bounded by
parameters and the vocabulary stays a table.

1. Words are counted over all training texts and summed up by Spark.
2. Whole texts become class numbers, once; rare words go by shuffle to their
   counts, one entry a text and word.
3. A round of Baum-Welch is a pass over the stored class numbers: tasks run
   forward and backward over many texts side by side and return expected counts
   as integers, which Spark adds up.
4. The scaled forward recursion gives every text's exact likelihood.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_batches, own_columns, stash, trim

#: States, words with a class of their own (the most frequent, as many as stand above a count), shared classes; the end makes one more. Together below 2^16.
STATES, FREQUENT, HASHED = 8, 24_000, 4_096
#: Longer words have no class of their own, which bounds what is broadcast.
LONGEST_WORD = 64
#: Shares of the training texts, by hash, that the rounds of Baum-Welch run over: all of them, each text once.
SLICES = (1 / 16, 1 / 16, 1 / 8, 1 / 4, 1 / 2)
#: What counts of earlier rounds weigh in the next.
KEEP = 0.25
#: Weight of the overall class shares in every state's emissions, in tokens, and of even steps between states.
EMIT_PRIOR, STEP_PRIOR = 400.0, 1.0
#: Expected counts are handed on in these fractions, so that their sums do not depend on the order of adding.
UNIT = 1 << 16
#: Tokens that are trained or scored side by side; a training sequence is a text's next so many tokens at most.
SIDE_BY_SIDE, STRETCH = 1 << 20, 4_096
WORDS_HELD = 400_000


class Model:
    """``start`` (states), ``step`` (state to state), ``emit`` (classes x states)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit


def initial(shares: np.ndarray, states: int, seed: int = 7) -> Model:
    """States that start as perturbed copies of the overall shares."""
    r = np.random.default_rng(seed)
    emit = shares[:, None] * r.gamma(2.0, 0.5, (len(shares), states)) + 1e-300
    step = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(0))


def _side_by_side(sequences: list[np.ndarray]):
    """Tokens of sequences by step, at every step those of the longest sequences first; how many each step has; the sequences' order."""
    size = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
    at = np.cumsum(alive) - alive
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    tokens = np.empty(len(step), np.int64)
    tokens[at[step] + np.repeat(np.arange(len(size)), size)] = np.concatenate([sequences[i] for i in order])
    return tokens, at.tolist(), alive.tolist(), order


def likelihood(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log of the probability of every sequence, by the scaled forward recursion."""
    if not sequences:
        return np.empty(0)
    tokens, begin, alive, order = _side_by_side(sequences)
    total = np.zeros(len(order))
    a = np.broadcast_to(model.start, (len(order), len(model.start)))
    for t, (o, n) in enumerate(zip(begin, alive, strict=True)):
        a = (a[:n] @ model.step if t else a[:n]) * model.emit[tokens[o : o + n]]
        scale = a.sum(1)
        total[:n] += np.log(scale)
        a /= scale[:, None]
    out = np.empty(len(order))
    out[order] = total
    return out


def expected(model: Model, sequences: list[np.ndarray]):
    """Expected counts of starts, steps and emissions, and the log likelihood of all sequences."""
    tokens, begin, alive, _ = _side_by_side(sequences)
    k = len(model.start)
    single = np.float32
    step, emit = model.step.astype(single), model.emit.astype(single)
    forward, seen, scales = np.empty((len(tokens), k), single), emit[tokens], np.empty(len(tokens), single)
    a = np.broadcast_to(model.start.astype(single), (alive[0], k))
    for t, (o, n) in enumerate(zip(begin, alive, strict=True)):
        a = (a[:n] @ step if t else a[:n]) * seen[o : o + n]
        scale = a.sum(1)
        a /= scale[:, None]
        forward[o : o + n], scales[o : o + n] = a, scale
    seen /= scales[:, None]
    steps, back = np.zeros((k, k)), step.T.copy()
    m, b = 0, np.ones((0, k), single)
    for t in range(len(alive) - 1, -1, -1):
        o, n = begin[t], alive[t]
        alpha, beta = forward[o : o + n], np.ones((n, k), single)
        if m:
            w = seen[o + n : o + n + m] * b
            steps += alpha[:m].T @ w
            np.matmul(w, back, out=beta[:m])
        alpha *= beta  # from here on the chance of each state
        m, b = n, beta
    emissions = np.stack([np.bincount(tokens, forward[:, j], len(emit)) for j in range(k)], 1)
    return forward[: alive[0]].sum(0, dtype=np.float64), steps * model.step, emissions, float(np.log(scales, dtype=np.float64).sum())


def maximise(start: np.ndarray, steps: np.ndarray, emissions: np.ndarray, shares: np.ndarray) -> Model:
    emit = emissions + EMIT_PRIOR * shares[:, None]
    step, start = steps + STEP_PRIOR / len(start), start + STEP_PRIOR / len(start)
    return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


@dataclass
class Words:
    """What is known of the training words: bounded by the number of classes."""

    frequent: dict[bytes, int]  # word -> class
    counts: np.ndarray  # of the classes that are words, then the end
    tokens: int
    distinct: int
    room: np.ndarray  # of every shared class: its tokens and distinct words, and one more for unseen ones

    @property
    def end(self) -> int:
        """The class of the end; those from ``first_shared`` to it are shared."""
        return self.first_shared + len(self.room)

    @property
    def first_shared(self) -> int:
        return len(self.counts) - 1

    @property
    def shares(self) -> np.ndarray:
        all_ = np.concatenate([self.counts[:-1], self.room - 1.0, self.counts[-1:]]) + 0.5
        return all_ / all_.sum()


class Classes(dict):
    """Classes of words; a word without one of its own gets its shared class."""

    def __init__(self, words: Words):
        super().__init__(words.frequent)
        self.first, self.number = words.first_shared, len(words.room)

    def __missing__(self, word: bytes) -> int:
        return self.first + zlib.crc32(word) % self.number


def count_words(batches):
    """Words of the texts with their counts, and a null word for the ends."""
    held, ends = Counter(), 0

    def out(words, counts):
        return pa.record_batch({"word": pa.array(words, pa.binary()), "n": pa.array(counts, pa.int64())})

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(text.lower().split())  # of bytes: A-Z only, six kinds of space
            ends += 1
            if len(held) > WORDS_HELD:
                yield out(list(held), list(held.values()))
                held = Counter()
    yield out([*held, None], [*held.values(), ends])
    trim()


def vocabulary(texts: DataFrame) -> DataFrame:
    """``word`` (binary; null: the end) and ``n`` over ``texts`` (one binary column)."""
    return stash(texts.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "vocabulary")


def known_words(vocab: DataFrame, frequent: int = FREQUENT, hashed: int = HASHED) -> Words:
    r = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    words = vocab.where(F.col("word").isNotNull())
    short = words.where(F.octet_length("word") <= LONGEST_WORD)
    # the count from which on words are few enough; how many words have a count is a short table
    least, room_left = None, frequent
    for h in short.groupBy("n").agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("n")).limit(frequent).collect():
        room_left -= h["v"]
        if room_left < 0:
            break
        least = h["n"]
    top = [] if least is None else sorted(short.where(F.col("n") >= least).collect(), key=lambda w: (-w["n"], w["word"]))
    counts, room = np.zeros(frequent + 1, np.int64), np.ones(hashed, np.int64)
    ends = vocab.where(F.col("word").isNull()).first()
    counts[frequent] = ends["n"] if ends else 0
    for b in words.groupBy((F.crc32("word") % hashed).alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        room[b["k"]] += b["n"] + b["v"]
    own = {}
    for i, w in enumerate(top):
        word = bytes(w["word"])
        own[word], counts[i] = i, w["n"]
        room[zlib.crc32(word) % hashed] -= w["n"] + 1
    return Words(own, counts, r["n"], r["v"], room)


_CODED = "id long, held_out boolean, codes binary, n_tokens long, n_known long, base double, shared double, rare array<struct<word:binary,n:long>>"
_RARE = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))


def _encode(shared):
    def encode(batches):
        words: Words = shared.value
        classes, first, end = Classes(words), words.first_shared, words.end
        log_count = np.zeros(end + 1)
        log_count[[*range(first), end]] = np.log10(words.counts + 1.0)
        is_known = np.zeros(end + 1, np.int64)
        is_known[[*range(first), end]] = words.counts > 0
        log_room = np.zeros(end + 1)
        log_room[first:end] = np.log10(words.room)
        for batch in batches:
            cols = [[] for _ in range(6)]
            for text in batch.column(2).to_pylist():
                tokens = text.lower().split()
                code = np.array([*map(classes.__getitem__, tokens), end], np.uint16)
                rare = Counter(tokens[i] for i in np.flatnonzero((code >= first) & (code < end)).tolist())
                found = (code.tobytes(), len(code), int(is_known[code].sum()), float(log_count[code].sum()), float(log_room[code].sum()), [{"word": w, "n": n} for w, n in rare.items()])
                for c, v in zip(cols, found, strict=True):
                    c.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), _RARE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["id", "held_out", "codes", "n_tokens", "n_known", "base", "shared", "rare"])
        trim()

    return encode


def _groups(batches, column: int):
    """Rows of batches, with class numbers, in groups of about SIDE_BY_SIDE tokens."""
    rows, codes, size = [], [], 0
    for batch in batches:
        for i, c in enumerate(batch.column(column).to_pylist()):
            rows.append((batch, i))
            codes.append(np.frombuffer(c, "<u2"))
            size += len(codes[-1])
            if size >= SIDE_BY_SIDE:
                yield rows, codes
                rows, codes, size = [], [], 0
    if rows:
        yield rows, codes


def _expect(shared):
    def expect(batches):
        model: Model = shared.value
        k, total = len(model.start), None
        for _, codes in _groups(batches, 0):
            start, steps, emissions, _ = expected(model, [c[a : a + STRETCH] for c in codes for a in range(0, len(c), STRETCH)])
            found = np.concatenate([emissions, steps, start[None]])
            total = found if total is None else total + found
        if total is not None:
            whole = np.rint(total * UNIT).astype(np.int64)
            cell = np.flatnonzero(whole.any(axis=1))
            yield pa.record_batch({"cell": pa.array(cell, pa.int32()), **{f"s{j}": pa.array(whole[cell, j], pa.int64()) for j in range(k)}})
        trim()

    return expect


def baum_welch(coded: DataFrame, words: Words, states: int = STATES, slices: tuple = SLICES) -> Model:
    """Train over ``coded`` (``codes``, ``at`` in [0, 1)): a round a slice, expected counts added up by Spark."""
    shares, n = words.shares, words.end + 1
    model, kept, low = initial(shares, states), np.zeros((n + states + 1, states)), 0.0
    ddl = "cell int, " + ", ".join(f"s{j} long" for j in range(states))
    for i, share in enumerate(slices):
        high = 1.1 if i == len(slices) - 1 else low + share
        shared = coded.sparkSession.sparkContext.broadcast(model)
        part = coded.where((F.col("at") >= low) & (F.col("at") < high)).select("codes").mapInArrow(_expect(shared), ddl)
        found = np.zeros_like(kept)
        for r in part.groupBy("cell").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(states)]).collect():
            found[r["cell"]] = [r[f"s{j}"] / UNIT for j in range(states)]
        kept, low = KEEP * kept + found, high
        model = maximise(kept[n + states], kept[n : n + states], kept[:n], shares)
    return model


def _score(shared):
    def score(batches):
        model: Model = shared.value
        for rows, codes in _groups(batches, 1):
            found = likelihood(model, codes) / math.log(10)
            yield pa.record_batch({"row": pa.array([b.column(0)[i].as_py() for b, i in rows], pa.int64()), "hidden": pa.array(found, pa.float64())})
        trim()

    return score


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, frequent: int = FREQUENT, hashed: int = HASHED, slices: tuple = SLICES, with_parts: bool = False):
    """One row per row of ``docs``: ``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Held out are rows whose crc32(id as text) mod 7 is 2; a row without id is
    learnt from.  A-Z are lower-cased; a text is its words, then one end.
    ``score`` is the log10 probability under the hidden Markov model,
    ``base_score`` that of single words with one added to every count.

    Null and empty texts are an end alone.  Repeated rows are learnt from and
    scored each.  Without training rows every token is unknown and the states
    are those of the start.  Whole texts count; an empty table gives no rows.
    Other columns are ignored.  ``with_parts`` returns the words and model too.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    texts = own_columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    vocab = vocabulary(texts.where(~held).select("text"))
    words = known_words(vocab, frequent, hashed)
    coded = texts.select("id", held.alias("held_out"), "text").mapInArrow(_encode(spark.sparkContext.broadcast(words)), _CODED)
    # a row's number and place among the slices are written, so they stay what they are
    at = F.pmod(F.xxhash64("id", "codes"), F.lit(1 << 20)) / float(1 << 20)
    coded = stash(coded.withColumn("row", F.monotonically_increasing_id()).withColumn("at", at), "coded")
    model = baum_welch(coded.where("not held_out").select("codes", "at"), words, states, slices)

    hidden = coded.select("row", "codes").mapInArrow(_score(spark.sparkContext.broadcast(model)), "row long, hidden double")
    rare = coded.select("row", F.explode("rare").alias("w")).select("row", F.col("w.word").alias("word"), F.col("w.n").alias("n"))
    seen = vocab.select(F.col("word").alias("_word"), F.col("n").alias("c"))
    rare = rare.join(seen, F.col("word") == F.col("_word"), "left")
    sums = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("counted"))
    out = coded.drop("codes", "rare", "at").join(hidden, "row").join(sums, "row", "left")
    counted = F.coalesce("counted", F.lit(0.0))
    width = math.log10(words.tokens + words.distinct + 1)
    out = out.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + counted - F.col("n_tokens") * F.lit(width)).alias("base_score"),
        (F.col("hidden") + counted - F.col("shared")).alias("score"),
    )
    return (out, words, model) if with_parts else out


def op13_language_scores(spark, sf_dir: str) -> DataFrame:
    return language_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
