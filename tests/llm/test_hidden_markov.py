"""The hidden Markov language model against plain sums over all state paths."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from netquill.llm import hidden_markov as hmm

SCHEMA = "doc_id long, text string, id int, word string, n long, row int, codes string, base string, rare int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", 2, 3, "c", "b", 4) for i, t in rows], SCHEMA)


def model(k, c, seed=1):
    r = np.random.default_rng(seed)
    emit, step, start = r.random((c, k)) + 0.01, r.random((k, k)), r.random(k)
    return hmm.Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def paths(m, s):
    for path in itertools.product(range(len(m.start)), repeat=len(s)):
        p = m.start[path[0]] * m.emit[s[0], path[0]]
        for t in range(1, len(s)):
            p *= m.step[path[t - 1], path[t]] * m.emit[s[t], path[t]]
        yield path, p


def test_likelihood_and_counts_over_all_paths():
    m, r = model(3, 5), np.random.default_rng(2)
    seqs = [r.integers(0, 5, n) for n in (1, 4, 6, 2, 6, 1, 5)]
    start, steps, emissions, total = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), []
    for s in seqs:
        all_ = list(paths(m, s))
        p = sum(x for _, x in all_)
        total.append(math.log(p))
        for path, x in all_:
            start[path[0]] += x / p
            for t, j in enumerate(path):
                emissions[s[t], j] += x / p
                if t:
                    steps[path[t - 1], j] += x / p
    assert np.allclose(hmm.likelihood(m, seqs), total, rtol=1e-12)
    got = hmm.expected(m, seqs)
    for a, b in zip(got, (start, steps, emissions, sum(total)), strict=True):
        assert np.allclose(a, b, rtol=1e-5, atol=1e-5)


def test_rounds_raise_the_likelihood(monkeypatch):
    monkeypatch.setattr(hmm, "EMIT_PRIOR", 1e-6)
    monkeypatch.setattr(hmm, "STEP_PRIOR", 1e-6)
    r = np.random.default_rng(3)
    seqs = [np.concatenate([r.integers(0, 4, 20), r.integers(4, 8, 20)]) for _ in range(30)]
    shares = np.full(8, 1 / 8)
    m, last = hmm.initial(shares, 2), -np.inf
    for _ in range(12):
        *counts, now = hmm.expected(m, seqs)
        assert now >= last - 1e-3
        m, last = hmm.maximise(*counts, shares), now
    assert last > 1200 * math.log(1 / 8) + 500


def corpus(seed=1, n=260):
    r = random.Random(seed)
    kinds = [[f"{c}{i}" for i in range(60)] for c in "abc"]
    rows = []
    for i in range(n):
        k = r.choice(kinds)
        rows.append((i, r.choice([" ", "\n", "\t\x0b"]).join(w.upper() if r.random() < 0.1 else w for w in r.choices(k, [1 / (j + 1) for j in range(60)], k=r.randint(1, 60)))))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "Straße\xa0x " * 40), (n + 4, " ".join(r.choices(kinds[0] + kinds[1], k=20_000))), (None, "a1 a2 new"), (None, None), (5, rows[5][1]), (5, "a1 other"), (n + 5, "never seen " + "z" * 200)]
    rows += [(i, "only held out words here") for i in range(400, 500) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    return rows


def words_of(text):
    return (text or "").encode().lower().split()


FREQUENT, HASHED = 20, 8
SMALL = {"states": 3, "frequent": FREQUENT, "hashed": HASHED}


def check(rows, got, words, m):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not held(i) for w in words_of(t))
    ends = sum(not held(i) for i, _ in rows)
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    top = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0])) if len(w) <= hmm.LONGEST_WORD]
    least = count[top[FREQUENT]] if len(top) > FREQUENT else 0
    top = [w for w in top if count[w] > least]
    assert list(words.frequent) == top and (words.tokens, words.distinct) == (n, v)
    room = [1] * HASHED
    for w, c in count.items():
        if w not in top:
            room[zlib.crc32(w) % HASHED] += c + 1
    assert words.room.tolist() == room
    want = []
    for i, t in rows:
        w = words_of(t)
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        a, total = None, 0.0
        for x in [*w, None]:
            share = 1.0
            if x is None:
                c = FREQUENT + HASHED
            elif x in top:
                c = top.index(x)
            else:
                h = zlib.crc32(x) % HASHED
                c, share = FREQUENT + h, (count[x] + 1) / room[h]
            a = (m.start if a is None else a @ m.step) * m.emit[c]
            total += math.log10(a.sum()) + math.log10(share)
            a = a / a.sum()
        want.append((i, held(i), len(w) + 1, sum(x in count for x in w) + (ends > 0), n, base, total))
    key = lambda r: (str(r[0]), r[2], r[5])
    have = sorted((tuple(r) for r in got.collect()), key=key)
    want.sort(key=key)
    assert [h[:5] for h in have] == [w[:5] for w in want]
    assert np.allclose([h[5:] for h in have], [w[5:] for w in want], rtol=1e-9, atol=1e-9)
    return have


def test_scores_against_plain_recursion(spark):
    rows = corpus()
    got, words, m = hmm.language_scores(frame(spark, rows).repartition(5), **SMALL, with_parts=True)
    have = check(rows, got, words, m)
    # a distribution: classes sum to one in every state, words and one unseen word to one in every shared class
    assert np.allclose(m.emit.sum(0), 1) and np.allclose(m.step.sum(1), 1) and np.isclose(m.start.sum(), 1)
    out = [h for h in have if h[1] and h[2] > 5]
    assert sum(h[6] for h in out) > sum(h[5] for h in out)


def test_rows_do_not_depend_on_partitions(spark):
    rows = corpus(2)
    key = lambda r: (str(r["id"]), r["n_tokens"], r["base_score"])
    a, b = (sorted(hmm.language_scores(frame(spark, rows).repartition(n), **SMALL).collect(), key=key) for n in (1, 7))
    assert np.allclose([r["score"] for r in a], [r["score"] for r in b], rtol=1e-3)


def test_nothing_to_learn_from(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows = [(i, "a b " * 3) for i in held] + [(held[0], None)]
    got, words, m = hmm.language_scores(frame(spark, rows), **SMALL, with_parts=True)
    check(rows, got, words, m)
    assert hmm.language_scores(frame(spark, []), **SMALL).count() == 0


def test_query(spark):
    got = hmm.op13_language_scores(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert got.where("score is null or score > 0 or base_score > 0").count() == 0
