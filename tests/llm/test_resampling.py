"""Importance resampling against a plain loop."""

import hashlib
import math
import random
import re
import zlib

import pytest

from netquill.llm import resampling

SCHEMA = "doc_id long, text string, id int, buckets string, score string, weight int, here long, step long, n long, total string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "b", "s", 2, 3, 4, 5, "t") for i, t in rows], SCHEMA)


def features(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, longest=1, percent=10):
    docs = [(i, *features(t, longest)) for i, t in rows]
    s, t = [0] * 10_000, [0] * 10_000
    for _, _, f in docs:
        for b in f:
            s[b] += 1
    for x in target:
        for b in features(x, longest)[1]:
            t[b] += 1
    ss, tt = sum(s), sum(t)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10_000) / ((s[b] + 1) * (tt + 10_000))))
    out = []
    for i, n, f in docs:
        w = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((o for o in out if o[1] >= 20), key=lambda o: (-o[4], o[0] is None, o[0] or 0, o[3], o[2]))
    ranks = {}
    for k, o in enumerate(fit[: percent * len(fit) // 100]):
        ranks.setdefault(o, []).append(k + 1)
    return sorted(((o[0], *o[2:], ranks[o].pop() if ranks.get(o) else None) for o in out), key=str)


def corpus(seed, n=400):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["Éclair", "über", "naïve", "日本語", "x9", "9"]
    rows = [(i, r.choice([" ", "-", ".\n", "_"]).join(r.choice(vocab).upper() if r.random() < 0.2 else r.choice(vocab) for _ in range(r.randint(1, 80)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "... \t"), (n + 3, "word " * 20), (n + 4, "word " * 19), (n + 5, " ".join(r.choice(vocab) for _ in range(60_000)))]
    rows += [(None, rows[0][1] * 30), (5, rows[5][1]), (5, rows[6][1] + rows[7][1]), (6, rows[6][1])]
    return rows


@pytest.mark.parametrize("seed,longest,percent", [(1, 1, 10), (2, 1, 55), (3, 3, 10), (4, 1, 100), (5, 2, 0)])
def test_against_loop(spark, seed, longest, percent):
    rows, target = corpus(seed), [None, "", "w1 w2 w3 Éclair w4 " * 5, "w150-w151"]
    bench = spark.createDataFrame([(t, "x", 1) for t in target], "text string, buckets string, n int")
    got = resampling.resample(frame(spark, rows), bench, longest=longest, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, target, longest, percent)


def test_many_of_one_score(spark):
    """Rows of one id have one score; their ranks are all different and drawing stops inside the group."""
    rows = [(7, "a b c d " * 6)] * 50 + [(i, "a b c d " * 6) for i in range(100, 130)]
    bench = spark.createDataFrame([("a b",)], "text string")
    got = resampling.resample(frame(spark, rows), bench, percent=40).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, 33)) and len(got) == 80


def test_empty(spark):
    bench = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(frame(spark, []), bench).count() == 0
    got = resampling.resample(frame(spark, [(1, "a " * 30), (2, None)]), bench.limit(0), percent=100)
    assert [(r["id"], r["n_features"], r["rank"]) for r in got.orderBy("id").collect()] == [(1, 30, 1), (2, 0, None)]


def test_no_generate_or_python_in_scoring(spark):
    got = resampling.op12_resampling(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    plan = got._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Python" not in plan
