import hashlib
import random
from collections import Counter

import pytest

from netquill.llm import substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, chunk int, owner string"


def brute_bytes(docs, length):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        yield i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def brute_words(docs, size):
    seen = set()
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            if k in seen:
                gone[p : p + size] = [True] * size
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        yield i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()


def corpus(seed, words=60):
    r = random.Random(seed)
    vocab = ["a", "b", "the", "of"] if seed % 2 else [f"w{i}" for i in range(words)]
    fresh = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passages = [fresh(r.randint(10, 60)) for _ in range(4)]
    docs = [(1000, None), (1001, ""), (1002, "x"), (1003, "y " * 300), (1004, "y " * 90), (1005, "aaaa" * 60)]
    for i in range(40):
        parts = [fresh(r.randint(0, 30)) for _ in range(2)]
        if r.random() < 0.7:
            parts.insert(1, r.choice(passages))
        docs.append((i, "\n".join(parts)))
    docs += [(i + 100, t) for i, t in docs[6:26:3]]  # whole copies
    docs += [docs[8], (None, docs[9][1]), (None, fresh(50))]  # a repeated row, null ids
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in docs], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_bytes_match_brute_force(spark, seed):
    docs = corpus(seed)
    out = suffix_dedup.remove_repeats(frame(spark, docs), length=120, chunk_bytes=1500)
    got = sorted(map(repr, ((r.id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in out.collect())))
    assert got == sorted(map(repr, brute_bytes(docs, 120)))


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_words_match_brute_force(spark, seed):
    docs = corpus(seed)
    out = substring_dedup.remove_repeats(frame(spark, docs), chunk_bytes=1500)
    got = sorted(map(repr, ((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect())))
    assert got == sorted(map(repr, brute_words(docs, 20)))


def test_bytes_of_production_length(spark):
    r = random.Random(9)
    base = corpus(2, 4000)
    long = [" ".join(f"v{r.randrange(3000)}" for _ in range(r.randint(40, 200))) for _ in range(6)]
    docs = base + [(5000 + i, r.choice(long)[: r.randint(300, 900)] + " " + " ".join(f"u{r.randrange(9000)}" for _ in range(40)) + " " + r.choice(long)[r.randint(0, 300) :]) for i in range(30)]
    docs += [(6000, "ab" * 1500), (6001, long[0] + long[0])]
    out = suffix_dedup.remove_repeats(frame(spark, docs), chunk_bytes=20_000)
    got = sorted(map(repr, ((r.id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in out.collect())))
    assert got == sorted(map(repr, brute_bytes(docs, 400))) and any(n for _, _, n, _, _ in brute_bytes(docs, 400))


@pytest.mark.parametrize("size", [399, 400, 401])
def test_a_passage_is_judged_by_its_bytes_not_its_words(spark, size):
    """60 words that two documents share stay at 399 bytes and go from 400 on; op7, which counts words, removes the later ones at any size."""
    r = random.Random(size)
    fresh = lambda: " ".join(f"f{r.randrange(10**9)}" for _ in range(30))
    words = [f"w{r.randrange(1000, 10_000)}" for _ in range(59)]
    passage = " ".join([*words, "x" * (size - 59 * 6)])
    assert len(passage) == size and len(passage.split()) == 60
    # unlike characters on both sides, so not a byte more is shared
    docs = [(0, f"{fresh()} <{passage}{{ {fresh()}"), (1, f"{fresh()} >{passage}}} {fresh()}"), (2, fresh())]
    got = {x.id: x.n_removed for x in suffix_dedup.remove_repeats(frame(spark, docs)).collect()}
    want = size if size >= 400 else 0
    assert got == {0: want, 1: want, 2: 0}
    by_words = {x.id: x.n_removed for x in substring_dedup.remove_repeats(frame(spark, docs)).collect()}
    assert by_words == {0: 0, 1: 58, 2: 0}


def test_words_of_one_id_keep_the_order_of_texts(spark):
    r = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(40))
    docs = [(None if i % 2 else 5, f"{r.choice('abc')}{i} " + shared + f" t{i}") for i in range(24)]
    out = substring_dedup.remove_repeats(frame(spark, docs), chunk_bytes=300)
    got = sorted(map(repr, ((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect())))
    assert got == sorted(map(repr, brute_words(docs, 20)))


def test_empty_tables(spark):
    none = frame(spark, [])
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
