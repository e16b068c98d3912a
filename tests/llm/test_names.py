"""Names of words and ranges on texts that would cancel out in a sum of powers."""

import random

import numpy as np

from netquill.llm import near_dedup, repeats, substring_dedup, suffix_dedup

from .test_repeats import brute_bytes, brute_words, frame


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


ONE, OTHER = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


def test_words_that_differ_have_names_that_differ():
    r = random.Random(1)
    words = {ONE, OTHER, "a", "aa", "a" * 8, "a" * 9, "a" * 16, "b" * 16, "é", "ab", "ba", "a\0b", "a\0"} | {"".join(r.choice("ab") for _ in range(r.randint(1, 40))) for _ in range(3_000)}
    words = sorted(w.encode() for w in words)
    for seed in (0, 7):
        names, at = repeats.word_names([b" ".join(words), b"", b" \t", b"a aa\n" + ONE.encode()], seed)
        assert len(np.unique(names[: len(words)])) == len(words)
        assert at.tolist() == [0, len(words), len(words), len(words), len(words) + 3]
        again = dict(zip(words, names[: len(words)], strict=True))
        assert names[-3:].tolist() == [again[b"a"], again[b"aa"], again[ONE.encode()]]
    assert repeats.word_names([], 1)[1].tolist() == [0] and len(repeats.word_names([b""], 1)[0]) == 0


def test_substring_dedup_keeps_a_different_word(spark):
    w = [f"w{i}" for i in range(30)]
    docs = [(1, " ".join([*w[:10], ONE, *w[10:]])), (2, " ".join([*w[:10], OTHER, *w[10:]]))]
    got = {(r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(frame(spark, docs)).collect()}
    assert got == set(brute_words(docs, 20))


def test_near_dedup_keeps_disjoint_texts_apart(spark):
    got = near_dedup.near_groups(frame(spark, [(1, ONE), (2, OTHER), (3, ONE)]), shingle=4).collect()
    assert {r["id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1}


def test_bytes_that_differ_stay(spark):
    r = random.Random(2)
    docs = []
    for i, (a, b) in enumerate((("a", "b"), ("x" * 8, "y" * 8), ("0", "8"))):
        for k, t in enumerate((thue_morse(512, a, b), thue_morse(512, b, a))):
            docs.append((10 * i + k, "".join(r.choice("pq") for _ in range(50)) + t[:400] + "".join(r.choice("pq") for _ in range(50))))
    docs.append((90, docs[0][1]))
    got = {(x["id"], x["n_bytes"], x["n_removed"], len(x["spans"]), x["kept_sha256"]) for x in suffix_dedup.remove_repeats(frame(spark, docs)).collect()}
    assert got == set(brute_bytes(docs, 400))
