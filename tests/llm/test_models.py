"""The toxicity field and the quality vote against plain versions, and the registered queries' columns."""

import itertools
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from netquill.llm import quality, queries, toxicity

from .test_operators import docs, prose

SF = "/root/testdata/sf0.001"


def test_marginals_of_padded_segments():
    """Token and transition marginals by enumeration of all taggings: these are the terms of the gradient."""
    r = np.random.default_rng(3)
    sizes = [5, 1, 3]
    u, inside = r.normal(size=(3, 5)), np.arange(5)[None] < np.array(sizes)[:, None]
    trans, start = r.normal(size=(2, 2)), r.normal(size=2)
    p1, pair = toxicity._batch_marginals(np.where(inside, u, 0), inside, trans, start)
    want_pair = np.zeros((2, 2))
    for i, n in enumerate(sizes):
        ways = list(itertools.product((0, 1), repeat=n))
        logs = [start[t[0]] + sum(u[i, j] * t[j] for j in range(n)) + sum(trans[a, b] for a, b in itertools.pairwise(t)) for t in ways]
        total = sum(map(math.exp, logs))
        for t, x in zip(ways, logs, strict=True):
            for a, b in itertools.pairwise(t):
                want_pair[a, b] += math.exp(x) / total
        for j in range(n):
            assert p1[i, j] == pytest.approx(sum(math.exp(x) for t, x in zip(ways, logs, strict=True) if t[j]) / total)
    assert pair == pytest.approx(want_pair)


def test_tagged_tokens():
    """Cues by a plain count over groups of copies; no collision of hashes is expected among so few words."""
    r = random.Random(5)
    texts, toxic = [], []
    for i in range(400):
        w = prose(r, 30, 60).split()
        if i % 4 == 0:
            w[r.randrange(30)] = r.choice(["vileword", "Slurish,", "slurishly"])
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    texts += [texts[1]] * 50 + ["", "fine"]  # copies count once
    toxic += [0] * 52
    got = toxicity.label_tokens(texts, toxic)
    hot = {"vileword", "Slurish,", "slurishly"}
    for text, y, tags in zip(texts, toxic, got, strict=True):
        assert list(tags) == [int(bool(y) and w in hot) for w in text.split()]


def test_all_segments_count():
    words = [f"w{i}" for i in range(2 * toxicity.SEGMENT + 3)]
    got = list(toxicity._segments([" ".join(words), ""], [np.zeros(len(words)), np.zeros(0)]))
    assert sum((s[0] for s in got), []) == words and [len(s[1]) for s in got] == [48, 48, 3]


def test_toxicity_of_repeats_and_clashing_columns(spark):
    rows = [(1, "a vileword b", "x"), (1, "a vileword b", "x"), (2, None, None), (None, "plain " * 20_000, "y"), (3, "", "z")]
    texts = [prose(random.Random(i), 20) + (" vileword" if i % 2 else "") for i in range(200)]
    model = toxicity.fit_crf(texts, [i % 2 for i in range(200)])
    frame = docs(spark, rows).withColumnRenamed("n", "n_toxic_tokens")
    got = toxicity.score_documents(frame, model)
    assert got.count() == 5 and sorted(got.columns) == sorted(frame.columns)
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].score > 0.5 and [(s.start, s.end) for s in by[1].spans] == [(2, 10)]
    assert by[2].score == by[3].score == 0 and by[None].score < 0.5


def plain_vote(model, text, k):
    """Terms, weights, projection and cosines one by one."""
    words = text.split()
    terms = Counter()
    for w in words:
        p = quality.word_terms(w)
        terms.update([p & 0xFFFF, p >> 16 & 0xFFFF, p >> 32])
    for t in set(quality.text_terms(text, words)):  # a term named twice counts once
        terms[t] += max(2.0, len(words) / 20)
    x = {t: math.log1p(c) * float(model["idf"][t]) for t, c in terms.items()}
    size = math.sqrt(sum(v * v for v in x.values()))
    z = [sum(v / size * float(model["v"][t, a]) for t, v in x.items()) for a in range(model["v"].shape[1])]
    norm = math.sqrt(sum(v * v for v in z)) or 1.0
    near = sorted(((sum(a / norm * float(b) for a, b in zip(z, vec, strict=True)), float(y)) for vec, y in zip(model["vectors"], model["labels"], strict=True)), reverse=True)[:k]
    w = [max(s, 1e-6) ** 4 for s, _ in near]
    return sum(a * y for a, (_, y) in zip(w, near, strict=True)) / sum(w)


def test_quality_votes_one_by_one(spark):
    r = random.Random(9)
    texts = [" ".join(x.upper() + "!!" if i % 3 == 0 else x for x in prose(r, r.randint(5, 60)).split()) for i in range(120)]
    model = quality.fit(texts, [int(i % 3 > 0) for i in range(120)], axes=12)
    asked = [*texts[:20], prose(r, 40), "same same same", "WORD!! " * 9000, "", "甲 乙\n甲 乙\n"]
    rows = [*[(i, t, "s") for i, t in enumerate(asked)], (0, asked[0], "again"), (None, None, None)]
    got = quality.score_documents(docs(spark, rows), model).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g.score == pytest.approx(plain_vote(model, asked[g.id] if g.id is not None else "", quality.NEIGHBOURS), abs=2e-3)
    assert len({g.score for g in got if g.id == 0}) == 1


def test_vote_with_ties_and_few_labels():
    one = {"vectors": np.eye(2, dtype=np.float32), "labels": np.array([1, 0], np.float32)}
    assert quality.vote(one, np.array([[1, 0], [0, 1], [0.70710677, 0.70710677]], np.float32)) == pytest.approx([1, 0, 0.5], abs=1e-6)


CONTRACT = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op3_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op4_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op7_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op9_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op10_tokens": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op11_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op12_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13_language_scores": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", CONTRACT)
def test_registered_query(spark, name):
    """Columns, types and a row a document (page, vector) of the whole table; folds and thresholds where there are any."""
    df = queries.QUERIES[name](spark, SF)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    want = dict(x.split(" ") for x in CONTRACT[name].split(", "))
    assert {c: kinds.get(c) for c in want} == want
    key, rows = next(iter(want)), df.collect()
    ids = spark.read.parquet(f"{SF}/{ {'op2_warc': 'pages', 'op11_vector_codes': 'embeddings'}.get(name, 'documents') }.parquet").select(key).collect()
    assert sorted(r[key] for r in rows) == sorted(r[key] for r in ids)
    if "predicted" in want:
        least = {"op1_toxicity": 0.5, "op4_quality": 0.3}[name]
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= least) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    if name == "op13_language_scores":
        assert all(r.score <= 0 and r.base_score <= 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
