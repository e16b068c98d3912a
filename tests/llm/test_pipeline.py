"""The pipeline against a brute-force version of its stages, on a small fixture."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netquill.llm import decontamination, token_output

from .test_operators import brute_near, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    rows, labels = [], []
    bench = [(i, prose(r, 40, 3000)) for i in range(4)]
    for i in range(240):
        w = prose(r, r.randint(20, 90)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["vileword", "nastything"])
        text = " ".join(w)
        if i % 17 == 5:
            text += " " + bench[i % 4][1]
        rows.append((i, text, "en", ["a", "b", "c", None][i % 4], len(text)))
        labels.append((i, 1, int(toxic)))
    for i in range(1, 40, 4):
        w = rows[i][1].split()
        w[3] = "changed"
        rows.append((1000 + i, " ".join(w), "en", "b", 0))
    rows += [(2000, None, None, None, None), (2001, "", "en", "a", 0), (None, "no id at all here", "en", "a", 1), (3, rows[3][1], "en", rows[3][3], rows[3][4]), (5001, rows[1][1], "en", "b", 0), (5001, prose(r, 60), "en", "b", 0), (None, rows[1][1], "en", "b", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, bench


def test_pipeline(spark, folder):
    path, rows, bench = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    toxic = corpus_pipeline.drop_toxic(spark, docs, path)
    assert toxic.columns == docs.columns
    kept = [tuple(r) for r in toxic.collect()]
    assert len(kept) >= 0.9 * sum("vileword" not in (r[1] or "") and "nastything" not in (r[1] or "") for r in rows)
    assert sum(("vileword" in (r[1] or "")) or ("nastything" in (r[1] or "")) for r in kept) == 0

    near = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(kept, docs.schema), path)
    judged = list(brute_near([(r[0], r[1], r[3]) for r in kept], 5))
    want = {(r[0], r[1]) for r, j in zip(kept, judged, strict=True) if j[3]}
    got = [(r.doc_id, r.text) for r in near.collect()]
    assert Counter(got) == Counter(want)

    rows2 = [tuple(r) for r in near.collect()]
    clean = [tuple(r) for r in corpus_pipeline.drop_leaks(spark, spark.createDataFrame(rows2, docs.schema), path).collect()]
    passages = [p for _, t in bench for p in decontamination.passages(decontamination.normalise(t))]
    assert Counter(clean) == Counter(r for r in rows2 if not any(p in decontamination.normalise(r[1]) for p in passages))

    mixed = corpus_pipeline.mix_sources(spark, spark.createDataFrame(clean, docs.schema), path)
    assert mixed.columns == docs.columns
    copies = Counter(tuple(r) for r in mixed.collect())
    assert set(copies) <= set(clean) and max(copies.values()) <= 3

    out = corpus_pipeline.token_ids(spark, mixed, path).collect()
    encode = token_output.WordEncoder(token_output.default_tokenizer())
    want = Counter()
    for r, n in copies.items():
        ids = np.append(encode([(r[1] or "").encode()])[0], np.uint32(2)).astype("<u4")
        want[(r[0], len(ids), zlib.crc32(ids.tobytes()))] += n
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, path).collect()) == want


def test_stages_leave_other_columns(spark, folder):
    """Columns that bear the names operators use come out as they went in, and empty tables stay empty."""
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(60)
    names = ["score", "spans", "_size", "_start", "_slope", "_target", "_copy", "bench_items", "print", "id", "node"]
    wide = docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id"), F.lit(-1))) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, path)
        assert got.columns == wide.columns, name
        assert all(r[n] == f"{n}{-1 if r.doc_id is None else r.doc_id}" for r in got.collect() for n in names)
        assert stage(spark, wide.limit(0), path).count() == 0
