"""The training-data operators against brute force, on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquill.llm import decontamination, exact_dedup, mixing, near_dedup, token_output, toxicity, warc
from netquill.llm import quality as quality_op
from netquill.llm.common import range_bounds, shard_of
from netquill.llm.components import components

# columns whose names clash with what operators use inside
EXTRA = "doc_id long, text string, source string, id int, n long, chunk int, root string, score string, shard int, node string, spans string, _size2 int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, 3, "r", "x", 4, "n", "y", 5) for i, t, s in rows], EXTRA)


def prose(r, n, vocab=400):
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def awkward(seed=0):
    r = random.Random(seed)
    base = [prose(r, r.randint(1, 120)) for _ in range(30)]
    rows = [(i, t, r.choice(["a", "b", None, "Ä"])) for i, t in enumerate(base)]
    for k, t in enumerate(base):
        w = t.split()
        if k % 2 and len(w) > 30:
            w[r.randrange(len(w))] = "edit"
            rows.append((100 + k, " ".join(w), "a"))
        if k % 5 == 0:
            rows.append((200 + k, t.upper(), "b"))
    rows += [(300, None, None), (301, "", "a"), (302, " \t\n", "a"), (303, "one", "b"), (304, "ONE", "b"), (305, "long " + prose(r, 30_000), "c"), (None, base[0], "a"), (None, None, "a"), (7, base[7], "a"), (7, base[8], "a")]
    return rows


def test_exact_dedup(spark):
    rows = awkward()
    got = Counter((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs(spark, rows)).collect())
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    groups = {}
    for i, t, _ in rows:
        groups.setdefault((t or "").translate(lower), []).append(i)
    want = Counter()
    for i, t, _ in rows:
        t = (t or "").translate(lower)
        keep = max((x for x in groups[t] if x is not None), default=None)
        want[(i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert got == want
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_rice_codes(n):
    v = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    base, k, blob = exact_dedup.rice_encode(v)
    assert (exact_dedup.rice_decode(len(v), base, k, blob) == v).all()
    dense = np.arange(n, dtype=np.uint64) + np.uint64(1 << 63)
    base, k, blob = exact_dedup.rice_encode(dense)
    assert (exact_dedup.rice_decode(len(dense), base, k, blob) == dense).all() and len(blob) <= n // 4 + 8


def brute_near(rows, k, percent=80):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    for i, (d, _, _) in enumerate(rows):
        mates = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        c = min(mates, default=None)
        yield d, len(sets[i]), c, d == c


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup(spark, k):
    rows = awkward(3)
    got = Counter((r.id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs(spark, rows), shingle=k).collect())
    assert got == Counter(brute_near(rows, k))
    assert near_dedup.near_groups(docs(spark, [])).count() == 0


def test_near_dedup_in_blocks(spark, monkeypatch):
    """A group larger than a block is compared block by block, with the same result."""
    r = random.Random(5)
    base = prose(r, 60).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w), "a"))
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    monkeypatch.setattr(near_dedup, "CROWD", 5)
    got = Counter((x.id, x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_groups(docs(spark, rows), shingle=4).collect())
    assert got == Counter(brute_near(rows, 4))


@pytest.mark.parametrize("depths", [(3, 6, 12, 24), (3,)])
def test_near_dedup_of_pairs_in_a_crowd(spark, monkeypatch, depths):
    """Documents of one template, too far apart to be linked or to chain; pairs among them are found though every region is crowded."""
    r = random.Random(9)
    base, rows = prose(r, 60).split(), []
    for i in range(60):
        w = [*base[:25], *prose(r, 35, 10_000).split()]
        rows.append((2 * i, " ".join(w), "a"))
        w[50] = "edit"
        rows.append((2 * i + 1, " ".join(w), "a"))
    monkeypatch.setattr(near_dedup, "CROWD", 1)
    monkeypatch.setattr(near_dedup, "DEPTHS", depths)
    got = Counter((x.id, x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_groups(docs(spark, rows), shingle=4).collect())
    assert got == Counter(brute_near(rows, 4)) and sum(x[3] for x in got) == 60


def test_near_dedup_of_a_crowd_over_many_partitions(spark):
    """More equal starts than a group may hold, dealt over many partitions, null and repeated ids: as brute force."""
    r = random.Random(6)
    rows = []
    for family in range(8):
        base = prose(r, 50).split()
        for i in range(40):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
            rows.append((None if i % 10 == 3 else 7 if i % 10 == 4 else family * 100 + i, " ".join(w), "a"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = Counter((x.id, x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_groups(docs(spark, rows).repartition(11), shingle=4).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == Counter(brute_near(rows, 4))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(40)] + [(None, 1), (2, 2)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    want = {x: root(x) for x in up if root(x) != x}
    for contract in (True, False):
        got = components(spark.createDataFrame(edges, "a long, b long").repartition(5), contract=contract)
        assert {r.id: r.root for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_store(spark):
    rows = [r for r in awkward(1) if r[0] not in (7,)] + [(7, "twice", "a"), (7, "again", "a"), (900, "It's <|endoftext|> ÀÉ ß ½ 中文 İ", "a"), (901, "x" * 60_000, "a")]
    root = token_output.write_tokens(docs(spark, rows), token_output.default_tokenizer(), shard_bytes=20_000)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_output.default_tokenizer())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, at = [], 0
    for i, t, _ in order:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_output.summary(spark, root).orderBy("start").collect()]
    assert got == want
    assert [len(x) for x in token_output.read_document(root, 7)] == [w[2] for w in want if w[0] == 7]
    assert token_output.read_document(root, 12345) == []
    assert token_output.summary(spark, token_output.write_tokens(docs(spark, []), token_output.default_tokenizer())).count() == 0


def test_token_store_repeats_itself(spark):
    import pyarrow.parquet as pq

    made = [token_output.write_tokens(docs(spark, awkward(1)).repartition(n), token_output.default_tokenizer(), shard_bytes=3_000) for n in (1, 5)]
    names = [pq.read_table(f"{m}/manifest.parquet").column("file").to_pylist() for m in made]
    assert names[0] == names[1] and len(names[0]) > 2


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], "page_id long, url string, html string, shard int, digest string")


def test_warc(spark):
    big, other = "<p>é</p>" * 200, "z" * 1000
    rows = [(1, "http://a/", big), (2, None, big), (9, "http://b/\r\nX: y", big), (4, "u", "z" * 999), (5, "u", "z" * 999), (6, "u", other), (7, "v", other), (7, "w", other), (8, "n", None), (3, "e", ""), (None, "q", other), (10, "l", "long " * 400_000)]
    root = warc.write_warc(pages(spark, rows), roll_bytes=500, shard_bytes=4000)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, root).collect())
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        mates = [x for x, _, y in rows if (y or "").encode() == data and x is not None]
        keep = max(mates, default=None)
        again = len(data) >= 1000 and i is not None and keep is not None and i != keep
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keep if again else None)] += 1
    assert got == want
    assert warc.read_warc(spark, root).where("record_type = 'response' and page_id = 9").first().payload.decode() == big
    n = spark.read.parquet(f"{root}/manifest.parquet").count()
    assert n > 3
    import os

    assert sorted(f for f in os.listdir(root) if f.endswith(".warc.gz")) == sorted(r.file for r in spark.read.parquet(f"{root}/manifest.parquet").collect())
    again = warc.write_warc(pages(spark, rows).repartition(3), roll_bytes=500, shard_bytes=4000)
    digest = lambda p: sorted((r.file, r.sha256) for r in spark.read.parquet(f"{p}/manifest.parquet").collect())
    assert digest(root) == digest(again)
    empty = warc.write_warc(pages(spark, []))
    assert warc.read_warc(spark, empty).count() == 0


def test_mixing(spark):
    rows = awkward(2)
    got = mixing.mix(docs(spark, rows)).collect()
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            open_.remove(s)
    taken = Counter()
    for r in got:
        assert r._source_size == sizes[r.source] and r._target == pytest.approx(target[r.source])
        assert r._taken <= 3 * r._size and (r._position is None) == (r._taken == 0)
        taken[r.source] += r._taken
    largest = max(r._size for r in got)
    for s in names:
        assert abs(taken[s] - target[s]) <= max((r._size for r in got if r.source == s), default=0) / 2 + 1e-6 <= largest
    again = mixing.mix(docs(spark, rows).repartition(7))
    key = lambda d: sorted((repr(r.doc_id), r.text or "", r._taken) for r in d)
    assert key(again.collect()) == key(got)
    order = mixing.training_order(mixing.mix(docs(spark, rows))).select("_position", "_size").collect()
    assert [r._position for r in order] == sorted(r._position for r in order)
    assert sum(r._size for r in order) == sum(taken.values())
    clash = docs(spark, rows).withColumns({c: F.lit(c) for c in ("_start", "_bucket", "_digest", "_source", "_inner", "_rounds", "_Copy", "_slope", "_target")})
    held = mixing.mix(clash)
    assert key(held.collect()) == key(got)
    assert {(r._start, r._bucket, r._digest, r._source, r._inner, r._rounds, r._Copy) for r in held.collect()} == {("_start", "_bucket", "_digest", "_source", "_inner", "_rounds", "_Copy")}
    assert mixing.mix(docs(spark, [])).count() == 0
    assert {r._taken for r in mixing.mix(docs(spark, [(1, None, "a"), (2, "", None)])).collect()} == {0}


def test_training_sample_takes_whole_texts(spark):
    rows = [(i, prose(random.Random(i), 30 + i), "a") for i in range(40)] + [(40, "x " * 3000, "a"), (41, None, "a"), (5, "a", "a")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(42)] + [(4, 1, 1), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    fold = {i for i in range(42) if zlib.crc32(str(i).encode()) % 5}
    whole = toxicity.training_sample(docs(spark, rows), labels, "toxic", 100, 10**6)
    text = {r[0]: r[1] for r in rows} | {5: "a"}
    assert {r.id for r in whole} == fold - {41} and all(r.text == text[r.id] and r.y == (r.id % 2 or r.id == 4) for r in whole)
    few = toxicity.training_sample(docs(spark, rows), labels, "toxic", 100, 4000)
    order = sorted(fold - {40, 41}, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    for y in (0, 1):
        want, total = [], 0
        for i in (i for i in order if (i % 2 or i == 4) == y and len(text[i]) <= 400):
            total += len(text[i])
            if total <= 4000:
                want.append(i)
        assert sorted(want) == [r.id for r in few if r.y == y]


def test_dictionary_sample_is_that_of_a_full_sort(spark, monkeypatch):
    monkeypatch.setattr(token_output, "DICT_DOCS", 20)
    monkeypatch.setattr(token_output, "DICT_CHARS", 400)
    rows = [(i, prose(random.Random(i), 20 + i)) for i in range(300)] + [(None, prose(random.Random(-i), 9)) for i in range(1, 9)] + [(3, "again")] * 4000
    frame = spark.createDataFrame(rows, "id long, text string")
    keyed = frame.where(F.length("text") <= 400).distinct().select(F.md5(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))).alias("k"), "text").collect()
    assert token_output.dictionary_sample(frame) == [r.text for r in sorted(keyed, key=lambda r: r.k)[:20]]
    assert token_output.dictionary_sample(frame.limit(0)) == []
    assert len(token_output.dictionary_sample(frame.where("id is null"))) == 8


def test_curriculum_follows_its_schedule(spark):
    """Sources of rising weight give more words in the second half of training than in the first."""
    rows = [(i, prose(random.Random(i), 50), "abc"[i % 3]) for i in range(300)]
    m = mixing.training_order(mixing.mix(docs(spark, rows))).groupBy("source").agg(F.avg("_position").alias("p")).collect()
    p = {r.source: r.p for r in m}
    assert p["a"] < p["b"] < p["c"]


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.randint(8, 60))) for i in range(12)] + [(50, None), (51, "tiny"), (52, "Exactly the same"), (53, "exactly  the\nSAME")]

    def spoil(t, n):
        t = list(t)
        for _ in range(n):
            t[r.randrange(len(t))] = r.choice("XYZ")
        return "".join(t)

    rows = [(0, None, "a"), (1, "", "a"), (2, text(300), "a"), (3, "so it is exactly the same as ever", "a"), (4, "tiny", "a")]
    for i, t in items[:12]:
        rows.append((10 + i, text(20) + "\n" + spoil(t.upper(), i % 8) + " " + text(r.randint(0, 40)), "a"))
        rows.append((30 + i, text(5) + " " + t[: len(t) // 2], "a"))
    rows.append((90, " ".join(text(400) + " " + t for _, t in items[:5]), "b"))
    marked = decontamination.mark(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {x.doc_id: x.bench_items for x in marked.collect()}
    for i, t, _ in rows:
        n, want = decontamination.normalise(t), []
        for item, b in items:
            if any(edits(p, n) <= decontamination.budget(len(p)) for p in decontamination.passages(decontamination.normalise(b))):
                want.append(item)
        assert got[i] == want, i
    assert set(docs(spark, []).columns) <= set(marked.columns)
    none = decontamination.mark(docs(spark, rows), spark.createDataFrame([], "item_id long, text string"))
    assert none.where(F.size("bench_items") > 0).count() == 0
    assert decontamination.mark(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination_at_every_offset(spark):
    r = random.Random(12)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))[:n]
    items = [(0, text(120)), (1, text(190)), (2, text(149))]
    rows = []
    for item, b in items:
        b = decontamination.normalise(b)
        for n in (99, 100, 104):
            for at in {7, 20, 31, len(b) - n - 3} - {0}:
                for wrong in (0, 4, 6):
                    if at < 0 or at + n > len(b):
                        continue
                    t = list(b[at : at + n])
                    for x in r.sample(range(len(t)), wrong):
                        t[x] = r.choice(["", "X", t[x] + "Y"])
                    rows.append((len(rows), "PQ RST " + "".join(t) + " UVW", "a"))
    got = {x.doc_id: x.bench_items for x in decontamination.mark(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    found = 0
    for i, t, _ in rows:
        n, want = decontamination.normalise(t), []
        for item, b in items:
            b = decontamination.normalise(b)
            # a stretch within five edits shares 12 characters with the document
            if any(b[a : a + 12] in n for a in range(len(b) - 11)) and (any(edits(b[a : a + 100], n) <= 5 for a in range(len(b) - 99)) or len(b) <= 125 and edits(b, n) <= len(b) // 20):
                want.append(item)
        assert got[i] == want, i
        found += len(want)
    assert 0 < found < len(rows)


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 200)
    r = random.Random(9)
    items = [(i, prose(r, 30, 5000)) for i in range(6)]
    rows = [(i, prose(r, 10) + " " + t, "a") for i, t in items]
    got = {x.doc_id: x.bench_items for x in decontamination.mark(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: [i] for i in range(6)}


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    sizes = [1, 3, 7, 2, 5]
    u = rng.normal(size=sum(sizes)) * 2
    first = np.zeros(len(u), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    got, at = toxicity.chain_marginals(u, first, trans, start), 0
    for n in sizes:
        total, hot = 0.0, np.zeros(n)
        for bits in range(1 << n):
            y = [(bits >> i) & 1 for i in range(n)]
            w = np.exp(start[y[0]] + sum(u[at + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            hot += w * np.array(y)
        assert np.allclose(got[at : at + n], hot / total)
        at += n


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        w = prose(r, r.randint(20, 80)).split()
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["vileword", "nastything", "slurish"])
        if not good:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "a"))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_toxicity(spark, labelled):
    rows, labels = labelled
    frame = docs(spark, rows + [(900, None, "a"), (901, "", "a"), (902, "prefix vileword, fine " * 2000, "a")])
    model = toxicity.fit_from_tables(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_documents(frame, model).collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == bool(y) for i, y in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score == 0.0 and got[902].score >= 0.5
    s = got[902].spans[0]
    assert "vileword" in ("prefix vileword, fine " * 2000)[s.start : s.end]
    assert toxicity.score_documents(docs(spark, []), model).count() == 0


def test_quality(spark, labelled):
    rows, labels = labelled
    frame = docs(spark, rows + [(900, None, "a"), (901, "", "a"), (901, "", "a")])
    model = quality_op.fit_from_tables(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = quality_op.score_documents(frame, model).collect()
    got = {r.id: r.score for r in out}
    held = [(i, y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == bool(y) for i, y in held) >= 0.95 * len(held)
    assert len(out) == 503 and all(0 <= r.score <= 1 for r in out)
    assert quality_op.score_documents(docs(spark, []), model).count() == 0


def test_models_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frame = docs(spark, [(1, "some text", "a"), (2, None, "a")])
    assert toxicity.score_documents(frame, toxicity.fit_from_tables(frame, none)).count() == 2
    assert quality_op.score_documents(frame, quality_op.fit_from_tables(frame, none)).count() == 2


def test_range_bounds(spark):
    df = spark.range(10_000).select(F.when(F.col("id") < 5000, F.col("id")).otherwise(F.col("id") * 1_000_003).alias("k"), F.lit(1).alias("w"))
    bounds = range_bounds(df, "k", "w", 500)
    sizes = [r["count"] for r in df.groupBy(shard_of("k", bounds).alias("s")).count().collect()]
    assert len(sizes) == len(bounds) and max(sizes) <= 1000
    assert range_bounds(df.repartition(9), "k", "w", 500) == bounds
    assert range_bounds(df.limit(0), "k", "w", 500) == []


def test_range_bounds_refine_every_heavy_bin(spark):
    even = spark.range(100_000).select((F.col("id") * 7).alias("k"), F.lit(1).alias("w"))
    # 150 crowded stretches, far apart over the whole range of ids; in each further crowds
    crowds = spark.range(60_000).select(((F.col("id") % 150 - 75) * 120_000_000_000_000_000 + (F.col("id") / 150).cast("long") % 4 * 1_000_000_000 + (F.col("id") / 600).cast("long")).alias("k"), F.lit(1).alias("w"))
    for df, per_shard in ((even, 20), (crowds, 20)):
        bounds = range_bounds(df, "k", "w", per_shard)
        sizes = [r["count"] for r in df.groupBy(shard_of("k", bounds).alias("s")).count().collect()]
        assert len(sizes) == len(bounds) and max(sizes) <= per_shard and sum(sizes) == df.count()
        assert len(sizes) <= 2 * df.count() / per_shard + 1


def test_token_store_of_another_tokenizer(spark):
    """A tokenizer that keeps white space is not cut into words."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_output.cuts_at_spaces(token_output.default_tokenizer()) and not token_output.cuts_at_spaces(path)
    rows = [(1, "Two  spaces\n\nand lines", "a"), (2, None, "a"), (3, "it's ÀÉ  x" * 500, "a")]
    root = token_output.write_tokens(docs(spark, rows), path)
    tok = Tokenizer.from_file(path)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_output.read_tokens(spark, root).collect()} == want


def test_encoder_forgets_and_still_agrees(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "MEMO_PIECES", 20)
    encode, tok, r = token_output.WordEncoder(token_output.default_tokenizer()), Tokenizer.from_file(token_output.default_tokenizer()), random.Random(3)
    for _ in range(6):
        texts = [" ".join("".join(r.choice("abcÀß'7.-<|中́sSt") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 30))) for _ in range(20)]
        got = encode([t.encode() for t in texts])
        assert [x.tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_banded_alignment():
    r = random.Random(2)
    code = lambda t: np.array([ord(c) for c in t], np.uint64)
    for _ in range(60):
        p = "".join(r.choice("ab") for _ in range(r.randint(3, 12)))
        t = "".join(r.choice("ab") for _ in range(r.randint(3, 14)))
        assert decontamination.align([code(p)], code(t), np.array([-len(p)]), 2 * len(p) + len(t))[0] == edits(p, t)


@pytest.mark.parametrize("n", [1, 3])
def test_decontamination_of_rules_and_long_texts(n):
    """Repeated characters, periods and long texts stay cheap; what is found is what brute force finds."""
    import tracemalloc

    r = random.Random(21)
    passage = prose(r, 40, 3000)
    items = [(i, "a" * i + " " + "=" * 200 + " " + "=-" * 100) for i in range(n)] + [(900, passage)]
    index = decontamination.Index.build(items)
    texts = ["=" * 100_000, "=-" * 400, prose(r, 60_000, 4000) + " " + passage + " " + prose(r, 100, 4000), "-=" * 40 + " x"]
    tracemalloc.start()
    found = decontamination.find([decontamination.normalise(t) for t in texts], index)
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    assert found[0] == [] and found[3] == []
    assert [x[0] for x in found[1]] == list(range(n))
    (item, a, e), = found[2]
    assert item == 900 and passage in decontamination.normalise(texts[2])[a:e]


def test_decontamination_of_long_periods():
    """200,000 characters of one period against 50 items of it: seconds, not minutes, and the same items and spans."""
    import time

    r = random.Random(22)
    for unit in ("ab", "-=+"):
        passage = prose(r, 40, 3000)
        items = [(i, unit * (100 + i)) for i in range(50)] + [(900, passage)]
        index = decontamination.Index.build(items)
        text = prose(r, 30, 3000) + " " + unit * (200_000 // len(unit)) + " " + passage
        began = time.perf_counter()
        found = decontamination.find([text, unit * 30, unit * 400 + "x" + unit * 400], index)
        assert time.perf_counter() - began < 60  # some seconds on a machine that does nothing else
        assert [x[0] for x in found[0]] == [*range(50), 900]
        for item, a, e in found[0]:
            assert (passage if item == 900 else unit * 60_000)[: e - a] in text[a:e]
        assert found[1] == [] and [x[0] for x in found[2]] == list(range(50))


def test_squeezed_texts_keep_their_stretches():
    r = random.Random(23)
    for _ in range(20):
        parts = [prose(r, r.randint(1, 60)), *[u * r.randint(1, 3000) for u in r.choices(["a", "xy", "abc", "é-", "0123456789", "q" * 5 + "r"], k=2)], prose(r, 20)]
        r.shuffle(parts)
        text = "".join(parts)
        short, cuts = decontamination.squeeze(text)
        assert len(short) + sum(n for _, n in cuts) == len(text)
        pieces = lambda t: {t[i : i + 160] for i in range(len(t) - 159)}
        assert pieces(short) == pieces(text)
        back, at = [], 0
        for place in range(len(short)):
            a, _ = decontamination._unsqueezed(place, place + 1, cuts)
            back.append(text[a])
        assert "".join(back) == short and (len(short) < 5_000 or not cuts)
