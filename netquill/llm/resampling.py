"""Importance resampling of documents towards a target distribution of hashed words.

Words go to 10,000 buckets; a bucket's gain is the log ratio of its share in
the target texts and in the documents.  Every document's buckets are one array,
written once; its weight is an aggregate over that array and a literal array of
gains, so scoring neither explodes nor shuffles a word.  What is shuffled are
bucket totals and one narrow row per drawn document.

Drawing the best documents needs no sort of all rows in one task: a histogram of
scores says how many documents stand above a score, and documents of one score
are numbered in a window of their own (the noise spreads equal weights over
thousands of scores).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, own_columns, stash

#: Words, buckets, seed, shortest document drawn, share drawn.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Scores that share a coarse step of the histogram.
COARSE = 1_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORDS), F.lit(0))


def _bucket(feature: Column) -> Column:
    return (F.crc32(feature.cast("binary")) % BUCKETS).cast("smallint")


def _run(words: Column, n: int):
    return lambda i: _bucket(F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))


def buckets_of(text: Column, longest: int = 1) -> Column:
    """Buckets of all runs of 1 to ``longest`` consecutive words, as an array."""
    if longest == 1:
        return F.transform(words_of(text), _bucket)

    def runs(words: Column) -> Column:
        some = [F.transform(words, _bucket)]
        for n in range(2, longest + 1):
            starts = F.sequence(F.lit(0), F.size(words) - n)  # single words are picked, as a slice would copy the whole array
            run = F.transform(starts, _run(words, n))
            some.append(F.when(F.size(words) >= n, run).otherwise(F.array().cast("array<smallint>")))
        return F.concat(*some)

    # as a lambda's variable the words are found once, not once a run
    return F.transform(F.array(words_of(text)), runs)[0]


def bucket_totals(rows: DataFrame, col: str = "buckets") -> np.ndarray:
    """How often every bucket stands in the arrays of ``col``; BUCKETS numbers come to the driver whatever the input."""
    found = np.zeros(BUCKETS, np.int64)
    for r in rows.select(F.explode(col).alias("b")).groupBy("b").count().collect():
        found[r["b"]] = r["count"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored."""
    s, t = int(source.sum()), int(target.sum())
    ratio = lambda a, b: math.log(((b + 1.0) * (s + BUCKETS)) / ((a + 1.0) * (t + BUCKETS)))
    return np.array([math.floor(1000 * ratio(a, b)) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 1, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``id``, ``n_features``, ``weight``, ``score``, ``rank`` (all long) of every row of ``docs``.

    Drawn are ``percent`` of the documents of ``least_words`` words or more,
    rounded down, by highest score, ties to the smaller id; undrawn rows have
    a null rank.  Whole texts count.

    Null and empty texts have no features, weight 0 and only noise as score.
    A null id is hashed as the empty string and ranks behind other ids of its
    score.  Repeated rows have ranks of their own; rows equal in id are ranked
    by weight and number of features.  With an empty target every bucket's
    target count is 0; empty ``docs`` give no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    words = F.size("buckets")
    if longest > 1:  # of m features, runs of 1 to longest words, how many are single words
        words = F.size(words_of(F.col("text")))
    rows = own_columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    coded = stash(rows.select("id", "text", buckets_of(F.col("text"), longest).alias("buckets")).select("id", words.alias("n_words"), "buckets"), "buckets")
    wanted = own_columns(target, text=target_text).select(buckets_of(F.col("text"), longest).alias("buckets"))
    gain = F.lit(gains(bucket_totals(coded), bucket_totals(wanted)))

    n = F.size("buckets").cast("long")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, b: s + F.element_at(gain, b + F.lit(1)))
    # the sum less its remainder divides evenly, so this is an exact floor
    scored = coded.select("id", "n_words", n.alias("n_features"), total.alias("total"))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stash(scored.withColumn("weight", weight).withColumn("score", F.col("weight") + noise).select("id", "n_words", "n_features", "weight", "score"), "scores")

    fit = scored.where(F.col("n_words") >= least_words)
    steps = stash(fit.groupBy("score").agg(F.count(F.lit(1)).alias("here")).withColumn("step", F.floor(F.col("score") / COARSE)), "histogram")
    n_fit = steps.agg(F.coalesce(F.sum("here"), F.lit(0))).first()[0]
    n_drawn = percent * n_fit // 100
    # a coarse step has COARSE scores at most, and there are a few dozen coarse steps
    above = lambda w: F.coalesce(F.sum("here").over(w.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = steps.groupBy("step").agg(F.sum("here").alias("here")).withColumn("at", F.col("step")).select("step", above(Window).alias("higher"))
    fine = steps.withColumn("at", F.col("score")).select("step", "score", above(Window.partitionBy("step")).alias("before"))
    start = stash(fine.join(coarse, "step").select(F.col("score").alias("_score"), (F.col("higher") + F.col("before")).alias("start")).where(F.col("start") < n_drawn), "starts")
    # scores drawn from are a range: all from some score up
    low = start.agg(F.min("_score")).first()[0]
    drawn_from = F.lit(False) if low is None else (F.col("n_words") >= least_words) & (F.col("score") >= low)
    drawn = scored.where(drawn_from).join(start, F.col("score") == F.col("_score"))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "weight", "n_features"))
    drawn = drawn.withColumn("rank", F.col("start") + place).withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    columns = ["id", "n_features", "weight", "score", "rank"]
    return drawn.select(columns).unionByName(scored.where(~drawn_from).withColumn("rank", F.lit(None).cast("long")).select(columns))


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).withColumnRenamed("id", "doc_id")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dc AS MATERIALIZED (SELECT w, count(*) AS n FROM dw GROUP BY w), bc AS MATERIALIZED (SELECT w, count(*) AS n FROM bw GROUP BY w),
word AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dc UNION SELECT w FROM bc)),
bytes AS (SELECT w, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)) AS b FROM word),
crc AS MATERIALIZED (SELECT w, xor(list_reduce(b, lambda c, y: list_reduce(range(9), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(c, y) << 1), 4294967295::BIGINT), 4294967295) % 10000 AS k FROM bytes),
s AS (SELECT k, CAST(sum(n) AS BIGINT) AS n FROM dc JOIN crc USING (w) GROUP BY k), t AS (SELECT k, CAST(sum(n) AS BIGINT) AS n FROM bc JOIN crc USING (w) GROUP BY k),
z AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS sn, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS tn),
g AS MATERIALIZED (SELECT s.k, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (sn + 10000)) / ((s.n + 1)::DOUBLE * (tn + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (k), z),
x AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM dw JOIN crc USING (w) JOIN g USING (k) GROUP BY doc_id),
y AS (SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(CASE WHEN n IS NULL THEN 0 ELSE floor(total::DOUBLE / n) END AS BIGINT) AS weight, CAST('0x' || left(sha256('2024:' || d.doc_id), 8) AS BIGINT) AS h FROM d LEFT JOIN x USING (doc_id)),
r AS (SELECT doc_id, n_features, weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM y),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT r.*, CASE WHEN o.rank <= 10 * o.n // 100 THEN o.rank END AS rank FROM r LEFT JOIN o USING (doc_id)
"""
