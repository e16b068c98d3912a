"""Mixing sources to target weights as a time-varying curriculum (DataFrame operations only).

Every source has a weight schedule over training time t in [0, 1]: its base
weight times a linear ramp from ``1 + s`` to ``1 - s``.  The integral of the
ramp is 1, so integrating the schedules leaves base weights, which fix the
sources' targets.  A source's cumulative demand after time t is
``target * ((1 + s) t - s t^2)``.  Inverting it at the words a document's
source has given before the document is the document's training position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Base weights dealt to sources in code-point order, nulls last, repeating.
WEIGHTS = (5, 2, 1)
#: Ramp slopes dealt alike: sources of weight 5 fade out, those of weight 1 fade in.
SLOPES = (0.5, 0.0, -0.5)
MAX_REPEATS = 3
#: Columns that :func:`mix` adds, and those it needs on the way.
ADDED = ("_size", "_source_size", "_target", "_slope", "_before", "_copies", "_taken", "_position")
ON_THE_WAY = ("_source", "_bucket", "_digest", "_start", "_inner", "_rounds", "_copy")
#: Leading hex digits of a document's md5 that make its bucket; a bucket is the unit of the running sums.
BUCKET_DIGITS = 3


def source_targets(sized: DataFrame, weights=WEIGHTS, slopes=SLOPES) -> DataFrame:
    """One row per source: size, weight, target, slope.

    A target is ``min(3 * size, level * weight)`` with one level for all, which
    is where resharing the excess by weight ends.  The level comes from sorting
    sources by size per weight.  The windows here run over sources, already
    aggregated, never over documents.
    """
    s = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    by_name = Window.orderBy("_source")
    s = s.withColumn("k", (F.row_number().over(by_name) - 1) % len(weights))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("k").cast("int") + 1)
    s = s.withColumn("weight", pick([int(w) for w in weights])).withColumn("slope", pick([float(x) for x in slopes]))
    s = s.withColumn("cap", F.col("source_size") * MAX_REPEATS)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "_source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    s = s.withColumn("level", left.cast("double") / F.sum("weight").over(onward).cast("double"))
    open_ = F.col("level") * F.col("weight") <= F.col("cap")
    s = s.withColumn("level", F.min(F.when(open_, F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(whole)["level"])
    return s.select("_source", "source_size", "slope", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level") * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Adds to every document ``_size``, ``_source_size``, ``_target``, ``_taken``, ``_copies``, ``_before``, ``_slope`` and ``_position``.

    Documents of a source stand in md5 order of their id.  All give
    ``floor(target / source_size)`` copies; in the last, partial round those
    whose middle lies before the target give one more, so a source misses its
    target by half a document at most.  ``_before`` counts the words of the
    source's round before the document, ``_position`` is the training time of
    its first copy (null if none is taken).

    Null text has size 0 and is never taken; the null source is a source of its
    own, last in order.  Repeated rows are separate documents that follow each
    other.  If all sizes are 0 every target is 0.  Other columns pass through;
    one that bears an added name is replaced.

    Running sums go over (source, bucket) first and inside a bucket then, so a
    hot source is dealt over all of its buckets.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    aside = {c: f"held {i} {c}" for i, c in enumerate(docs.columns) if c.lower() in ON_THE_WAY}
    docs = docs.withColumnsRenamed(aside)
    id_col, text_col, source_col = (aside.get(c, c) for c in (id_col, text_col, source_col))
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    sized = docs.withColumns({"_size": size, "_source": source_key(source_col), "_digest": digest})
    sized = sized.withColumn("_bucket", F.substring("_digest", 1, BUCKET_DIGITS))
    # the small tables never read more than three columns of the scan
    lean = docs.select(source_key(source_col).alias("_source"), F.substring(digest, 1, BUCKET_DIGITS).alias("_bucket"), size.alias("_size"))
    sums = lean.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_size"))
    targets = source_targets(sums)
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_source", "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    known = starts.join(targets, "_source")
    known = known.select("_source", "_bucket", "_start", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("slope").alias("_slope"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_digest", "_size").rowsBetween(Window.unboundedPreceding, -1)
    runs = sized.withColumn("_inner", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    # the join's keys are the window's, so the texts, if they come along, move once for both
    out = runs.join(known, ["_source", "_bucket"])
    rounds = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("_before", F.col("_start") + F.col("_inner")).withColumn("_rounds", rounds)
    middle = F.col("_before").cast("double") + F.col("_size").cast("double") / 2
    extra = (middle < F.col("_target") - F.col("_rounds") * F.col("_source_size")) & (F.col("_size") > 0)
    out = out.withColumn("_copies", F.when(F.col("_size") > 0, F.col("_rounds") + extra.cast("long")).otherwise(F.lit(0)))
    out = out.withColumn("_taken", F.col("_copies") * F.col("_size"))
    out = out.withColumn("_position", F.when(F.col("_copies") > 0, position(F.col("_before"))))
    return out.drop(*ON_THE_WAY).withColumnsRenamed({v: k for k, v in aside.items()})


def source_key(source_col: str):
    """A source's name that is never null and sorts by code point, the null source last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("t"))


def position(words):
    """Training time at which the source has given ``words``: the root of ``(1 + s) t - s t^2 = words / target``."""
    u = F.least(words.cast("double") / F.col("_target"), F.lit(1.0))
    s = F.col("_slope")
    root = ((1 + s) - F.sqrt((1 + s) * (1 + s) - s * u * 4)) / (s * 2)
    return F.when(s == 0, u).otherwise(root)


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every copy as a row of its own, range-sorted by its training position."""
    copies = mixed.where(F.col("_copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))  # a column of that name is replaced
    at = position(F.col("_before") + F.col("_copy") * F.col("_source_size"))
    return copies.withColumn("_position", at).orderBy("_position", id_col, "_copy")


def op5_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix(docs).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
        "_position",
    )
    # documents the mix does not take stand first
    return mixed.orderBy("_position", "doc_id").withColumn("_position", F.round("_position", 6)).withColumnRenamed("_position", "position")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS k FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 3 AS cap, CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             CAST(CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 0.0 ELSE -0.5 END AS DOUBLE) AS slope FROM s),
l AS (SELECT *, CAST(cap AS DOUBLE) / weight AS r,
             CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv FROM w),
m AS (SELECT *, (SELECT lv FROM l WHERE lv * weight <= cap ORDER BY r, lv LIMIT 1) AS level FROM l),
t AS (SELECT source, source_size, slope, CASE WHEN level * weight <= cap THEN level * weight ELSE CAST(cap AS DOUBLE) END AS target FROM m),
c AS (SELECT d.*, t.source_size, t.target, t.slope,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM c),
p AS (SELECT *, CASE WHEN size > 0 THEN rounds + CASE WHEN CAST(before AS DOUBLE) + CAST(size AS DOUBLE) / 2 < target - rounds * source_size THEN 1 ELSE 0 END ELSE 0 END AS copies FROM n),
u AS (SELECT *, least(CAST(before AS DOUBLE) / nullif(target, 0), 1.0) AS u FROM p)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN round(CASE WHEN slope = 0 THEN u ELSE ((1 + slope) - sqrt((1 + slope) * (1 + slope) - slope * u * 4)) / (slope * 2) END, 6) END AS position
FROM u
"""
