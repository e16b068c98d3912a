"""Classification metrics, detection summaries, trends and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, true: str, pred: str, labels) -> DataFrame:
    """Count of every (true, predicted) pair of the given labels, zeros included.

    Also the count's share of its true label (0 where the label is absent).
    The label grid is a literal, so only aggregated counts are shuffled.
    """
    spark = df.sparkSession
    one = spark.createDataFrame([(int(x),) for x in labels], "true_label int")
    grid = one.crossJoin(one.withColumnRenamed("true_label", "pred_label"))
    got = df.groupBy(F.col(true).cast("int").alias("true_label"), F.col(pred).cast("int").alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    out = F.broadcast(grid).join(got, ["true_label", "pred_label"], "left").select("true_label", "pred_label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    row = F.sum("n").over(Window.partitionBy("true_label"))
    return out.withColumn("share", F.when(row > 0, F.round(F.col("n") / row, 4)).otherwise(0.0))


def class_report(df: DataFrame, true: str, pred: str, labels) -> DataFrame:
    """Precision, recall, F1 and support per class, with rows ``accuracy``, ``macro avg`` and ``weighted avg``; 0 on empty denominators."""
    n = F.col("n")
    # one matrix of labels by labels; every figure of the report is a sum over it
    c = confusion(df, true, pred, labels).select(F.explode(F.array(F.struct(F.col("true_label").alias("k"), n.alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("true_label") == F.col("pred_label"), n).otherwise(0).alias("tp")), F.struct(F.col("pred_label").alias("k"), F.lit(0).cast("long").alias("support"), n.alias("predicted"), F.lit(0).cast("long").alias("tp")))).alias("x")).select("x.*")
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = c.groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    m = m.withColumn("precision", over(F.col("tp"), F.col("predicted"))).withColumn("recall", over(F.col("tp"), F.col("support")))
    m = m.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    cols = ["precision", "recall", "f1"]
    total = F.sum("support")
    # the classes and their averages in one pass: each class row, and all classes as one group
    g = m.groupingSets([["k"], []], "k").agg(F.grouping("k").alias("all"), *[F.avg(x).alias(x) for x in cols], *[over(F.sum(F.col(x) * F.col("support")), total).alias(f"w_{x}") for x in cols], over(F.sum("tp"), total).alias("acc"), total.alias("support"))
    row = lambda name, values: F.struct(name.alias("class"), *[v.alias(x) for x, v in zip(cols, values, strict=True)])
    plain = [F.col(x) for x in cols]
    each = F.array(row(F.col("k").cast("string"), plain))
    means = F.array(row(F.lit("accuracy"), [F.col("acc")] * 3), row(F.lit("macro avg"), plain), row(F.lit("weighted avg"), [F.col(f"w_{x}") for x in cols]))
    out = g.select("support", F.explode(F.when(F.col("all") == 0, each).otherwise(means)).alias("r"))
    return out.select("r.class", *[F.round(f"r.{x}", 6).alias(x) for x in cols], F.col("support").cast("long").alias("support"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: count, balanced weight ``n / (k n_c)`` and sampling weight ``1 / n_c``."""
    g = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy()
    return g.select("label", "n", F.round(F.sum("n").over(all_) / (F.count(F.lit(1)).over(all_) * F.col("n")), 6).alias("balanced_weight"), F.round(1.0 / F.greatest("n", F.lit(1)), 6).alias("sampling_weight"))


def micro_auc(df: DataFrame, truth: str, score: str, by=()) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties at their average rank.

    Scores are counted first; ranks come from counts of distinct scores, summed
    over ranges of scores and then inside a range, so no task sorts all rows.
    ``truth`` is 0/1; groups of one class give null.
    """
    by = list(by)
    g = df.groupBy(*by, F.col(score).alias("_v")).agg(F.sum(F.col(truth).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_c"))
    g = g.withColumn("_b", F.floor(F.col("_v") * 1024))
    part = g.groupBy(*by, "_b").agg(F.sum("_c").alias("_c"))
    before = part.select(*by, "_b", F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum("_c").over(Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = g.withColumn("_inner", inner).join(before, [*by, "_b"])
    rank = F.col("_before") + F.col("_inner") + (F.col("_c") + 1) / 2
    s = r.groupBy(*by).agg(F.sum(F.col("_p") * rank).alias("_r"), F.sum("_p").cast("double").alias("_p"), F.sum("_c").cast("double").alias("_n"))
    neg = F.col("_n") - F.col("_p")
    return s.select(*by, F.col("_n").cast("long").alias("n"), F.when((F.col("_p") > 0) & (neg > 0), F.round((F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * neg), 6)).alias("auc"))


def one_vs_rest(df: DataFrame, label: str, scores: str, n_classes: int) -> DataFrame:
    """Rows exploded to (truth, score) of every class, for the micro average."""
    return df.select(F.col(label), F.posexplode(scores).alias("_k", "score")).where(F.col("_k") < n_classes).withColumn("truth", (F.col(label) == F.col("_k")).cast("int"))


def roc_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Points of the curve, one per distinct score, from aggregated counts (a report table)."""
    g = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum(1 - F.col(truth).cast("long")).alias("q"))
    down, all_ = Window.orderBy(F.col("threshold").desc()), Window.partitionBy()
    return g.select("threshold", (F.sum("q").over(down) / F.sum("q").over(all_)).alias("fpr"), (F.sum("p").over(down) / F.sum("p").over(all_)).alias("tpr"))


def majority_vote(votes: DataFrame, key, label: str, confidence: str | None = None) -> DataFrame:
    """Most frequent label per key, ties to the smallest, and the mean confidence."""
    c = votes.groupBy(key, label).agg(F.count(F.lit(1)).alias("_n"), *([F.sum(confidence).alias("_s")] if confidence else []))
    best = F.max(F.struct(F.col("_n"), (-F.col(label)).alias("m")))
    out = c.groupBy(key).agg(best.alias("_b"), *([(F.sum("_s") / F.sum("_n")).alias("confidence")] if confidence else []))
    return out.select(key, (-F.col("_b.m")).alias(label), *([F.round("confidence", 6).alias("confidence")] if confidence else []))


def argmax(scores: str):
    """``(class, score)`` of the first largest element of an array column."""
    top = F.array_max(scores)
    return (F.array_position(scores, top) - 1).cast("int"), top


def high_confidence_malicious(df: DataFrame, pred="pred_label", confidence="confidence", least: float = 0.8) -> DataFrame:
    return df.where((F.col(pred) != 0) & (F.col(confidence) >= least))


def detection_summary(df: DataFrame, label: str) -> DataFrame:
    """Totals of all, benign (class 0) and malicious rows and of every class."""
    g = df.groupBy(F.col(label).cast("string").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    totals = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) != 0).alias("malicious"))
    long = totals.unpivot([], ["total", "benign", "malicious"], "kind", "n")
    return long.unionByName(g.select(F.concat(F.lit("class_"), "kind").alias("kind"), "n"))


def row_segments(df: DataFrame, row_id: str, label: str, size: int = 100) -> DataFrame:
    """Benign and malicious counts of each run of ``size`` consecutive rows."""
    return df.groupBy(F.floor(F.col(row_id) / size).alias("segment")).agg(F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) != 0).alias("malicious"))


def time_bins(df: DataFrame, ts: str, label: str, bins: int = 10) -> DataFrame:
    """Counts in equal, left-closed time bins; the latest instant falls outside."""
    edge = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    x = df.crossJoin(F.broadcast(edge)).where((F.col("hi") > F.col("lo")) & (F.col(ts) < F.col("hi")))
    at = F.least(F.floor((F.col(ts) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    return x.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) != 0).alias("malicious"))


def histogram(df: DataFrame, value: str, bins: int = 10, least_max: float = 1.0) -> DataFrame:
    """Counts in equal bins from 0 to the largest value (at least ``least_max``); the top value is in the last bin."""
    top = df.agg(F.greatest(F.max(value), F.lit(least_max)).alias("_top"))
    x = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(top))
    return x.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(value) / F.col("_top") * bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def text_summary(df: DataFrame, events: str, text: str) -> DataFrame:
    """Least, largest and mean number of events per flow, and the number of empty texts."""
    return df.agg(F.min(events).alias("min_events"), F.max(events).alias("max_events"), F.round(F.avg(events), 4).alias("avg_events"), F.count_if(F.coalesce(F.length(text), F.lit(0)) == 0).alias("empty_texts"), F.count(F.lit(1)).alias("n"))


def stage_summary(stages: DataFrame) -> DataFrame:
    """Total wall and CPU seconds and rows of the stages that went well, rows per wall second, and how many did and did not."""
    ok = F.col("status") == "ok"
    good = lambda c: F.sum(F.when(ok, F.col(c)))
    return stages.agg(good("wall_s").alias("wall_s"), good("cpu_s").alias("cpu_s"), good("rows").alias("rows"), (good("rows") / good("wall_s")).alias("rows_per_s"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))
