"""Exact, repeatable splits and samples.

Rows stand in the order of the MD5 of seed and id, which is the same on every
engine and for any partitioning.  Sizes are exact.  Ranks inside a class come
from counts per hash prefix and ranks inside a prefix, so a large class is not
sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

PREFIX = 3


def hash_order(id_col: str, seed: int = 42):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def class_ranks(df: DataFrame, id_col: str, by, seed: int = 42) -> DataFrame:
    """Adds ``_rank`` (from 0, in hash order) and ``_size`` within each class."""
    by = list(by)
    h = df.withColumn("_h", hash_order(id_col, seed)).withColumn("_p", F.substring("_h", 1, PREFIX))
    counts = h.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by)
    starts = counts.select(*by, "_p", F.coalesce(F.sum("_n").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("_size"))
    inner = F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_h", id_col)) - 1
    return h.withColumn("_i", inner).join(starts, [*by, "_p"]).withColumn("_rank", F.col("_start") + F.col("_i")).drop("_h", "_p", "_i", "_start")


def ratio_split(df: DataFrame, id_col: str, by, ratio: float = 0.67, names=("pretrain", "supervised"), seed: int = 42) -> DataFrame:
    """Adds ``subset``: the first ``floor(n ratio)`` rows of every class, and the rest."""
    r = class_ranks(df, id_col, by, seed)
    return r.withColumn("subset", F.when(F.col("_rank") < F.floor(F.col("_size") * F.lit(ratio)), names[0]).otherwise(names[1])).drop("_rank", "_size")


def stratified_split(df: DataFrame, id_col: str, label: str, test: float = 0.2, val: float = 0.125, seed: int = 42) -> DataFrame:
    """Adds ``subset``: test is ``round(n test)`` of every class, validation ``round(rest val)``, then train."""
    r = class_ranks(df, id_col, [label], seed)
    n_test = F.floor(F.col("_size") * F.lit(test) + 0.5)
    n_val = F.floor((F.col("_size") - n_test) * F.lit(val) + 0.5)
    return r.withColumn("subset", F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_val, "val").otherwise("train")).drop("_rank", "_size")


def guarded_split(df: DataFrame, id_col: str, label: str, test: float = 0.2, val: float = 0.25, seed: int = 42) -> DataFrame:
    """60/20/20, stratified only if every class has two rows or more."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    if least is not None and least >= 2:
        return stratified_split(df, id_col, label, test, val, seed)
    return stratified_split(df.withColumn("_all", F.lit(0)), id_col, "_all", test, val, seed).drop("_all")


def quota_sample(keys: DataFrame, id_col: str, train: int, test: int, seed: int = 42) -> DataFrame:
    """``train`` and ``test`` keys in hash order; if there are too few, both shrink in proportion."""
    r = class_ranks(keys.withColumn("_all", F.lit(0)), id_col, ["_all"], seed)
    short = F.col("_size") < train + test
    n_train = F.when(short, F.floor(F.col("_size") * F.lit(train) / (train + test))).otherwise(train)
    n_test = F.when(short, F.col("_size") - n_train).otherwise(test)
    out = r.withColumn("subset", F.when(F.col("_rank") < n_train, "train").when(F.col("_rank") < n_train + n_test, "test"))
    return out.where("subset is not null").drop("_all", "_rank", "_size")


def weighted_sample(df: DataFrame, id_col: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` draws with replacement by weight: every row gets its expected share of draws, the remainder by hash."""
    total = df.agg(F.sum(weight).alias("_t"))
    x = df.crossJoin(F.broadcast(total)).withColumn("_e", F.col(weight) / F.col("_t") * n)
    u = F.conv(F.substring(hash_order(id_col, seed), 1, 12), 16, 10).cast("double") / float(1 << 48)
    draws = (F.floor("_e") + F.when(u < F.col("_e") - F.floor("_e"), 1).otherwise(0)).cast("int")
    return x.withColumn("_k", draws).where("_k > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_k", "_e", "_t")


def reshuffled(frames, id_col: str, seed: int = 42) -> DataFrame:
    """All frames' rows by column name, in hash order of the id."""
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.orderBy(hash_order(id_col, seed), id_col)


def first_keys(df: DataFrame, key: str, order: str, quota: int) -> DataFrame:
    """All rows of the ``quota`` keys that appear first; keys are few after the aggregate, and rows are filtered by them."""
    first = df.groupBy(key).agg(F.min(order).alias("_at")).orderBy("_at", key).limit(quota).select(F.col(key).alias("_k"))
    return df.join(F.broadcast(first), F.col(key) == F.col("_k"), "left_semi")


def cached_split(df: DataFrame, path: str, make, refresh: bool = False) -> DataFrame:
    """The split stored at ``path``, made and written there first if absent or to be refreshed."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    if refresh or not there:
        make(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def numbered(df: DataFrame, order, out: str = "place") -> DataFrame:
    """Adds the rows' places, from 1, in the order of the columns ``order``.

    Rows are sorted by range; a place is the number of rows in the ranges before
    and the row's own number in its range, so no task sees all rows.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").count()  # a row a partition
    before = counts.select(F.col("_range").alias("_r"), (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(out, inside).join(F.broadcast(before), F.col("_range") == F.col("_r")).withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_r", "_before")
