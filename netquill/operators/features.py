"""Preparation of feature tables: encoding, imputation, scaling, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..schemas import LEAKAGE_COLUMNS


def drop_leakage(df: DataFrame, protect=("flow_uid", "flow_id", "label")) -> DataFrame:
    """Without identifying columns, those in ``protect`` aside."""
    return df.drop(*[c for c in LEAKAGE_COLUMNS if c not in set(protect)])


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Adds the rank of each value among the sorted distinct values, from 0; nulls are a value named ``nan``.

    The ranking runs over distinct values; they are joined back, by broadcast
    if Spark finds them small.
    """
    v = F.coalesce(F.col(col).cast("string"), F.lit("nan"))
    codes = df.select(v.alias("_v")).distinct().withColumn(out, (F.row_number().over(Window.orderBy("_v")) - 1).cast("int"))
    return df.withColumn("_v", v).join(codes, "_v").drop("_v")


def collapse_rare(df: DataFrame, col: str, out: str, least: int = 5, other: str = "other") -> DataFrame:
    """Adds the value where it occurs ``least`` times or more, else ``other``.

    Counts are aggregated before they are joined back, so a frequent value is
    no hot window.
    """
    often = df.groupBy(F.col(col).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("_k")
    return df.join(often, F.col(col) == F.col("_k"), "left").withColumn(out, F.coalesce("_k", F.lit(other))).drop("_k")


def encode_texts(df: DataFrame, protect=(), most: int = 50) -> DataFrame:
    """Text columns of fewer than ``most`` distinct values (null is one) as codes, others dropped."""
    cols = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in set(protect)]
    if not cols:
        return df
    n = df.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in cols]).first()
    for c in cols:
        df = label_encode(df, c, "_code").drop(c).withColumnRenamed("_code", c) if (n[c] or 0) < most else df.drop(c)
    return df


def impute_median(df: DataFrame, cols) -> DataFrame:
    """Nulls of numeric columns replaced by the column's exact median over all rows (null if it has none)."""
    m = df.agg(*[F.median(c).alias(f"_m_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(m))
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in cols}).drop(*[f"_m_{c}" for c in cols])


def name_feature_table(df: DataFrame, col: str) -> DataFrame:
    """All features of a host-name column, with the encoded top-level domain (rare ones as ``other``)."""
    out = df.withColumns(scalar.name_features(F.col(col))).withColumn("_tld", scalar.top_level(F.col(col)))
    return label_encode(collapse_rare(out, "_tld", "_common"), "_common", "cn_tld_encoded").drop("_tld", "_common")


def prepare_detector(df: DataFrame, label: str = "label") -> DataFrame:
    """Label to id, leakage dropped, name features added, texts encoded, medians filled."""
    if label in df.columns:
        df = df.withColumn(label, scalar.label_id(F.col(label)))
    df = drop_leakage(df, protect=("flow_uid", "flow_id", label))
    if "cn_value" in df.columns:
        df = name_feature_table(df, "cn_value").drop("cn_value")
    df = encode_texts(df, protect=("flow_uid", "flow_id", label))
    nums = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != label]
    return impute_median(df, nums) if nums else df


def numeric_map(df: DataFrame, cols, out: str = "num_features") -> DataFrame:
    """Adds one map of the columns' finite numbers."""
    return df.withColumn(out, F.create_map(*[x for c in cols for x in (F.lit(c), scalar.safe_number(F.col(c)))]))


def melt(df: DataFrame, ids, values, name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def replace_semantic(df: DataFrame, old: list[str], vector: str, size: int) -> DataFrame:
    """Wide semantic columns swapped for the elements of a reduced vector; all others stay."""
    return df.select(*[F.col(c) for c in df.columns if c not in {*old, vector}], *[F.get(vector, i).alias(f"feat_{i}") for i in range(size)])
