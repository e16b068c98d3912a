"""Joins of the pipeline: interval semi-join, membership, certificate chain, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_semi_join(left: DataFrame, right: DataFrame, keys, ts: str, right_ts: str, span: int) -> DataFrame:
    """Rows of ``left`` with a row of ``right`` of equal keys and at most ``span`` seconds away.

    Times are cut into cells of ``span``: a match lies in the same or a
    neighbouring cell, so the join is an equi-join on keys and cell, and a busy
    key is dealt over its cells.  Right rows of time 0 or null do not count.
    """
    cell = lambda x: F.floor(x / span)
    r = right.where(F.col(right_ts) > 0).select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(right_ts).alias("_rt")).distinct()
    r = r.withColumn("_rc", F.explode(F.array(*[cell(F.col("_rt")) + d for d in (-1, 0, 1)])))
    cond = cell(F.col(ts)) == F.col("_rc")
    for k in keys:
        cond &= F.col(k) == F.col(f"_r_{k}")
    return left.join(r, cond & (F.abs(F.col(ts) - F.col("_rt")) <= span), "left_semi")


def member_flags(df: DataFrame, sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Adds a 0/1 column per named key table."""
    for name, keys in sets.items():
        df = df.join(keys.select(F.col(key).alias("_k")).distinct().withColumn(name, F.lit(1)), F.col(key) == F.col("_k"), "left").drop("_k")
        df = df.withColumn(name, F.coalesce(name, F.lit(0)))
    return df


def certificate_chain(ssl: DataFrame, certs: DataFrame, uid: str = "uid", chain: str = "cert_chain_fps", fp: str = "fp") -> DataFrame:
    """Per connection its chain's certificates in chain order, unknown fingerprints left out, and the chain's length.

    Of equal fingerprints in ``certs`` the one of the smallest ``pkt_no`` is used.
    """
    rest = [c for c in certs.columns if c not in (fp, "pkt_no")]
    known = certs.groupBy(fp).agg(F.min_by(F.struct(*rest), "pkt_no").alias("cert"))
    long = ssl.select(uid, F.posexplode(F.split(chain, ",")).alias("pos", fp))
    got = long.join(known, fp, "left").groupBy(uid).agg(F.array_sort(F.collect_list(F.when(F.col("cert").isNotNull(), F.struct("pos", "cert")))).alias("c"), F.count(F.lit(1)).alias("cert_chain_depth"))
    return got.select(uid, F.transform("c", lambda x: x["cert"]).alias("certs"), "cert_chain_depth")


def by_row(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Side by side by an explicit row id (never by position); clashing names keep the left column."""
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c != row_id]), row_id)
