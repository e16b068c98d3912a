"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import math
import shutil
import tempfile
import uuid
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Key ranges of a sharded writer, at most about so many: what the driver holds of them is bounded.
MOST_SHARDS = 20_000
#: A word is a run of anything but space and \t \n \v \f \r; ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see.

    It is ``spark.checkpoint.dir``; only where that is unset (tests) and the
    session is local a temporary folder takes its place.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("netquill.shared.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="netquill-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("netquill.shared.dir", made)
    return made


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; two runs never meet in it."""
    return f"{shared_dir(spark)}/netquill/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """``(filesystem, path)`` of a URI or absolute path, usable on driver and executors."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def remove(uri: str) -> None:
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


def lean_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let Arrow hand texts to Python in batches of at most ``rows`` rows.

    The default of 10,000 rows is made for numbers; with texts of some
    kilobytes a worker would hold tens of MB several times over.  The setting
    stays, as results are evaluated after an operator returns.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows)


def trim() -> None:
    """Give memory that is free back to the system: Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Unlike a local checkpoint the table survives the loss of any executor.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def own_columns(df: DataFrame, **renames: str) -> DataFrame:
    """Only the named columns, under internal names that cannot clash with extra ones."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in renames.items()])


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def held_out(id_col):
    """The fixed fold: crc32 of the id as text, mod 5 = 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_volume(docs: DataFrame, col: str = "text") -> tuple[int, int]:
    """Rows and bytes of a text column (one cheap scan)."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(col)), F.lit(0)).alias("b")).first()
    return r.n, r.b


def range_bounds(df: DataFrame, key: str, weight: str, per_shard: int, fan_out: int = 1024, most_shards: int = MOST_SHARDS) -> list[int]:
    """Deterministic lower bounds of key ranges holding about ``per_shard`` weight each.

    Unlike sampled range partitioning the bounds depend only on the rows, so
    reruns write the same shards.  A weighted equal-width histogram of at least
    eight bins a shard is refined wherever a bin is too heavy, down to single
    keys; what comes to the driver is some bins per shard, aggregated, never
    rows.  There are about ``most_shards`` ranges at most: a larger table gets
    heavier ranges (100 TB: 5 GB each), so bins and bounds on the driver do not
    grow with it, and whoever uses the ranges has to stream them.  One key is
    never split.  Null keys count to the first shard.
    """
    whole = "decimal(20,0)"
    r = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum(F.col(weight).cast("double")).alias("w")).first()
    if r.lo is None:
        return []
    per_shard = max(per_shard, math.ceil((r.w or 0) / most_shards))
    lo, fan = int(r.lo), max(fan_out, 8 * math.ceil((r.w or 0) / per_shard))
    most = max(64 * fan_out, fan)
    width = max(1, -(-(int(r.hi) + 1 - lo) // fan))
    at = (F.col(key).cast(whole) - F.lit(lo).cast(whole)).cast(whole)
    rest, up, heavy, bins = at % F.lit(width).cast(whole), None, None, []
    while True:
        start = (at - rest).cast(whole)
        rows = df.where(F.col(key).isNotNull()).select(start.alias("start"), F.col(weight).cast("long").alias("w"), *([up.alias("up")] if heavy else []))
        if heavy:
            wanted = df.sparkSession.createDataFrame([(Decimal(x),) for x in heavy], f"up {whole}")
            rows = rows.join(F.broadcast(wanted), "up", "left_semi")
        got = [(int(x.start), x.w or 0) for x in rows.groupBy("start").agg(F.sum("w").alias("w")).collect()]
        heavy = [x for x, w in got if w > per_shard and width > 1]
        bins += [(lo + x, w) for x, w in got if not (w > per_shard and width > 1)]
        if not heavy:
            break
        # heavy bins are fewer than shards, so even 16 parts of each are few
        width = -(-width // max(16, min(fan_out, most // len(heavy))))
        up, rest = start, (rest % F.lit(width).cast(whole))
    bounds, filled = [], 0
    for start, w in sorted(bins):
        if not bounds or filled + w > per_shard and filled:
            bounds.append(start)
            filled = 0
        filled += w
    return bounds


def shard_of(key: str, bounds: list[int]):
    """The number of the range in ``bounds`` that holds ``key`` (nulls: 0)."""
    if len(bounds) < 2:
        return F.lit(0)
    k = F.col(key).cast("long")
    below = lambda arr: F.size(F.filter(arr, lambda x: x <= k))
    if len(bounds) <= 64:
        return F.coalesce(below(_longs(bounds[1:])), F.lit(0))
    # many bounds: blocks of them in a constant, so the expression stays small and a row costs two short searches
    step = math.isqrt(len(bounds))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    block = below(_longs([b[0] for b in blocks[1:]]))
    return F.coalesce(block * step + F.greatest(below(F.get(F.array(*[_longs(b) for b in blocks]), block)) - 1, F.lit(0)), F.lit(0))


def _longs(values: list[int]):
    """A constant array, handed over as one literal whatever its length."""
    return F.lit(np.array(values, np.int64))

