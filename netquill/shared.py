"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and the session is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("netquill.scratch.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="netquill-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("netquill.scratch.dir", made)
    return made


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; two runs never meet in it."""
    return f"{shared_dir(spark)}/netquill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table read back: lineage ends there, and the table outlives any executor."""
    path, schema = fresh_dir(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
