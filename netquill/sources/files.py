"""Text sources and sinks: CSV, JSON lines, reports."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FLOW_JSONL, LABEL2ID, NUMERIC_FEATURES, require_columns
from . import csv_scan


def first_existing(spark, paths) -> str:
    """The first path that exists (any file system Spark knows); an error without one."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return path
    raise FileNotFoundError(", ".join(paths))


def scratch_path(spark, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only a local session without one takes a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="netquill-scratch-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def count_rows(spark, path: str, kind: str = "csv") -> int:
    """Data rows of CSV files with headers, or non-empty lines of JSON lines files."""
    if kind == "csv":
        return spark.read.option("header", True).csv(path).count()
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).count()


def merge_parts(spark, parts: list[str], path: str) -> int:
    """Part files with headers as one CSV folder, by column name, all text; parts are deleted once it is written.

    Returns the rows written; without parts nothing is written.
    """
    if not parts:
        return 0
    merged = union_all([spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(p) for p in parts])
    write_csv(merged, path)
    for p in parts:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return count_rows(spark, path)


def read_images(spark, folder: str, aliases: dict[str, str]) -> DataFrame:
    """``alias`` and ``content`` of report images, by an alias to file-name map; absent files have no row."""
    names = spark.createDataFrame(list(aliases.items()), "alias string, file string")
    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return found.join(F.broadcast(names), "file").select("alias", "content")


def read_csv(spark, path: str, columns=None, schema=None, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with header; all text unless a schema is given, only ``columns`` if named."""
    r = spark.read.option("header", True).option("multiLine", False).option("quote", '"').option("escape", '"').option("encoding", encoding)
    df = (r.schema(schema) if schema else r).csv(path)
    return df.select(*columns) if columns else df


def read_csv_any_encoding(spark, path: str, columns=None) -> DataFrame:
    """UTF-8, or GB18030 where a file holds what UTF-8 cannot decode; byte ranges, a header a file."""
    return csv_scan.scan_csv(spark, path, columns)


def read_flow_csv(spark, path: str) -> DataFrame:
    """A flow feature CSV with its required and numeric columns checked; numbers as doubles, unparsable ones null."""
    df = require_columns(read_csv(spark, path), ["flow_uid", "label", *NUMERIC_FEATURES])
    return df.withColumns({c: F.col(c).try_cast("double") for c in NUMERIC_FEATURES})


def find_row(df: DataFrame, key: str, value, columns=None) -> DataFrame:
    """The first row of a key; the filter is pushed to the scan."""
    out = df.where(F.col(key) == value)
    return (out.select(*columns) if columns else out).limit(1)


def read_flows(spark, path: str) -> DataFrame:
    return spark.read.schema(FLOW_JSONL).json(path)


def read_texts(spark, path: str) -> DataFrame:
    return read_flows(spark, path).where(F.length(F.trim("text")) > 0).select("text")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_by_label(df: DataFrame, path: str, mode: str = "append") -> None:
    """Packets partitioned by label and link type."""
    df.write.mode(mode).partitionBy("label", "linktype").parquet(path)


def vector_table(df: DataFrame, vec: str, size: int, ids=("flow_uid",), extra=()) -> DataFrame:
    """Ids, ``feat_0`` ... and, for the fused form, further columns."""
    return df.select(*ids, *[F.get(vec, i).alias(f"feat_{i}") for i in range(size)], *extra)


def union_all(frames) -> DataFrame:
    """Rows of all frames by column name; columns missing in one are null there."""
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def report_rows(lines: DataFrame) -> DataFrame:
    """Rows of a classification report given as ``section`` and ``line``: name, precision, recall, f1, support.

    The accuracy line has one number; it stands for all three.
    """
    num = r"(\d+(?:\.\d+)?)"
    full = rf"^\s*(\S.*?)\s+{num}\s+{num}\s+{num}\s+(\d+)\s*$"
    acc = rf"^\s*accuracy\s+{num}\s+(\d+)\s*$"
    x = F.col("line")
    is_full, is_acc = x.rlike(full), x.rlike(acc)
    pick = lambda i: F.when(is_full, F.regexp_extract(x, full, i)).when(is_acc, F.regexp_extract(x, acc, 1)).cast("double")
    return lines.where(is_full | is_acc).select(
        "section",
        F.when(is_full, F.regexp_extract(x, full, 1)).otherwise("accuracy").alias("name"),
        pick(2).alias("precision"),
        pick(3).alias("recall"),
        pick(4).alias("f1"),
        F.when(is_full, F.regexp_extract(x, full, 5)).otherwise(F.regexp_extract(x, acc, 2)).cast("long").alias("support"),
    )


def read_report(spark, path: str) -> DataFrame:
    """Reports of one or more sections (``=== name ===``); every file is read whole, reports being small."""
    text = spark.read.text(path, wholetext=True)
    parts = text.select(F.explode(F.split("value", r"(?m)^(?====)")).alias("part"))
    named = parts.select(F.regexp_extract("part", r"^===\s*(.*?)\s*===", 1).alias("section"), F.explode(F.split("part", "\n")).alias("line"))
    return report_rows(named)


def label_join(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``label_name`` from a broadcast table of the classes."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, n) for n, i in LABEL2ID.items()], "_id int, label_name string")
    return df.join(F.broadcast(names), F.col(label) == F.col("_id"), "left").drop("_id")
