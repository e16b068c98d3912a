"""Stored models: newest checkpoint, column order, detector-only inference."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.boosting import Trees
from ..operators.reducer import SupConReducer
from . import detect


def newest(paths: DataFrame, prefix: str = "checkpoint-") -> DataFrame:
    """Of folder names (``path``) that start with ``prefix`` the one with the largest number in its name, -1 without digits."""
    name = F.element_at(F.split(F.rtrim("path", F.lit("/")), "/"), -1)
    digits = F.regexp_replace(name, "[^0-9]", "")
    number = F.coalesce(digits.try_cast("long"), F.lit(-1).cast("long"))
    return paths.where(name.startswith(prefix)).orderBy(number.desc(), F.col("path").desc()).select("path", number.alias("number")).limit(1)


def latest_checkpoint(spark, folder: str, prefix: str = "checkpoint-") -> str | None:
    """Path of the newest checkpoint folder, None if there is none (any file system Spark knows)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    names = [(s.getPath().toString(),) for s in fs.listStatus(p) if s.isDirectory()]
    got = newest(spark.createDataFrame(names, "path string"), prefix).first()
    return got and got.path


def save_columns(spark, columns: list[str], path: str) -> None:
    spark.createDataFrame([(json.dumps(columns),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_columns(spark, path: str) -> list[str]:
    return json.loads(spark.read.text(path).first().value)


def assemble(spark, base: str, adapter: str | None) -> tuple[str, str]:
    """Newest base checkpoint under ``base`` and the adapter; an error if either is absent."""
    found = latest_checkpoint(spark, base)
    if found is None:
        raise FileNotFoundError(f"no checkpoint under {base}")
    if adapter is None or not _exists(spark, adapter):
        raise FileNotFoundError(f"no adapter at {adapter}")
    return found, adapter


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_detector(spark, trained: dict, path: str) -> None:
    """Model, column order and medians of :func:`detect.train_detector`."""
    trained["model"].write().overwrite().save(f"{path}/model")
    save_columns(spark, trained["columns"], f"{path}/columns")
    spark.createDataFrame([(json.dumps(trained["medians"]),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/medians")


def infer(spark, df: DataFrame, path: str, uid: str = "flow_uid") -> DataFrame:
    """Predictions of a stored detector; its columns in stored order, gaps filled with its medians, no training."""
    columns = load_columns(spark, f"{path}/columns")
    medians = json.loads(spark.read.text(f"{path}/medians").first().value)
    ready = df.withColumns({c: F.col(c).cast("double") for c in columns}).na.fill(medians).na.fill(0.0, columns)
    return detect.predict(PipelineModel.load(f"{path}/model"), ready, uid, label=None)


def save_boosted(spark, trained: dict, path: str) -> None:
    """Trees, medians and reducer of :func:`detect.train_boosted`; rounds are a row each."""
    trees = json.loads(trained["trees"].to_json())
    head = {**{k: trees[k] for k in ("features", "classes", "edges", "depth", "losses")}, "medians": trained["medians"], "reduced": trained["reducer"] is not None}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(trees["rounds"])], "round int, trees string").write.mode("overwrite").parquet(f"{path}/rounds")
    if trained["reducer"] is not None:
        trained["reducer"].save(spark, f"{path}/reducer")


def infer_boosted(spark, df: DataFrame, path: str, uid: str = "flow_uid") -> DataFrame:
    """Predictions of a stored boosted detector: gaps filled with its medians, semantic columns reduced if it has a reducer, no training."""
    head = json.loads(spark.read.option("wholetext", "true").text(f"{path}/head").first().value)
    rounds = [json.loads(r["trees"]) for r in spark.read.parquet(f"{path}/rounds").orderBy("round").collect()]
    trees = Trees.from_json(json.dumps({**{k: head[k] for k in ("features", "classes", "edges", "depth", "losses")}, "rounds": rounds}))
    columns = list(head["medians"])
    ready = df.withColumns({c: F.col(c).cast("double") for c in columns}).na.fill(head["medians"]).na.fill(0.0, columns)
    if head["reduced"]:
        ready, _ = detect.reduced(ready, SupConReducer.load(spark, f"{path}/reducer"))
    return detect.boosted_predictions(ready, trees, uid, label=None)
