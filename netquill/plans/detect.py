"""Training and use of the detector: boosted trees per class, baselines, ablation, reports."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import boosting, metrics, splits, vectors
from ..operators.features import drop_leakage, impute_median
from ..operators.reducer import SupConReducer
from ..schemas import numeric_columns
from ..shared import written


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds the balanced weight of each row's class."""
    w = metrics.class_weights(df, label).select(F.col("label").alias("_l"), F.col("balanced_weight").alias("weight"))
    return df.join(F.broadcast(w), F.col(label) == F.col("_l")).drop("_l")


def baseline_models(label: str = "label", weight: str = "weight", seed: int = 42) -> dict:
    common = {"labelCol": label, "featuresCol": "features"}
    return {
        "DecisionTree": DecisionTreeClassifier(**common, weightCol=weight, seed=seed),
        "LogisticRegression": LogisticRegression(**common, weightCol=weight, maxIter=50),
        "GaussianNB": NaiveBayes(**common, weightCol=weight, modelType="gaussian"),
        "RandomForest": RandomForestClassifier(**common, weightCol=weight, seed=seed, numTrees=50),
    }


def boosted(label: str = "label", weight: str = "weight", rounds: int = 50, seed: int = 42) -> OneVsRest:
    """One boosted model per class, rows weighted by class."""
    gbt = GBTClassifier(maxIter=rounds, seed=seed, featuresCol="features", weightCol=weight)
    return OneVsRest(classifier=gbt, labelCol=label, featuresCol="features", weightCol=weight)


def fit(train: DataFrame, columns: list[str], model, label: str = "label") -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"), model]).fit(with_weights(train, label))


def predict(model: PipelineModel, df: DataFrame, uid: str = "flow_uid", label: str | None = "label", classes: int = 8) -> DataFrame:
    """``flow_uid``, true and predicted label with names, confidence and scores.

    Where the model gives no probabilities, class scores become some by softmax.
    """
    out = model.transform(df)
    if "probability" in out.columns:
        scores = vector_to_array("probability")
    else:
        raw = vector_to_array("rawPrediction")
        e = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
        scores = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
    top = F.element_at(scores, F.col("prediction").cast("int") + 1)
    cols = [F.col(uid), F.col("prediction").cast("int").alias("pred_label"), scalar.label_name(F.col("prediction")).alias("pred_label_name"), top.alias("confidence"), scores.alias("scores")]
    if label and label in df.columns:
        cols[1:1] = [F.col(label).cast("int").alias("true_label"), scalar.label_name(F.col(label)).alias("true_label_name")]
    return out.select(*cols)


def train_detector(df: DataFrame, uid: str = "flow_uid", label: str = "label", columns: list[str] | None = None, model=None, seed: int = 42) -> dict:
    """Split 70/10/20, medians of the training rows, fit, predict the test rows.

    Medians come from training rows only, so no test value leaks into them.
    """
    columns = columns or numeric_columns(drop_leakage(df), exclude=[uid, label])
    parts = splits.stratified_split(df.where(F.col(label).isNotNull()), uid, label, seed=seed)
    train = parts.where("subset <> 'test'")
    medians = train.agg(*[F.median(c).alias(c) for c in columns]).first().asDict()
    fill = {c: float(v) for c, v in medians.items() if v is not None}
    clean = lambda d: d.withColumns({c: F.col(c).cast("double") for c in columns}).na.fill(fill).na.fill(0.0, columns)
    fitted = fit(clean(train), columns, model or boosted(label), label)
    return {"model": fitted, "columns": columns, "medians": fill, "predictions": predict(fitted, clean(parts.where("subset = 'test'")), uid, label)}


def reduced(df: DataFrame, reducer: SupConReducer) -> tuple[DataFrame, list[str]]:
    """The reducer's columns replaced by its latent ones, ``latent_0`` and on, and their names."""
    names = [f"latent_{i}" for i in range(reducer.cfg["latent_dim"])]
    out = reducer.transform(df, reducer.columns, "_latent")
    return out.withColumns({c: F.get("_latent", F.lit(i)) for i, c in enumerate(names)}).drop("_latent", *reducer.columns), names


def train_boosted(df: DataFrame, uid: str = "flow_uid", label: str = "label", columns: list[str] | None = None, semantic: list[str] | None = None, classes: int = 8, reducer: dict | None = None, seed: int = 42, **boost) -> dict:
    """Split 70/10/20, optionally reduce ``semantic`` columns, boost all classes together until validation stops improving.

    Medians, scaling, reducer and bins come from training rows; validation rows
    end the training of reducer and trees; the test rows are predicted.
    """
    semantic = list(semantic or [])
    columns = numeric_columns(drop_leakage(df), exclude=[uid, label]) if columns is None else columns
    columns = [c for c in columns if c not in semantic]
    parts = splits.stratified_split(df.where(F.col(label).isNotNull()), uid, label, seed=seed)
    medians = parts.where("subset = 'train'").agg(*[F.median(F.col(c).cast("double")).alias(c) for c in columns + semantic]).first().asDict()
    fill = {c: float(v) for c, v in medians.items() if v is not None}
    ready = parts.withColumns({c: F.col(c).cast("double") for c in columns + semantic}).na.fill(fill).na.fill(0.0, columns + semantic)
    model = None
    if semantic and reducer is not None:
        model = SupConReducer(**reducer).fit(ready.where("subset = 'train'"), ready.where("subset = 'val'"), semantic, label, uid)
        ready, latent = reduced(ready, model)
        columns = columns + latent
    else:
        columns = columns + semantic
    trees = boosting.fit_boosted(with_weights(ready.where("subset <> 'test'"), label), columns, label, classes, valid=F.col("subset") == "val", weight="weight", **boost)
    return {"trees": trees, "reducer": model, "medians": fill, "columns": columns, "predictions": boosted_predictions(ready.where("subset = 'test'"), trees, uid, label)}


def boosted_predictions(df: DataFrame, trees: boosting.Trees, uid: str = "flow_uid", label: str | None = "label") -> DataFrame:
    """The columns of :func:`predict` from boosted trees."""
    cols = [F.col(uid), "pred_label", scalar.label_name(F.col("pred_label")).alias("pred_label_name"), "confidence", "scores"]
    if label and label in df.columns:
        cols[1:1] = [F.col(label).cast("int").alias("true_label"), scalar.label_name(F.col(label)).alias("true_label_name")]
    return boosting.predict_boosted(df, trees).select(*cols)


def evaluate(predictions: DataFrame, labels=range(8)) -> dict[str, DataFrame]:
    long = metrics.one_vs_rest(predictions, "true_label", "scores", len(list(labels)))
    return {"confusion": metrics.confusion(predictions, "true_label", "pred_label", labels), "report": metrics.class_report(predictions, "true_label", "pred_label", labels), "micro_auc": metrics.micro_auc(long, "truth", "score")}


def ablation(df: DataFrame, groups: dict[str, list[str]], uid: str = "flow_uid", label: str = "label", make_model=None, labels=range(8)) -> DataFrame:
    """Accuracy, macro F1 and micro AUC of a model per feature group."""
    out = None
    for name, columns in groups.items():
        got = train_detector(df, uid, label, columns, make_model() if make_model else None)
        parts = evaluate(got["predictions"], labels)
        rep = parts["report"].where(F.col("class").isin("accuracy", "macro avg")).select(F.lit(name).alias("group"), F.when(F.col("class") == "accuracy", "accuracy").otherwise("macro_f1").alias("metric"), F.col("f1").alias("value"))
        part = rep.unionByName(parts["micro_auc"].select(F.lit(name).alias("group"), F.lit("micro_auc").alias("metric"), F.col("auc").alias("value")))
        out = part if out is None else out.unionByName(part)
    return out


def compare_models(df: DataFrame, uid: str = "flow_uid", label: str = "label", columns: list[str] | None = None, models: dict | None = None, classes: int = 8, neighbours: int = 5, seed: int = 42, **boost) -> DataFrame:
    """``model``, ``accuracy``, ``macro_f1`` and ``weighted_f1`` on one set of test rows, for the baselines, k nearest neighbours and boosted trees.

    All see the same split, the same medians and, but for the trees, which need
    none, the same scaling by the training rows' moments.
    """
    columns = numeric_columns(drop_leakage(df), exclude=[uid, label]) if columns is None else list(columns)
    parts = splits.stratified_split(df.where(F.col(label).isNotNull()), uid, label, seed=seed)
    train = parts.where("subset <> 'test'")
    found = train.agg(*[F.median(F.col(c).cast("double")).alias(c) for c in columns]).first().asDict()
    fill = {c: float(v) for c, v in found.items() if v is not None}
    clean = lambda d: d.withColumns({c: F.col(c).cast("double") for c in columns}).na.fill(fill).na.fill(0.0, columns)
    ready = written(clean(parts).withColumn("_id", F.monotonically_increasing_id()), "compared")
    learn, test = ready.where("subset <> 'test'"), ready.where("subset = 'test'")
    r = learn.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    scaled = lambda d: d.withColumns({c: (F.col(c) - F.lit(r[c]["m"])) / F.lit(r[c]["s"] or 1.0) for c in columns})
    predicted = {name: predict(fit(scaled(learn), columns, m, label), scaled(test), uid, label) for name, m in (baseline_models(label, seed=seed) if models is None else models).items()}
    vector = lambda d: scaled(d).select("_id", F.col(label).cast("int").alias("true_label"), F.array(*columns).alias("_v"))
    near = vectors.knn_classify(vector(test), vector(learn), "_v", "_id", "true_label", neighbours)
    predicted["KNN"] = vector(test).join(near, F.col("_id") == F.col("query_id")).select("true_label", "pred_label")
    trees = boosting.fit_boosted(with_weights(ready.where("subset <> 'test'"), label), columns, label, classes, valid=F.col("subset") == "val", weight="weight", **boost)
    predicted["Boosted"] = boosted_predictions(test, trees, uid, label)
    out = None
    for name, p in predicted.items():
        rep = metrics.class_report(p, "true_label", "pred_label", range(classes))
        f1 = lambda kind: F.max(F.when(F.col("class") == kind, F.col("f1")))
        part = rep.agg(f1("accuracy").alias("accuracy"), f1("macro avg").alias("macro_f1"), f1("weighted avg").alias("weighted_f1")).select(F.lit(name).alias("model"), "accuracy", "macro_f1", "weighted_f1")
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc("macro_f1"), "model")


def detection_assets(predictions: DataFrame, times: DataFrame | None = None, uid: str = "flow_uid") -> dict[str, DataFrame]:
    """Tables behind the detection report: summary, class counts, confident malicious rows, trend by row, trend by time."""
    out = {
        "summary": metrics.detection_summary(predictions, "pred_label"),
        "classes": metrics.value_counts(predictions, "pred_label_name"),
        "malicious": metrics.high_confidence_malicious(predictions),
    }
    if times is not None:
        t = predictions.join(times, uid)
        out["time_trend"] = metrics.time_bins(t, "timestamp", "pred_label")
        ranked = splits.class_ranks(t.withColumn("_all", F.lit(0)), uid, ["_all"])
        out["row_trend"] = metrics.row_segments(ranked, "_rank", "pred_label")
    return out


def export_assets(assets: dict[str, DataFrame], path: str) -> list[str]:
    """Every table as CSV with a header in a folder of its name; the folders."""
    out = []
    for name, df in sorted(assets.items()):
        flat = df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")})
        flat.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        out.append(f"{path}/{name}")
    return out


def save(model: PipelineModel, path: str) -> PipelineModel:
    """Written and read back; what comes back is returned."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


__all__ = ["ablation", "baseline_models", "boosted", "boosted_predictions", "compare_models", "detection_assets", "evaluate", "export_assets", "fit", "impute_median", "predict", "reduced", "save", "train_boosted", "train_detector", "with_weights"]
