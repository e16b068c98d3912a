"""Read queries over stored results: paging, detail, predictions, evaluation, dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.files import find_row
from .extract import tls_details


def metadata_page(flows: DataFrame, limit: int = 50, offset: int = 0, order: str = "flow_uid") -> DataFrame:
    return flows.orderBy(order).offset(offset).limit(limit)


def metadata_detail(flows: DataFrame, features: DataFrame, uid: str) -> DataFrame:
    """One flow with its TLS fields; the filter reaches both scans."""
    logs = find_row(features, "flow_uid", uid, ["flow_uid", "zeek_conn_log", "zeek_ssl_log", "zeek_x509_log"])
    return find_row(flows, "flow_uid", uid).join(tls_details(logs).drop("zeek_conn_log", "zeek_ssl_log", "zeek_x509_log"), "flow_uid", "left")


def predictions_page(predictions: DataFrame, limit: int = 50, offset: int = 0, label: str | None = None, order: str = "flow_uid") -> DataFrame:
    rows = predictions if label is None else predictions.where(F.col("pred_label_name") == label)
    return rows.orderBy(order).offset(offset).limit(limit)


def evaluation(report: DataFrame) -> DataFrame:
    """Report rows with the models by falling weighted F1."""
    best = report.where(F.col("name") == "weighted avg").select("section", F.col("f1").alias("weighted_f1"))
    return report.join(best, "section", "left").orderBy(F.desc_nulls_last("weighted_f1"), "section", "name")


def dashboard(flows: DataFrame, predictions: DataFrame) -> dict[str, DataFrame]:
    return {"flows": flows.agg(F.count(F.lit(1)).alias("flows"), F.sum("total_packets").alias("packets"), F.sum("total_bytes").alias("bytes")), "labels": metrics.value_counts(predictions, "pred_label_name"), "protocols": metrics.value_counts(flows, "protocol")}


def recent_tasks(tasks: DataFrame, limit: int = 20) -> DataFrame:
    """The tasks started last."""
    return tasks.orderBy(F.desc_nulls_last("started_at"), "task_id").limit(limit)


def task_counts(tasks: DataFrame) -> DataFrame:
    """Numbers of all, running, done and failed tasks in one row."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return tasks.agg(F.count(F.lit(1)).alias("total"), is_("running").alias("running"), is_("done").alias("done"), is_("failed").alias("failed"))


def pool_shares(n_semantic: int, n_manual: int) -> dict[str, float]:
    """Size of the candidate pool and the shares of semantic and manual features in it."""
    total = n_semantic + n_manual
    return {"total": total, "semantic": n_semantic / total if total else 0.0, "manual": n_manual / total if total else 0.0}
