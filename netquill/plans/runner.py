"""Staged runs: named stages over a context, timed, resumable, cancellable."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

METRICS = "stage string, status string, wall_s double, cpu_s double, rows long, message string"


def run_pipeline(spark: SparkSession, stages: Iterable[tuple[str, Callable]], context: dict, done: Callable[[str], bool] = lambda _: False, listen: Callable[[str, str], None] = lambda *_: None) -> DataFrame:
    """Run ``(name, function(spark, context))`` in order and return a row of figures per stage.

    Stages ``done`` are skipped; the first failure stops the run.  A stage may
    return a number of rows.  All jobs of a stage bear the tag ``stage-<name>``,
    so :func:`cancel` ends them.
    """
    rows = []
    for name, stage in stages:
        if done(name):
            rows.append((name, "skipped", 0.0, 0.0, None, None))
            continue
        listen(name, "started")
        wall, cpu, status, n, message = time.perf_counter(), time.process_time(), "ok", None, None
        spark.addTag(f"stage-{name}")
        try:
            n = stage(spark, context)
        except Exception as e:  # noqa: BLE001  reported as a row
            status, message = "failed", str(e)[:500]
        finally:
            spark.removeTag(f"stage-{name}")
        rows.append((name, status, time.perf_counter() - wall, time.process_time() - cpu, n if isinstance(n, int) else None, message))
        listen(name, status)
        if status == "failed":
            break
    return spark.createDataFrame(rows, METRICS)


def cancel(spark: SparkSession, name: str) -> list[str]:
    """Interrupt the jobs of a stage that is running."""
    return spark.interruptTag(f"stage-{name}")
