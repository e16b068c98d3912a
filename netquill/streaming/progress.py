"""Progress of streams as rows: a listener keeps them, the session reads them as a table."""

from __future__ import annotations

import json
import threading
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

_DDL = "run_id string, name string, event string, batch long, at string, rows_in long, rows_a_second double, state_rows long, watermark string, error string"


class Progress(StreamingQueryListener):
    """Started, progress and terminated events of all streams, the last ``most`` of them."""

    def __init__(self, most: int = 10_000):
        self.rows: deque[tuple] = deque(maxlen=most)
        self.lock = threading.Lock()

    def _add(self, *row) -> None:
        with self.lock:
            self.rows.append(row)

    def onQueryStarted(self, event) -> None:
        self._add(str(event.runId), event.name, "started", None, event.timestamp, None, None, None, None, None)

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        state = sum(s.get("numRowsTotal", 0) for s in p.get("stateOperators", []))
        self._add(p["runId"], p.get("name"), "progress", p["batchId"], p["timestamp"], p.get("numInputRows"), p.get("processedRowsPerSecond"), state, p.get("eventTime", {}).get("watermark"), None)

    def onQueryIdle(self, event) -> None:
        self._add(str(event.runId), None, "idle", None, event.timestamp, None, None, None, None, None)

    def onQueryTerminated(self, event) -> None:
        self._add(str(event.runId), None, "terminated", None, None, None, None, None, None, event.exception)

    def table(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(list(self.rows), _DDL)


def watch(spark: SparkSession, most: int = 10_000) -> Progress:
    """A listener that hears all streams of the session from now on; ``spark.streams.removeListener`` ends it."""
    listener = Progress(most)
    spark.streams.addListener(listener)
    return listener
