"""What jobs and streams say of themselves, as JSON lines.

Batch plans observe their rows as they pass (``DataFrame.observe``), streams report by a listener; both become entries
of one form, which ``request_metrics`` sums up as the service's own metrics.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def entry(logger: str, message: str, level: str = "INFO", request_id: str | None = None, error: str | None = None, **fields) -> str:
    """A line of the log: ts, level, logger, request_id, msg, exc if there is one, and ``fields``."""
    line = {"ts": datetime.now(UTC).isoformat(), "level": level, "logger": logger, "request_id": request_id, "msg": message, **fields}
    return json.dumps(line | ({"exc": error} if error else {}), ensure_ascii=False, default=str)


class JsonLog:
    """Lines for a sink, one call at a time."""

    def __init__(self, sink: Callable[[str], None]):
        self._sink, self._lock = sink, threading.Lock()

    def write(self, logger: str, message: str, **fields) -> None:
        with self._lock:
            self._sink(entry(logger, message, **fields))


class StreamLog(StreamingQueryListener):
    """Starts, batches and ends of streams as lines; a batch has its rows, its milliseconds and its observed metrics."""

    def __init__(self, log: JsonLog):
        self.log = log

    def onQueryStarted(self, event) -> None:
        self.log.write("stream", "started", request_id=str(event.runId), name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        observed = {name: row.asDict() for name, row in (p.observedMetrics or {}).items()}
        self.log.write("stream", "batch", request_id=str(p.runId), batch=p.batchId, rows=p.numInputRows, ms=p.batchDuration, observed=observed)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        failed = event.exception is not None
        self.log.write("stream", "ended", level="ERROR" if failed else "INFO", request_id=str(event.runId), error=event.exception)


def _sums(failed: str, seconds: str) -> list:
    return [
        F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum(F.coalesce(F.col(failed), F.lit(False)).cast("int")), F.lit(0)).cast("long").alias("errors"),
        F.coalesce(F.round(F.avg(seconds) * 1000, 1), F.lit(0.0)).alias("avg_latency_ms"),
    ]


def observed_requests(requests: DataFrame, failed: str = "failed", seconds: str = "seconds", name: str = "requests") -> tuple[DataFrame, Observation | None]:
    """``requests`` (whether each failed, and how long it took) as they are, and the metrics of those that pass: requests, errors, avg_latency_ms.

    For a stream the metrics come with each batch's progress, under ``name``, and the second is None.
    """
    if requests.isStreaming:
        return requests.observe(name, *_sums(failed, seconds)), None
    seen = Observation(name)
    return requests.observe(seen, *_sums(failed, seconds)), seen


def request_metrics(requests: DataFrame, failed: str = "failed", seconds: str = "seconds") -> DataFrame:
    """One row: requests, errors, avg_latency_ms."""
    return requests.agg(*_sums(failed, seconds))
