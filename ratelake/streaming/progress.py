"""What the micro-batches of running streams did: when they were triggered, how much they took, how far they lag.

``watch`` registers a listener with the session. Spark calls it after every micro-batch; it keeps the
newest ``keep`` records of each query, so a stream that runs for a year holds no more than one that
ran for an hour. ``as_table`` gives the records as a DataFrame.
"""

from __future__ import annotations

import datetime as dt
import threading
import time
from collections import deque
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

RECORD = "query string, batch_id long, started timestamp, interval_ms long, duration_ms long, input_rows long, late boolean"


class TriggerLog(StreamingQueryListener):
    """Records of micro-batches that read something, by query id."""

    def __init__(self, interval_ms: int | None = None, keep: int = 10_000):
        self.interval_ms, self.keep = interval_ms, keep
        self.records: dict[str, deque[dict[str, Any]]] = {}
        self.ended: dict[str, str | None] = {}
        self.lock = threading.Lock()

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802 - the API's names
        with self.lock:
            self.records.setdefault(str(event.id), deque(maxlen=self.keep))

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        p = event.progress
        if not p.numInputRows:
            return
        with self.lock:
            own = self.records.setdefault(str(p.id), deque(maxlen=self.keep))
            if own and own[-1]["batch_id"] == p.batchId:
                return
            started = dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
            duration = int(p.durationMs.get("triggerExecution", p.batchDuration or 0))
            interval = None if not own else round((started - own[-1]["started"]).total_seconds() * 1000)
            # Late: the batch took longer than its trigger interval, so the next one cannot start on time.
            late = self.interval_ms is not None and duration > self.interval_ms
            own.append({"query": str(p.id), "batch_id": p.batchId, "started": started, "interval_ms": interval,
                        "duration_ms": duration, "input_rows": p.numInputRows, "late": late})

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        """An idle trigger reads nothing and is not recorded."""

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        with self.lock:
            self.ended[str(event.id)] = event.exception

    def of(self, query: StreamingQuery | str) -> list[dict[str, Any]]:
        with self.lock:
            return list(self.records.get(query if isinstance(query, str) else str(query.id), ()))

    def wait_ended(self, query: StreamingQuery | str, seconds: float = 30) -> None:
        """Wait until the session has reported the end of a query: all its records are in by then."""
        own, limit = query if isinstance(query, str) else str(query.id), time.monotonic() + seconds
        while own not in self.ended and time.monotonic() < limit:
            time.sleep(0.05)
        if own not in self.ended:
            raise TimeoutError(f"no end reported for query {own}")

    def as_table(self, spark: SparkSession, query: StreamingQuery | str) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.of(query)], RECORD)

    def summary(self, query: StreamingQuery | str) -> dict[str, Any]:
        """Batches, rows, the shortest and longest distance of two triggers, and how many batches were late."""
        own = self.of(query)
        gaps = [r["interval_ms"] for r in own if r["interval_ms"] is not None]
        return {"batches": len(own), "input_rows": sum(r["input_rows"] for r in own), "min_interval_ms": min(gaps, default=None),
                "max_interval_ms": max(gaps, default=None), "late": sum(r["late"] for r in own)}


def watch(spark: SparkSession, interval_ms: int | None = None, keep: int = 10_000) -> TriggerLog:
    """A listener that records every stream of the session from now on; ``unwatch`` removes it."""
    log = TriggerLog(interval_ms, keep)
    spark.streams.addListener(log)
    return log


def unwatch(spark: SparkSession, log: TriggerLog) -> None:
    spark.streams.removeListener(log)
