"""Counts taken in passing: what a job has seen, told by the job itself, without a scan of their own."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent


def top_with_total(rows: DataFrame, order: list[Column], k: int, **counts: Column) -> tuple[DataFrame, Observation]:
    """The first k rows, and an observation whose get has, once these have been collected or written, the total of all rows and the
    counts asked for. One scan gives both."""
    seen = Observation()
    watched = rows.observe(seen, F.count("*").alias("total"), *(c.alias(n) for n, c in counts.items()))
    return watched.orderBy(*order).limit(k), seen


def readiness_in_passing(rows: DataFrame, current: Column, stale: Column) -> tuple[DataFrame, Observation]:
    """rows unchanged, and an observation of documents, current and stale ones among them, made while they are written."""
    seen = Observation()
    return rows.observe(seen, F.count("*").alias("documents"), F.count_if(current).alias("current"), F.count_if(stale).alias("stale")), seen


class Progress(StreamingQueryListener):
    """What the streams of a session have read and observed so far, by query id. watch(): rows with an observation of a name.

    Add it with spark.streams.addListener. Totals of observed numbers are sums over batches; percent() never falls, and is 100
    only when the query has ended.
    """

    def __init__(self):
        self._lock, self._seen = threading.Lock(), {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        with self._lock:
            self._seen.setdefault(str(event.id), {"rows": 0, "batches": 0, "ended": False, "percent": 0, "observed": {}})["ended"] = False

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        with self._lock:
            mine = self._seen.setdefault(str(p.id), {"rows": 0, "batches": 0, "ended": False, "percent": 0, "observed": {}})
            mine["rows"] += max(0, p.numInputRows)
            mine["batches"] += 1
            for name, row in p.observedMetrics.items():
                sums = mine["observed"].setdefault(name, {})
                for k, v in row.asDict().items():
                    sums[k] = sums.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        with self._lock:
            if str(event.id) in self._seen:
                self._seen[str(event.id)]["ended"] = True

    def of(self, query_id: str) -> dict:
        with self._lock:
            found = self._seen.get(str(query_id), {"rows": 0, "batches": 0, "ended": False, "percent": 0, "observed": {}})
            return found | {"observed": {k: dict(v) for k, v in found["observed"].items()}}

    def percent(self, query_id: str, total: int) -> int:
        """How much of a total number of rows has been read."""
        with self._lock:
            mine = self._seen.get(str(query_id))
            if mine is None:
                return 0
            mine["percent"] = 100 if mine["ended"] else max(mine["percent"], min(99, 100 * mine["rows"] // total if total else 0))
            return mine["percent"]


def watch(stream: DataFrame, name: str, **counts: Column) -> DataFrame:
    """stream unchanged, its batches observed under a name: rows, and the counts asked for."""
    return stream.observe(name, F.count("*").alias("rows"), *(c.alias(n) for n, c in counts.items()))
