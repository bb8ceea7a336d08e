"""Keyed state of a stream: which version of each document is current, and which failures wait to be tried again.

A batch costs what its own rows cost: nothing is compared with the index, for each path's state says what is current. A
failure holds a document back for some hours of the stream's own time; a timer then tries it again, whether or not the
document comes once more. State lives in the stream's checkpoint, so repeated batches and restarts give what one run gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Columns of what a stream gives: made or failed attempts, by the version and the moment of the attempt (milliseconds).
ATTEMPT = "path_key string, version long, payload string, failed boolean, attempt int, at long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Attempts(StatefulProcessor):
    """work(path_key, version, text) gives a payload, or None or an error where it fails.

    Of a batch's rows of one path only the newest version counts; older versions than the current or failed one are passed over.
    """

    def __init__(self, work: Callable[[str, int, str | None], str | None], hours: float, most: int):
        self.work, self.wait, self.most = work, int(hours * 3_600_000), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one state for all: each look at a state is a call to the JVM. version to text: of the failed version, if there is one
        self.state = handle.getValueState("state", "current long, version long, attempt int, until long, text string")

    def _try(self, key: str, version: int, text: str | None, attempt: int, now: int, current: int | None) -> pd.DataFrame:
        try:
            payload = self.work(key, version, text)
        except Exception:  # a document that a model can't take is a failure like any other
            payload = None
        if payload is not None:
            self.state.update((version, None, None, None, None))
        elif attempt < self.most:
            self.state.update((current, version, attempt, now + self.wait, text))
            self.handle.registerTimer(now + self.wait)
        else:
            self.state.update((current, version, attempt, 2**62, None))
        return pd.DataFrame({"path_key": [key], "version": [version], "payload": [payload], "failed": [payload is None], "attempt": [attempt], "at": [now]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = None
        for part in rows:
            version, text = part["version"].to_numpy(), part["text"].to_numpy()
            known = [t is not None and t == t for t in text]  # null is the least
            i = max(np.flatnonzero(version == version.max()).tolist(), key=lambda i: (known[i], text[i] if known[i] else "", i))
            if newest is None or version[i] >= newest[0]:
                newest = (int(version[i]), text[i] if known[i] else None, int(part["seen"].iloc[i].timestamp() * 1000))
        if newest is None:
            return
        version, text, seen = newest
        current, failed = self._seen()
        if (current is not None and version <= current) or (failed is not None and version <= failed[0]):
            return
        now = max(seen, timerValues.getCurrentWatermarkInMs())
        if failed is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        yield self._try(key[0], version, text, 1, now, current)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        current, failed = self._seen()
        if failed is not None and failed[2] <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._try(key[0], failed[0], failed[3], failed[1] + 1, expiredTimerInfo.getExpiryTimeInMs(), current)

    def _seen(self) -> tuple[int | None, tuple | None]:
        """The current version, and the failed one with its attempts, when it may be tried again, and its text."""
        now = self.state.get()
        return (None, None) if now is None else (now[0], None if now[1] is None else tuple(now[1:]))


def attempts(stream: DataFrame, work: Callable[[str, int, str | None], str | None], hours: float = 24, most: int = 3, late: str = "0 seconds") -> DataFrame:
    """stream: path_key, version (long), text, seen (timestamp). ATTEMPT rows of documents that aren't current, once a version, and of
    failures that are tried again after hours of the stream's time, most times in all. late: how far behind seen may come.

    The session's state store must be RocksDB's (PROVIDER = ROCKS) when the stream starts.
    """
    rows = stream.select("path_key", "version", "text", "seen").where("path_key IS NOT NULL AND version IS NOT NULL AND seen IS NOT NULL").withWatermark("seen", late)
    return rows.groupBy("path_key").transformWithStateInPandas(Attempts(work, hours, most), ATTEMPT, "Append", "EventTime")
