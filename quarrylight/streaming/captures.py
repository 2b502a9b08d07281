"""Captures with state: endpoints with their first URLs as flows arrive, and sessions that end by duration or silence.

State lives in Spark's store by key and is restored from the checkpoint, so a restarted query goes on where it was. A key's
state is bounded: counts, and the first `most_urls` distinct URLs in order. Sessions end by event-time timers, so what is in one
does not depend on how flows are dealt to micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrylight.functions.text import url_host, url_pattern
from quarrylight.session import for_workers

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ENDPOINT = "pattern string, method string, host string, flow_count long, urls array<string>"
SESSION = "session_id string, started timestamp, ended timestamp, flow_count long, request_bytes long, response_bytes long, reason string"


def _stored(stream: DataFrame) -> DataFrame:
    """These operators need a state store that keeps several columns and timers."""
    spark = for_workers(stream.sparkSession)
    if spark.conf.get(STORE[0]) != STORE[1]:
        spark.conf.set(*STORE)
    return stream


class Endpoints(StatefulProcessor):
    """Of each pattern, method and host: how many flows, and its first distinct URLs in order."""

    def __init__(self, most_urls: int):
        self.most_urls = most_urls

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.urls = handle.getValueState("urls", "urls array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        urls = set(self.urls.get()[0]) if self.urls.exists() else set()
        for some in rows:
            n += len(some)
            urls = set(sorted(urls.union(some["url"]))[: self.most_urls])
        kept = sorted(urls)
        self.count.update((n,))
        self.urls.update((kept,))
        yield pd.DataFrame({"pattern": [key[0]], "method": [key[1]], "host": [key[2]], "flow_count": [n], "urls": [kept]})

    def close(self) -> None:
        pass


def endpoint_updates(flows: DataFrame, most_urls: int = 50) -> DataFrame:
    """For each micro-batch the endpoints that it touches, as netflow.endpoints would give them for all flows so far; write it in update
    mode, for example by flows.upsert_latest. A null method or host is a key of its own; flows have a url."""
    named = _stored(flows).select(
        url_pattern(F.col("url")).alias("pattern"), F.col("method").cast("string").alias("method"), url_host(F.col("url")).alias("host"), "url"
    )
    return named.groupBy("pattern", "method", "host").transformWithStateInPandas(
        Endpoints(most_urls), outputStructType=ENDPOINT, outputMode="Update", timeMode="None"
    )


class Sessions(StatefulProcessor):
    """One session at a time for each id. A flow at or behind its end opens the next one."""

    def __init__(self, longest_ms: int, silence_ms: int):
        self.longest_ms, self.silence_ms = longest_ms, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # flows that are not counted yet: those of a later session may come before the timer that ends the present one
        self.flows = handle.getListState("flows", "ms long, sent long, got long")
        self.open = handle.getValueState("open", "started long, last long, n long, sent long, got long, due long")

    def _due(self, started: int, last: int) -> int:
        return min(started + self.longest_ms, last + self.silence_ms)

    def _fold(self, key: str, until: int) -> list[tuple]:
        """Counts the flows before `until` in the order of their times; returns the sessions that ended by then."""
        done, later = [], []
        now = list(self.open.get()) if self.open.exists() else None
        for ms, sent, got in sorted(tuple(f) for f in self.flows.get()):
            if ms >= until:
                later.append((ms, sent, got))
                continue
            if now and ms >= now[5]:
                done.append(self._closed(key, now))
                now = None
            if now is None:
                now = [ms, ms, 0, 0, 0, 0]
            now[1], now[2], now[3], now[4] = ms, now[2] + 1, now[3] + sent, now[4] + got
            now[5] = self._due(now[0], ms)
        if now and now[5] <= until:
            done.append(self._closed(key, now))
            now = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now:
            self.open.update(tuple(now))
        elif self.open.exists():
            self.open.clear()
        self.flows.put(later) if later else self.flows.clear()
        due = min([now[5]] if now else [f[0] + 1 for f in later], default=None)
        if due is not None:
            self.handle.registerTimer(max(due, until + 1))
        return done

    def _closed(self, key: str, now: list[int]) -> tuple:
        reason = "duration" if now[0] + self.longest_ms <= now[1] + self.silence_ms else "silence"
        return key, pd.Timestamp(now[0], unit="ms"), pd.Timestamp(now[5], unit="ms"), now[2], now[3], now[4], reason

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            ms = some["ts"].astype("datetime64[ms]").astype("int64")
            self.flows.appendList(list(zip(ms.tolist(), some["sent"].astype("int64").tolist(), some["got"].astype("int64").tolist())))
        yield self._frame(self._fold(key[0], max(timerValues.getCurrentWatermarkInMs(), 0)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._fold(key[0], max(timerValues.getCurrentWatermarkInMs(), 0)))

    def _frame(self, done: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(done, columns=[c.split()[0] for c in SESSION.split(", ")])

    def close(self) -> None:
        pass


def sessions(flows: DataFrame, duration: str = "10 minutes", silence: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """A row of SESSION for each capture session that is over: flows (session_id, ts, request_size, response_size) of one id, from
    the first one on until `duration` has passed or nothing came for `silence`; then the next flow opens another session.

    A session is given out once the watermark (the latest time less `delay`) has passed its end; later flows are late and left out. So
    a capture is bounded in time, and its state is open sessions and flows within the delay. Rows without id or time are left out.
    """
    watched = _stored(flows).where("session_id is not null and ts is not null").withWatermark("ts", delay).select(
        "session_id", "ts", F.coalesce("request_size", F.lit(0)).cast("long").alias("sent"), F.coalesce("response_size", F.lit(0)).cast("long").alias("got")
    )
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    return watched.groupBy("session_id").transformWithStateInPandas(
        Sessions(ms(duration), ms(silence)), outputStructType=SESSION, outputMode="Append", timeMode="EventTime"
    )
