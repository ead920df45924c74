"""Rules over streams of requests: gates at each request's own time, and a cooldown with state and timers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siftwork.functions import clock


def gate_stream(requests: DataFrame, sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Adds gate_user and gate to streamed requests (session_id, at): the session must be live at the request's own time.

    The tables are static sides of the join, read again for each batch; a stream needs no state for it.
    """
    held = sessions.select(F.col("id").alias("session_id"), F.col("user_id").alias("gate_user"), "revoked", "expires_at")
    known = users.select(F.col("id").alias("gate_user"), F.col("is_active").alias("gate_active"), F.lit(True).alias("gate_found"))
    rows = requests.join(held, "session_id", "left").join(known, "gate_user", "left")
    live = clock.is_live(F.col("revoked"), F.col("expires_at"), F.col("at")) & F.coalesce("gate_found", F.lit(False))
    gate = F.when(~live, "unauthenticated").when(~F.coalesce("gate_active", F.lit(False)), "unverified").otherwise("active")
    return rows.select(*requests.columns, F.when(live, F.col("gate_user")).alias("gate_user"), gate.alias("gate"))


class Cooldown(StatefulProcessor):
    """The last issue of a key, and the requests that wait until no earlier one can come."""

    def __init__(self, minutes: int):
        self.interval = timedelta(minutes=minutes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp")
        self.waiting = handle.getListState("waiting", "request_id long, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for request_id, at in zip(batch["request_id"].tolist(), batch["at"].tolist(), strict=True):
                self.waiting.appendValue((request_id, at.to_pydatetime()))
                self.handle.registerTimer(int(at.timestamp() * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms", tz="UTC")
        held = [(r[0], r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
        utc = lambda t: pd.Timestamp(t).tz_localize("UTC") if pd.Timestamp(t).tzinfo is None else pd.Timestamp(t).tz_convert("UTC")
        ready = sorted(((utc(t), i, t) for i, t in held if utc(t) <= due), key=lambda x: x[:2])
        if not ready:
            return
        left = [(i, t) for i, t in held if utc(t) > due]
        self.waiting.clear()
        if left:
            self.waiting.put(left)
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for at, request_id, given in ready:
            limited = last is not None and at < utc(last) + self.interval
            out.append((key[0], request_id, at.tz_localize(None), limited, None if last is None else utc(last).tz_localize(None)))
            if not limited:
                last = given
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "request_id", "at", "limited", "last_issue"])

    def close(self) -> None:
        pass


def cooldown_stream(requests: DataFrame, minutes: int, late: str) -> DataFrame:
    """user_id, request_id, at, limited, last_issue for streamed requests (user_id, request_id, at as a timestamp with zone).

    The answers are those of timeline.cooled(): a request is decided once the watermark, `late` behind the newest one, has passed it, so
    that of requests out of order the earlier comes first. What comes later than that is dropped, as streams do. State is the last
    issue of each user and what waits; after a restart both come from the checkpoint. Needs the RocksDB state store.
    """
    return (
        requests.withWatermark("at", late)
        .groupBy("user_id")
        .transformWithStateInPandas(Cooldown(minutes), "user_id long, request_id long, at timestamp, limited boolean, last_issue timestamp", "Append", "EventTime")
    )
