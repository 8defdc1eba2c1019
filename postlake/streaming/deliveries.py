"""Delivery of messages as keyed state over a stream of events, with timers for leases and retries."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from postlake.operators.delivery import DELAYS, FAILURES, LEASE

#: What the stream returns: a row an event that took effect, and one (kind ``due``) where a lease or a pause ran out.
CHANGES = "message_id long, event_id long, at timestamp, kind string, status string, attempt int, retry_at timestamp, lease_until timestamp"
STATE = "status string, attempt int, retry_at timestamp, lease_until timestamp, last_at timestamp, last_event long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(state: dict, kind: str, at: datetime.datetime) -> dict | None:
    """The state of a message after an event; None where the event has no effect. A message that is not there has status None.

    plan queues a new message. claim takes one that is queued, due again, or past its lease. sent, release and a
    failure (``fail:auth``, ``fail:retryable``, ``fail:permanent``) end a claim. retry makes a message that ended in failure due. clear removes one
    that was never sent.
    """
    minutes = lambda n: at + datetime.timedelta(minutes=n)
    status, attempt = state["status"], state["attempt"]
    rest = {"retry_at": None, "lease_until": None}
    if kind == "plan":
        return {"status": "queued", "attempt": 0, **rest} if status is None else None
    if kind == "clear":
        return {"status": None, "attempt": 0, **rest} if status not in (None, "sent") else None
    if kind == "claim":
        due = {"queued": True, "retryable": state["retry_at"] and state["retry_at"] <= at, "sending": state["lease_until"] and state["lease_until"] <= at}
        return {"status": "sending", "attempt": attempt + 1, "retry_at": state["retry_at"], "lease_until": minutes(LEASE)} if due.get(status) else None
    if kind == "retry":
        return {**state, "status": "retryable", "retry_at": at} if status in ("auth_blocked", "failed") else None
    if status != "sending":
        return None
    if kind == "sent":
        return {"status": "sent", "attempt": attempt, **rest}
    if kind == "release":
        return {"status": "queued", "attempt": max(0, attempt - 1), "retry_at": at, "lease_until": None}
    failure = kind.removeprefix("fail:")
    again = minutes(DELAYS[max(0, min(attempt, len(DELAYS)) - 1)]) if failure == "retryable" else None
    return {"status": FAILURES[failure], "attempt": attempt, "retry_at": again, "lease_until": None}


def _plain(t):
    return None if t is None or pd.isna(t) else pd.Timestamp(t).to_pydatetime().replace(tzinfo=None)


class Deliveries(StatefulProcessor):
    """One message a key. Events not later than the last one seen, by (at, event_id), are repeats and change nothing."""

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("message", STATE)

    def _timer(self, state: dict) -> datetime.datetime | None:
        return {"retryable": state["retry_at"], "sending": state["lease_until"]}.get(state["status"])

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get()
        state = {"status": None, "attempt": 0, "retry_at": None, "lease_until": None}
        last = None
        if held is not None:
            state = {"status": held[0], "attempt": held[1], "retry_at": _plain(held[2]), "lease_until": _plain(held[3])}
            last = (_plain(held[4]), held[5])
        before, out = self._timer(state), []
        # lists, not frames: a key has few rows, and a frame's fixed cost a key would be most of its time
        events = sorted((e for frame in rows for e in zip(_times(frame["at"]), frame["event_id"].tolist(), frame["kind"].tolist())), key=lambda e: e[:2])
        for at, event_id, kind in events:
            mark = (at, int(event_id))
            if last is not None and mark <= last:
                continue
            last = mark
            changed = step(state, kind, mark[0])
            if changed is not None:
                state = changed
                out.append((key[0], mark[1], mark[0], kind, *state.values()))
        if last is not None:
            self.state.update((*state.values(), *last))
        after = self._timer(state)
        if before != after:
            for t, change in ((before, self.handle.deleteTimer), (after, self.handle.registerTimer)):
                if t is not None:
                    change(int(t.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000))
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.state.get()
        state = {"status": held[0], "attempt": held[1], "retry_at": _plain(held[2]), "lease_until": _plain(held[3])}
        yield _frame([(key[0], None, self._timer(state), "due", *state.values())])

    def close(self):
        pass


def _times(c: pd.Series) -> list:
    """Plain datetimes of a column, as the session's zone shows them; None for nulls."""
    return (c if c.dt.tz is None else c.dt.tz_localize(None)).to_numpy().astype("datetime64[us]").tolist()


KINDS = {"long": np.int64, "int": np.int32, "timestamp": "datetime64[us]", "string": object}


def _frame(rows) -> pd.DataFrame:
    made = {}
    for values, field in zip(zip(*rows), CHANGES.split(", ")):
        name, kind = field.split()
        made[name] = pd.array(values, dtype="Int64") if name == "event_id" else np.array(values, dtype=KINDS[kind])
    return pd.DataFrame(made, copy=False)


def deliveries(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The changes that a stream of events(message_id, event_id, at, kind) makes. How late an event may come is the watermark's delay.

    State is one row a message, on the executors; the session's time zone must be UTC, as timers count from the epoch.
    """
    return events.withWatermark("at", late).groupBy("message_id").transformWithStateInPandas(Deliveries(), CHANGES, "Append", "EventTime")


def start(events: DataFrame, path: str, checkpoint: str, late: str = "10 minutes") -> StreamingQuery:
    """Write the changes of all events that are there to path. A batch that runs again writes its rows once, by the sink's log."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return deliveries(events, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
