"""What a watcher of a plan is sent, with processing-time timers.

A key's events are passed on as they come: a plan's state if it differs from what was sent last, a result always, tools' events
always, an analysis once for each of its keys. If nothing comes for ``idle`` seconds, the last plan is sent once more as waiting
(once, until something else is sent). After a result only every ``poll`` seconds is looked whether ``tail`` seconds have passed
since the result; events within that time still count, and at the first idle look after it the watch is closed: later events are
not sent. ``watch`` is the whole rule, with the clock as an argument; the processor only feeds it events and timers.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions import arrow  # noqa: F401 (functions go to executors by value)
from tessera.streaming.fold import ROCKS

IDLE, POLL, TAIL = 60.0, 5.0, 180.0
START: dict = {"plan": None, "sent": None, "done": None, "keys": [], "closed": False, "due": None}


def watch(state: dict, now: float, event: dict | None, idle: float = IDLE, poll: float = POLL, tail: float = TAIL) -> list[tuple[str, str | None]]:
    """What is sent at ``now`` for an event (kind plan, result, tool or analysis, with payload), or for a timer (None), as
    (kind, payload); sets ``due``, the time of the next timer (None: no more)."""
    out: list[tuple[str, str | None]] = []

    def send_new(kind: str) -> None:
        mark = hashlib.md5(json.dumps([kind, state["plan"]]).encode()).hexdigest()
        if mark != state["sent"]:
            state["sent"] = mark
            out.append((kind, state["plan"]))

    if state["closed"]:
        return out
    if event is None:
        if state["done"] is None:
            send_new("waiting")
        elif now - state["done"] >= tail:
            state["closed"] = True
            out.append(("closed", None))
    elif event["kind"] == "tool":
        out.append(("tool", event["payload"]))
    elif event["kind"] == "analysis":
        if event["payload"] not in state["keys"]:
            state["keys"].append(event["payload"])
            out.append(("analysis", event["payload"]))
    elif event["kind"] == "result":
        state["plan"] = event["payload"]
        state["done"] = now if state["done"] is None else state["done"]
        out.append(("result", event["payload"]))
    else:
        state["plan"] = event["payload"]
        send_new("plan")
    state["due"] = None if state["closed"] else now + (idle if state["done"] is None else poll)
    return out


class _Watch(StatefulProcessor):
    def __init__(self, key: str, times: tuple[float, float, float]):
        self.key, self.times = key, times

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField("json", StringType())]))

    def _state(self) -> dict:
        return json.loads(self.held.get()[0]) if self.held.exists() else json.loads(json.dumps(START))

    def _after(self, key: object, state: dict, rows: list[tuple]) -> pd.DataFrame:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state["due"] is not None:
            self.handle.registerTimer(int(state["due"] * 1000))
        self.held.update((json.dumps(state),))
        return pd.DataFrame([(key[0], *r) for r in rows], columns=[self.key, "kind", "payload"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        state, now, out = self._state(), time.time(), []
        for pdf in rows:
            for e in pdf.sort_values("seq").to_dict("records"):
                out += watch(state, now, e, *self.times)
        yield self._after(key, state, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        state = self._state()
        yield self._after(key, state, watch(state, time.time(), None, *self.times))

    def close(self) -> None:
        pass


def watched(events: DataFrame, key: str, idle: float = IDLE, poll: float = POLL, tail: float = TAIL) -> DataFrame:
    """(key, kind, payload) of a stream of events (key, seq, kind, payload)."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = StructType([StructField(key, events.schema[key].dataType), StructField("kind", StringType()), StructField("payload", StringType())])
    x = events.select(key, "seq", "kind", "payload")
    return x.groupBy(key).transformWithStateInPandas(_Watch(key, (idle, poll, tail)), out, "Append", "ProcessingTime")
