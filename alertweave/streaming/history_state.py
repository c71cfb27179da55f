"""Recent events of an actor for a stream of alerts, both sides out of order, as keyed state in Spark's state store.

Alerts and events of one name meet in its state. An alert is answered when it comes, with the newest events that are known, and again
whenever a later row changes the answer; the newest answer of an alert counts. Once the watermark has passed an alert, its answer
stands. Of the events that the watermark has passed, only the newest ``n`` inside the look-back can be part of an answer to come, so
no more are kept: the state of a name is bounded by ``n`` and by what falls into the allowed delay.

Names are dealt to ``BUCKETS`` by their hash, and the names of a bucket are one entry of the state store: a call of the state function
costs far more than the few rows of a name, so calls are bounded by the buckets and not by the names.

As in ``cache_state`` the watermark is put ahead, so that late rows are reported and not dropped: a late event is listed and
answers nothing, a late alert is answered with what is known.
"""

from __future__ import annotations

import bisect
import sys
import zlib

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.streaming.cache_state import GRACE_SECONDS

# The functions below travel to the executors with their helpers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: ``kind`` is answer, late_answer (an alert that came too late to wait for events) or late_event.
ANSWER = "username string, kind string, id string, at bigint, event_ids array<string>, event_ats array<bigint>"
#: Of each name in ``names`` how many of the events (``ev_``) and of the waiting alerts (``al_``) are its own, in that order.
STATE = (
    "names array<string>, n_ev array<bigint>, n_al array<bigint>, ev_at array<bigint>, ev_id array<string>,"
    " al_id array<string>, al_at array<bigint>, al_sum array<bigint>"
)
BUCKETS = 4096


def newest(events: list[tuple[int, str]], at: int, lookback: int, n: int) -> list[tuple[int, str]]:
    """Of sorted events the newest ``n`` at or before a moment and inside the look-back, newest first."""
    stop = bisect.bisect_right(events, at, key=lambda e: e[0])
    start = bisect.bisect_left(events, at - lookback, hi=stop, key=lambda e: e[0])
    return events[max(start, stop - n) : stop][::-1]


def settle(events, waiting: dict, new_events, new_alerts, mark: int, lookback: int, n: int):
    """One step of a name: its next events and waiting alerts (``id -> (at, checksum of the last answer)``), and the rows to report."""
    rows = [("late_event", i, at, []) for at, i in new_events if at < mark]
    events = sorted({*events, *((at, i) for at, i in new_events if at >= mark)})
    waiting = dict(waiting)
    for at, i in new_alerts:
        if i not in waiting:
            if at < mark:
                rows.append(("late_answer", i, at, newest(events, at, lookback, n)))
            else:
                waiting[i] = (at, -1)
    left = {}
    for i, (at, was) in waiting.items():
        found = newest(events, at, lookback, n)
        now = zlib.crc32(repr(found).encode())
        if now != was:
            rows.append(("answer", i, at, found))
        if at >= mark:
            left[i] = (at, now)
    passed = bisect.bisect_left(events, mark, key=lambda e: e[0])
    kept = [e for e in events[max(0, passed - n) : passed] if e[0] >= mark - lookback]
    return kept + events[passed:], left, rows


def unpacked(held) -> dict[str, tuple[list, dict]]:
    """The events and waiting alerts of each name of a state."""
    names, n_ev, n_al, ev_at, ev_id, al_id, al_at, al_sum = held
    events, alerts = list(zip(ev_at, ev_id)), list(zip(al_id, zip(al_at, al_sum)))
    found, e, a = {}, 0, 0
    for name, ne, na in zip(names, n_ev, n_al):
        found[name] = (events[e : e + ne], dict(alerts[a : a + na]))
        e, a = e + ne, a + na
    return found


def packed(names: dict[str, tuple[list, dict]]) -> tuple:
    events = [e for held, _ in names.values() for e in held]
    alerts = [(i, at, was) for _, waiting in names.values() for i, (at, was) in waiting.items()]
    return (
        list(names), [len(held) for held, _ in names.values()], [len(waiting) for _, waiting in names.values()],
        [at for at, _ in events], [i for _, i in events], [i for i, _, _ in alerts], [at for _, at, _ in alerts], [s for _, _, s in alerts],
    )


def due(held: list, waiting: dict, lookback: int) -> int | None:
    """When a name is to be looked at again: at its first waiting alert, or else when its last event is out of reach."""
    if waiting:
        return min(at for at, _ in waiting.values())
    return held[-1][0] + lookback if held else None


def _step(lookback: int, n: int):
    def run(key, frames, state):
        import pandas as pd

        never = -(2**62)
        names = unpacked(state.get) if state.exists else {}
        arrived: dict[str, tuple[list, list]] = {}
        if not state.hasTimedOut:
            for frame in frames:
                columns = (frame[c].tolist() for c in ("username", "is_event", "at", "id"))
                for name, kind, at, i in zip(*columns):
                    arrived.setdefault(name, ([], []))[0 if kind else 1].append((at, i))
        mark_ms = state.getCurrentWatermarkMs()
        mark = mark_ms * 1000 if mark_ms > 0 else never
        reported = []
        timer = None
        for name in [*names, *(a for a in arrived if a not in names)]:
            held, waiting = names.get(name, ([], {}))
            next_ = due(held, waiting, lookback)
            if name in arrived or next_ is None or next_ < mark:
                held, waiting, rows = settle(held, waiting, *arrived.get(name, ((), ())), mark, lookback, n)
                reported += [(name, *r) for r in rows]
                names[name] = (held, waiting)
                next_ = due(held, waiting, lookback)
            if next_ is None:
                del names[name]
            else:
                timer = next_ if timer is None else min(timer, next_)
        if timer is None:
            state.remove()
        else:
            state.update(packed(names))
            state.setTimeoutTimestamp(max(timer // 1000, mark_ms) + 1)
        if reported:
            yield pd.DataFrame(
                {
                    "username": [r[0] for r in reported],
                    "kind": [r[1] for r in reported],
                    "id": [r[2] for r in reported],
                    "at": [r[3] for r in reported],
                    "event_ids": [[i for _, i in r[4]] for r in reported],
                    "event_ats": [[a for a, _ in r[4]] for r in reported],
                }
            )

    return run


def answers(alerts: DataFrame, events: DataFrame, lookback_micros: int, n: int, delay_seconds: int) -> DataFrame:
    """A stream of answers from streams of alerts (``username, at, id``) and events (``username, at, id``), ``at`` in microseconds."""
    if lookback_micros <= 0 or n <= 0 or delay_seconds < 0:
        raise ValueError("the look-back and the number of results must be positive and the delay not negative")

    def side(df: DataFrame, is_event: bool) -> DataFrame:
        known = df.filter(F.col("username").isNotNull() & F.col("at").isNotNull() & F.col("id").isNotNull())
        rows = known.select("username", F.lit(is_event).alias("is_event"), "at", "id")
        ahead = F.timestamp_micros(F.col("at") + GRACE_SECONDS * 1000000)
        return rows.withColumn("ahead", ahead).withWatermark("ahead", f"{GRACE_SECONDS + delay_seconds} seconds")

    both = side(alerts, False).unionByName(side(events, True))
    bucket = F.pmod(F.xxhash64("username"), F.lit(BUCKETS))
    return both.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(_step(lookback_micros, n), ANSWER, STATE, "update", "EventTimeTimeout")
