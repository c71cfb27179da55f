"""Cache replay as keyed state in Spark's state store.

The state of a key is the end of its last settled entry and the instants that may still be overtaken. A row settles once the
watermark, the newest time seen less the allowed delay, has passed it. Spark drops rows behind its watermark unseen; here
the event time given to it lies ``GRACE`` ahead and the delay is as much longer, so that the watermark comes out the same and late
rows reach the state function, which reports them.

Each key is due at the first instant that waits, or else at the end of its entry, after which its state goes. Keys are dealt to
``BUCKETS`` by their hash, and the keys of a bucket are one entry of the state store with one timer: a call of the state function costs
far more than the few instants of a key, so calls are bounded by the buckets and not by the keys.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The functions below travel to the executors with their helpers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: ``state`` is open (a look-up opens an entry), overtaken (it did, but no longer does) or late (it came too late to open one).
OPENING = "key string, at bigint, anchor_id string, state string"
#: Of each key in ``keys`` how many of the waiting instants and of the open entries are its own, in that order.
STATE = (
    "keys array<string>, ends array<bigint>, n_at array<bigint>, n_open array<bigint>, at array<bigint>, ids array<string>,"
    " open_at array<bigint>, open_ids array<string>"
)
BUCKETS = 4096
GRACE_SECONDS = 100 * 365 * 86400


def _first_of_instant(batches: Iterator) -> Iterator:
    """One row for each key and instant of an Arrow batch, that of the least id."""
    for batch in batches:
        if batch.num_rows:
            import pyarrow as pa

            least = pa.Table.from_batches([batch]).group_by(["key", "at"]).aggregate([("lookup_id", "min")])
            yield from least.rename_columns(["key", "at", "lookup_id"]).combine_chunks().to_batches()


def settle(held: tuple, arrived: dict, mark: int, life: int) -> tuple[tuple, list]:
    """One step of a key: its next state, and the rows to report.

    ``held`` is ``(ends, {instant: id}, {instant: id of the open entries among them})``, ``arrived`` the new instants and ``mark``
    the watermark. Instants before the mark are late; the rest is replayed from the end of the last settled entry.
    """
    ends, waiting, open_ = held
    rows = [(at, i, "late") for at, i in sorted(arrived.items()) if at < mark]
    waiting = dict(waiting)
    for at, i in arrived.items():
        if at >= mark:
            waiting[at] = min(i, waiting.get(at, i))
    opened, expires = {}, ends
    for at in sorted(waiting):
        if at >= expires:
            opened[at] = waiting[at]
            expires = at + life
    rows += [(at, i, "overtaken") for at, i in open_.items() if at not in opened]
    rows += [(at, i, "open") for at, i in opened.items() if open_.get(at) != i]
    settled = [at for at in opened if at < mark]
    ends = max([ends, *(at + life for at in settled)])
    later = {at: i for at, i in waiting.items() if at >= mark}
    return (ends, later, {at: i for at, i in opened.items() if at >= mark}), rows


def unpacked(held) -> dict[str, tuple]:
    """What ``settle`` holds of each key of a state."""
    keys, ends, n_at, n_open, at, ids, open_at, open_ids = held
    waiting, open_ = list(zip(at, ids)), list(zip(open_at, open_ids))
    found, w, o = {}, 0, 0
    for key, end, nw, no in zip(keys, ends, n_at, n_open):
        found[key] = (end, dict(waiting[w : w + nw]), dict(open_[o : o + no]))
        w, o = w + nw, o + no
    return found


def packed(keys: dict[str, tuple]) -> tuple:
    each = keys.values()
    waiting = [x for _, w, _ in each for x in w.items()]
    open_ = [x for _, _, o in each for x in o.items()]
    return (
        list(keys), [end for end, _, _ in each], [len(w) for _, w, _ in each], [len(o) for _, _, o in each],
        [at for at, _ in waiting], [i for _, i in waiting], [at for at, _ in open_], [i for _, i in open_],
    )


def due(held: tuple) -> int:
    """When a key is to be looked at again."""
    ends, waiting, _ = held
    return min(waiting) if waiting else ends


def _step(life: int):
    def run(key, frames, state):
        import pandas as pd

        never = -(2**62)
        keys = unpacked(state.get) if state.exists else {}
        arrived: dict[str, dict[int, str]] = {}
        if not state.hasTimedOut:
            for frame in frames:
                for name, moment, i in zip(*(frame[c].tolist() for c in ("key", "at", "lookup_id"))):
                    mine = arrived.setdefault(name, {})
                    mine[moment] = min(i, mine.get(moment, i))
        mark_ms = state.getCurrentWatermarkMs()
        mark = mark_ms * 1000 if mark_ms > 0 else never
        reported = []
        timer = None
        for name in [*keys, *(a for a in arrived if a not in keys)]:
            held = keys.get(name, (never, {}, {}))
            if name in arrived or due(held) < mark:
                held, rows = settle(held, arrived.get(name, {}), mark, life)
                reported += [(name, *r) for r in rows]
            if not held[1] and due(held) // 1000 < mark_ms:
                keys.pop(name, None)
            else:
                keys[name] = held
                timer = due(held) if timer is None else min(timer, due(held))
        if timer is None:
            state.remove()
        else:
            state.update(packed(keys))
            state.setTimeoutTimestamp(max(timer // 1000, mark_ms) + 1)
        if reported:
            names, moments, i, kinds = zip(*reported)
            yield pd.DataFrame({"key": names, "at": moments, "anchor_id": i, "state": kinds})

    return run


def openings(lookups: DataFrame, ttl_micros: int, delay_seconds: int) -> DataFrame:
    """A stream of changes to the entries of each key, from a stream of look-ups."""
    if ttl_micros <= 0 or delay_seconds < 0:
        raise ValueError("the time to live must be positive and the delay not negative")
    found = lookups.filter(F.col("lookup_ok") & F.col("key").isNotNull()).select("key", "at", "lookup_id")
    instants = found.mapInArrow(_first_of_instant, "key string, at bigint, lookup_id string")
    ahead = F.timestamp_micros(F.col("at") + GRACE_SECONDS * 1000000)
    timed = instants.withColumn("ahead", ahead).withWatermark("ahead", f"{GRACE_SECONDS + delay_seconds} seconds")
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS))
    return timed.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(_step(ttl_micros), OPENING, STATE, "update", "EventTimeTimeout")
