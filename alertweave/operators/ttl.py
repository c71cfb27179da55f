"""Replay of a time-to-live cache over a table of look-ups.

A look-up is a hit while an entry of its key is alive. A miss whose look-up succeeded opens a new entry with a
fixed life; hits do not extend it, and failed look-ups open none. The look-ups that open an entry are called
anchors here. Every anchor depends on the one before it, so no window frame can express the rule; but

* only the first successful look-up of an instant can be an anchor, so rows are cut to one per ``(key, instant)``
  in map-side partials before anything is ordered;
* two anchors of a key are at least one life apart, so a time slot as long as a life holds at most one. Once the
  anchors are known, every row finds its state by an equi-join on ``(key, slot)``;
* a key with very many instants is cut at multiples of a life into chunks of about ``ROWS_PER_CHUNK`` instants. Inside a chunk
  it does not matter what happened before, except for when the entry that comes in expires, and that is less than one
  life after the chunk begins. So each chunk is first reduced, in parallel, to a short table "first instant used ->
  end of the last entry" by pointer doubling, the tables are chained per key, and then each chunk is replayed, again in
  parallel, from its known start. Keys with fewer instants are replayed at once.

A task holds at most a chunk and the instants of one more life.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The Arrow functions below travel to the executors with their helpers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_CHUNK = 1 << 18


def _groups(batch) -> list:
    """``(label, start, stop)`` of each run of equal key and chunk in an Arrow batch."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    key, chunk = batch.column("key"), batch.column("chunk").to_numpy()
    other_key = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    change = np.flatnonzero(other_key | (chunk[1:] != chunk[:-1])) + 1
    edges = [0, *change.tolist(), n]
    return [((key[a].as_py(), int(chunk[a])), a, b) for a, b in zip(edges[:-1], edges[1:])]


def _by_group(batches: Iterator, columns: list[str]) -> Iterator:
    """Whole ``(key, chunk)`` groups as arrays, from Arrow batches sorted by key and chunk."""
    import numpy as np

    held: list = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data = [batch.column(c).to_numpy() for c in columns]
        for label, start, stop in _groups(batch):
            part = [d[start:stop] for d in data]
            if held and held[0] != label:
                yield held[0], [np.concatenate(c) for c in zip(*held[1])]
                held = []
            if held:
                held[1].append(part)
            else:
                held = [label, [part]]
    if held:
        yield held[0], [np.concatenate(c) for c in zip(*held[1])]


def _emit(rows: list, names: list[str], types: list):
    import pyarrow as pa

    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _chunk_tables(life: int):
    """Per chunk: for every group of entry instants with the same outcome, the latest of them and the outcome."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, types = ["key", "chunk", "entry", "expires"], [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        out: list = []
        for (key, chunk), (at, begins) in _by_group(batches, ["at", "begins"]):
            n = len(at)
            follow = np.searchsorted(at, at + life, side="left")
            last = np.where(follow < n, follow, np.arange(n))
            while True:
                further = last[last]
                if np.array_equal(further, last):
                    break
                last = further
            expires = at[last] + life
            entries = min(n, int(np.searchsorted(at, begins[0] + life, side="left")) + 1)
            keep = np.append(expires[1:entries] != expires[: entries - 1], True)
            out.extend((key, chunk, int(a), int(e)) for a, e in zip(at[:entries][keep], expires[:entries][keep]))
            if len(out) >= 10000:
                yield _emit(out, names, types)
                out = []
        yield _emit(out, names, types)

    return run


def _chain_chunks():
    """Per key, in time order: when the entry coming into each chunk expires."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, types = ["key", "chunk", "incoming"], [pa.string(), pa.int64(), pa.int64()]
        out: list = []
        current, incoming = None, None
        for (key, chunk), (entry, expires) in _by_group(batches, ["entry", "expires"]):
            if key != current:
                current, incoming = key, -(2**62)
            out.append((key, chunk, incoming))
            used = int(np.searchsorted(entry, incoming, side="left"))
            if used < len(entry):
                incoming = int(expires[used])
            if len(out) >= 10000:
                yield _emit(out, names, types)
                out = []
        yield _emit(out, names, types)

    return run


def _replay_chunks(life: int):
    """Anchors of each chunk, starting from the known incoming entry. Nothing but the expiry is kept."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        current, expires = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            at = batch.column("at").to_numpy()
            incoming = batch.column("incoming").to_numpy()
            picked: list[int] = []
            for label, start, stop in _groups(batch):
                if label != current:
                    current, expires = label, int(incoming[start])
                position = start + int(np.searchsorted(at[start:stop], expires, side="left"))
                while position < stop:
                    picked.append(position)
                    expires = int(at[position]) + life
                    position += int(np.searchsorted(at[position:stop], expires, side="left"))
            chosen = pa.array(picked, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(chosen) for c in ("key", "at", "anchor_id")], ["key", "at", "anchor_id"]
            )

    return run


def anchors(lookups: DataFrame, ttl_micros: int, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Look-ups that open an entry: ``key, at, anchor_id``.

    ``lookups`` has ``key string, at bigint`` (microseconds), ``lookup_id`` and ``lookup_ok``.
    """
    if ttl_micros <= 0:
        raise ValueError("the time to live must be positive")
    id_type = lookups.schema["lookup_id"].dataType.simpleString()
    instants = (
        lookups.filter(F.col("lookup_ok") & F.col("key").isNotNull() & F.col("at").isNotNull())
        .groupBy("key", "at")
        .agg(F.min("lookup_id").alias("anchor_id"))
        .withColumn("slot", F.floor(F.col("at") / F.lit(ttl_micros)).cast("bigint"))
    )
    # The uses below read all columns, so they share the aggregation.
    instants = instants.select("key", F.inline(F.array(F.struct("slot", "at", "anchor_id"))))
    placed = instants.join(_chunks(instants, ttl_micros, rows_per_chunk), ["key", "slot"], "left")
    placed = placed.select("key", F.coalesce("chunk", F.lit(0).cast("bigint")).alias("chunk"), "at", "anchor_id", "begins")
    tables = (
        placed.filter("begins IS NOT NULL")
        .select("key", "chunk", "at", "begins")
        .repartition("key", "chunk")
        .sortWithinPartitions("key", "chunk", "at")
        .mapInArrow(_chunk_tables(ttl_micros), "key string, chunk bigint, entry bigint, expires bigint")
    )
    starts = (
        tables.repartition("key")
        .sortWithinPartitions("key", "chunk", "entry")
        .mapInArrow(_chain_chunks(), "key string, chunk bigint, incoming bigint")
    )
    return (
        placed.join(starts, ["key", "chunk"], "left")
        .select("key", "chunk", "at", "anchor_id", F.coalesce("incoming", F.lit(-(2**62))).alias("incoming"))
        .repartition("key", "chunk")
        .sortWithinPartitions("key", "chunk", "at")
        .mapInArrow(_replay_chunks(ttl_micros), f"key string, at bigint, anchor_id {id_type}")
    )


def _chunks(instants: DataFrame, ttl_micros: int, rows_per_chunk: int) -> DataFrame:
    """``key, slot, chunk, begins`` of the keys with more instants than a chunk holds; few keys have so many.

    A slot is as long as a life. Chunks end with a slot, so one that holds very many instants is a chunk with little else.
    """
    counts = instants.groupBy("key", "slot").agg(F.count(F.lit(1)).alias("n"))
    large = counts.groupBy("key").agg(F.sum("n").alias("_all")).filter(F.col("_all") > rows_per_chunk).select("key")
    before = F.sum("n").over(Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    chunked = counts.join(large, "key").select(
        "key", "slot", F.floor(F.coalesce(before, F.lit(0)) / rows_per_chunk).cast("bigint").alias("chunk")
    )
    begins = F.min("slot").over(Window.partitionBy("key", "chunk")) * ttl_micros
    return chunked.select("key", "slot", "chunk", begins.alias("begins"))


def replay(lookups: DataFrame, ttl_micros: int, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Every look-up with ``hit`` and the anchor that serves it (its own id for a miss).

    Look-ups of one instant are taken in the order of their ids.
    """
    return served(lookups, anchors(lookups, ttl_micros, rows_per_chunk), ttl_micros)


def served(lookups: DataFrame, opened: DataFrame, ttl_micros: int) -> DataFrame:
    """Look-ups with ``hit`` and ``served_by``, given the anchors of their keys."""
    slot = F.floor(F.col("at") / F.lit(ttl_micros)).cast("bigint")
    opened = opened.select("key", slot.alias("slot"), F.struct("at", "anchor_id").alias("anchor"))
    # An entry may serve rows of its own slot and of the next one.
    reach = (
        opened.select("key", "anchor", F.explode(F.array(F.lit(0), F.lit(1))).alias("later"), "slot")
        .groupBy("key", (F.col("slot") + F.col("later")).alias("slot"))
        .agg(
            F.max(F.when(F.col("later") == 0, F.col("anchor"))).alias("own"),
            F.max(F.when(F.col("later") == 1, F.col("anchor"))).alias("earlier"),
        )
    )
    rows = lookups.withColumn("slot", slot).join(reach, ["key", "slot"], "left")

    def serves(anchor: str):
        a = F.col(anchor)
        after = (a["at"] < F.col("at")) | ((a["at"] == F.col("at")) & (a["anchor_id"] < F.col("lookup_id")))
        return F.coalesce(after & (F.col("at") < a["at"] + ttl_micros), F.lit(False))

    by = F.when(serves("own"), F.col("own.anchor_id")).when(serves("earlier"), F.col("earlier.anchor_id"))
    return rows.select(
        *lookups.columns, by.isNotNull().alias("hit"), F.coalesce(by, F.col("lookup_id")).alias("served_by")
    )
