"""Incremental reads of a search source by event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def start_checkpoint(now: Column, backfill_minutes: int) -> Column:
    """Where the very first poll starts."""
    return now - F.make_dt_interval(mins=F.lit(backfill_minutes))


def event_time(row: str = "row") -> Column:
    """The time a search result gives itself (``_time`` of its JSON text); NULL where it has none that can be read.

    Polls that advance on event time add it to the rows before they are normalised, or read it stored as a column.
    """
    return F.get_json_object(row, "$._time").try_cast("timestamp")


def poll(rows: DataFrame, time_column: str, checkpoint: Column, now: Column) -> DataFrame:
    """Rows from the checkpoint to ``now``, both ends included."""
    return rows.filter(F.col(time_column).between(checkpoint, now))


def next_checkpoint(polled: DataFrame, time_column: str, checkpoint: Column) -> DataFrame:
    """One row: the latest time seen, or the old checkpoint when the poll was empty."""
    return polled.agg(F.max(time_column).alias("_latest")).select(F.coalesce("_latest", checkpoint).alias("checkpoint"))


def drop_boundary_repeats(polled: DataFrame, earlier: DataFrame, time_column: str, checkpoint: Column) -> DataFrame:
    """Leave out rows at the checkpoint that the poll before has delivered.

    Only rows at the boundary instant can repeat, so only they are compared.
    """
    seen = earlier.filter(F.col(time_column) == checkpoint).select("alert_id").distinct()
    return polled.join(seen, "alert_id", "left_anti")
