"""Queues as table partitions, and the dead-letter envelope."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave import settings as S
from alertweave.functions import payload as P

# Why an alert is a dead letter.
NO_ROUTE = "no_route_matched"
PUBLISH_FAILED = "publish_failed"

STORED_ALERT = ["alert_id", "source", "received_at", "raw_payload", "metadata"]


def earliest(rows: DataFrame) -> DataFrame:
    """One row for each ``alert_id``: the earliest copy, one without a time only where no copy has one.

    The order itself is never null, as ``min_by`` passes over rows without one. Copies of one instant are told apart by
    a hash of what they hold.
    """
    rest = [c for c in rows.columns if c != "alert_id"]
    hashed = [f.name for f in rows.schema if f.name in rest and not re.search(r"\b(?:map|variant)\b", f.dataType.simpleString())]
    order = F.struct(F.col("received_at").isNull(), F.col("received_at"), F.xxhash64(*hashed))
    return rows.groupBy("alert_id").agg(F.min_by(F.struct(*rest), order).alias("_first")).select("alert_id", "_first.*")


def write_queues(routed: DataFrame, path: str, mode: str = "append") -> None:
    """One pass over the input, one folder per queue; dead letters go to their own queue's folder."""
    rows = routed.select(
        *STORED_ALERT, "route", F.coalesce(F.col("queue"), F.lit(S.QUEUE_DLQ)).alias("queue")
    )
    rows.write.mode(mode).partitionBy("queue").parquet(path)


def missing_route_detail(raw_payload: Column) -> Column:
    """Names the top-level keys of the payload, in the order of the text."""
    keys = F.array_distinct(F.coalesce(F.json_object_keys(raw_payload), F.array().cast("array<string>")))
    return F.concat(
        F.lit("No matcher returned True for payload keys: ["),
        F.array_join(F.transform(keys, P.quoted), ", "),
        F.lit("]"),
    )


def dead_letters(unroutable: DataFrame, dlq_at: Column | None = None) -> DataFrame:
    """Unroutable alerts -> ``alert, dlq_reason, dlq_at, original_queue, error_detail``."""
    return unroutable.select(
        F.struct(*STORED_ALERT).alias("alert"),
        F.lit(NO_ROUTE).alias("dlq_reason"),
        (F.current_timestamp() if dlq_at is None else dlq_at).alias("dlq_at"),
        F.lit(S.QUEUE_ALERTS).alias("original_queue"),
        missing_route_detail(F.col("raw_payload")).alias("error_detail"),
    )
