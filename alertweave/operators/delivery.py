"""Outgoing events: envelopes, batches of lines, and what became of each batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave import settings as S
from alertweave.functions import payload as P
from alertweave.operators.numbering import positions


def alert_document(alert: Column) -> Column:
    """A stored alert as a struct that renders to its JSON form, payload and metadata as objects."""
    return F.struct(
        alert["alert_id"].alias("id"),
        alert["source"].alias("source"),
        P.iso_utc(alert["received_at"]).alias("received_at"),
        P.parse(alert["raw_payload"]).alias("raw_payload"),
        P.parse(alert["metadata"]).alias("metadata"),
    )


def enriched_document() -> Column:
    """The columns of an enriched row as one struct in wire form."""
    return F.struct(
        alert_document(F.col("alert")).alias("alert"),
        "runbook",
        P.iso_utc(F.col("enriched_at")).alias("enriched_at"),
        P.parse(F.col("extracted")).alias("extracted"),
        "runbook_error",
        "destination",
    )


def dlq_document() -> Column:
    return F.struct(
        alert_document(F.col("alert")).alias("alert"),
        "dlq_reason",
        P.iso_utc(F.col("dlq_at")).alias("dlq_at"),
        "original_queue",
        "error_detail",
    )


def _envelope(time: Column, source: Column, sourcetype: str, event: Column, s: S.Settings, index: bool) -> Column:
    fields = [
        time.alias("time"),
        F.lit(s.host).alias("host"),
        source.alias("source"),
        F.lit(sourcetype).alias("sourcetype"),
    ]
    if index:
        fields.append(F.lit(s.index).alias("index"))
    return F.struct(*fields, event.alias("event"))


def _enriched_source() -> Column:
    return F.coalesce(F.nullif(F.col("runbook"), F.lit("")), F.col("alert.source"))


def hec_enriched_event(settings: S.Settings = S.DEFAULTS) -> Column:
    return _envelope(
        P.epoch_seconds(F.col("enriched_at")), _enriched_source(), settings.enriched_sourcetype, enriched_document(),
        settings, True,
    )


def universal_event(settings: S.Settings = S.DEFAULTS) -> Column:
    return _envelope(
        P.epoch_seconds(F.col("enriched_at")), _enriched_source(), settings.enriched_sourcetype, enriched_document(),
        settings, False,
    )


def hec_dlq_event(settings: S.Settings = S.DEFAULTS) -> Column:
    source = F.coalesce(F.col("alert.source"), F.lit("unknown"))
    return _envelope(P.epoch_seconds(F.col("dlq_at")), source, settings.dlq_sourcetype, dlq_document(), settings, True)


def split_destination(enriched: DataFrame, universal_configured: bool = True) -> DataFrame:
    """Adds ``target`` and ``undeliverable``: the reason an alert has no client to go through."""
    universal = F.col("destination") == "universal"
    reason = F.lit("destination=universal but no client is configured")
    return enriched.withColumn("target", F.when(universal, F.lit("universal")).otherwise(F.lit("splunk"))).withColumn(
        "undeliverable", F.when(universal & F.lit(not universal_configured), reason)
    )


def delivery_lines(enriched: DataFrame, settings: S.Settings = S.DEFAULTS, universal_configured: bool = True) -> DataFrame:
    """``alert_id, target, line`` for every deliverable enriched row."""
    rows = split_destination(enriched, universal_configured).filter(F.col("undeliverable").isNull())
    line = F.when(F.col("target") == "universal", P.render(universal_event(settings))).otherwise(
        P.render(hec_enriched_event(settings))
    )
    return rows.select(F.col("alert.alert_id").alias("alert_id"), "target", line.alias("line"))


def dlq_lines(dead_letters: DataFrame, settings: S.Settings = S.DEFAULTS) -> DataFrame:
    return dead_letters.select(
        F.col("alert.alert_id").alias("alert_id"), F.lit("splunk").alias("target"),
        P.render(hec_dlq_event(settings)).alias("line"),
    )


def batches(lines: DataFrame, size: int = S.DEFAULTS.delivery_batch_size, order: tuple[str, ...] = ("alert_id",)) -> DataFrame:
    """``target, batch, events, payload``: runs of ``size`` lines of one target in ``order``, joined by newlines.

    The same lines make the same payloads in every run, and only the last batch of a target is short.
    """
    numbered = numbered_batches(lines.select("target", *order, "line"), ["target"], [*order, "line"], size)
    gathered = numbered.groupBy("target", "batch").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("_lines"))
    return gathered.select(
        "target", "batch", F.size("_lines").cast("bigint").alias("events"), F.array_join(F.col("_lines.line"), "\n").alias("payload")
    )


def numbered_batches(rows: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Adds ``position`` (from 1) and ``batch`` (from 0): runs of ``size`` rows of each group in ``order``."""
    if size <= 0:
        raise ValueError("the batch size must be positive")
    placed = positions(rows, group, order)
    return placed.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("bigint"))


def delivery_outcome(attempts: DataFrame, max_attempts: int = S.DEFAULTS.delivery_attempts) -> DataFrame:
    """Attempt log ``target, batch_id, attempt, status`` -> one outcome per batch.

    Status 0 or NULL is a network error. The first attempt that is neither is decisive: delivered (200 for
    splunk, any 2xx for universal) or permanent. Otherwise the batch waits for a retry, or has failed after the
    last attempt; the wait doubles from one second.
    """
    status = F.coalesce(F.col("status"), F.lit(0))
    delivered = F.when(F.col("target") == "universal", status.between(200, 299)).otherwise(status == 200)
    retry = (status == 0) | (status == 429) | (status >= 500)
    final = ~retry | delivered
    per_batch = attempts.groupBy("target", "batch_id").agg(
        F.max("attempt").alias("attempts"),
        F.max_by("status", "attempt").alias("last_status"),
        F.min_by(F.when(final, delivered), F.when(final, F.col("attempt"))).alias("_delivered"),
    )
    outcome = (
        F.when(F.col("_delivered"), F.lit("delivered"))
        .when(~F.col("_delivered"), F.lit("permanent_error"))
        .when(F.col("attempts") >= max_attempts, F.lit("failed"))
        .otherwise(F.lit("retry"))
    )
    return per_batch.select(
        "target",
        "batch_id",
        "attempts",
        "last_status",
        outcome.alias("outcome"),
        F.when(outcome == "retry", F.pow(F.lit(2), F.col("attempts") - 1).cast("bigint")).alias("wait_seconds"),
    )
