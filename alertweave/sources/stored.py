"""Reading back what the pipeline has stored or its neighbours have landed, one JSON text per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.functions import payload as P
from alertweave.sources.normalise import _finish, identity

# Where an enriched alert may go.
DESTINATIONS = ["splunk", "universal"]

# Numbers above this count milliseconds, below it seconds.
MILLISECOND_WATERSHED = 2e10


def _moment(v: Column, path: str) -> Column:
    """ISO text or an epoch number -> timestamp; NULL when neither."""
    number = F.try_variant_get(v, path, "double")
    seconds = F.when(F.abs(number) > MILLISECOND_WATERSHED, number / 1000).otherwise(number)
    numeric = P.kind(P.field(v, path)).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(P.is_string(P.field(v, path)), P.string_at(v, path).try_cast("timestamp")).when(
        numeric, F.timestamp_micros((seconds * 1e6).cast("bigint"))
    )


def _alert_valid(v: Column, at: str) -> Column:
    """The envelope rules: text source, object payload, object metadata, readable time, text id."""

    def absent_or(path: str, good: Column) -> Column:
        return P.field(v, path).isNull() | good

    return (
        P.is_string(P.field(v, f"{at}.source"))
        & P.is_object(P.field(v, f"{at}.raw_payload"))
        & absent_or(f"{at}.metadata", P.is_object(P.field(v, f"{at}.metadata")))
        & absent_or(f"{at}.id", P.is_string(P.field(v, f"{at}.id")))
        & absent_or(f"{at}.received_at", _moment(v, f"{at}.received_at").isNotNull())
    )


def alerts(df: DataFrame, text: str = "text", now: Column | None = None) -> DataFrame:
    """Stored alerts -> normalised rows; invalid ones carry ``alert_invalid``."""
    stamp = F.current_timestamp() if now is None else now
    read = P.compute(
        df,
        _v=P.parse(F.col(text)),
        _body=F.from_json(F.col(text), "raw_payload string, metadata string"),
    )
    v = F.col("_v")
    read = P.compute(read, received_at=F.coalesce(_moment(v, "$.received_at"), stamp))
    return _finish(
        read,
        F.coalesce(P.string_at(v, "$.id"), identity("stored", [], F.col(text))),
        P.string_at(v, "$.source"),
        F.col("_body.raw_payload"),
        F.coalesce(F.col("_body.metadata"), F.lit("{}")),
        F.when(~(P.is_object(v) & _alert_valid(v, "$")), F.lit("alert_invalid")),
        F.col(text),
        P.field(v, "$.raw_payload"),
        F.when(v.isNull(), F.lit("bad_json")).otherwise(F.lit("")),
    )


def enriched(df: DataFrame, text: str = "text", now: Column | None = None) -> DataFrame:
    """Stored enriched alerts -> columns with a ``valid`` flag; an unknown destination is invalid."""
    stamp = F.current_timestamp() if now is None else now
    read = P.compute(df, _v=P.parse(F.col(text)))
    v = F.col("_v")
    destination = P.field(v, "$.destination")
    error = P.field(v, "$.runbook_error")
    extracted = P.field(v, "$.extracted")
    ok = (
        P.is_object(v)
        & P.is_object(P.field(v, "$.alert"))
        & _alert_valid(v, "$.alert")
        & P.is_string(P.field(v, "$.runbook"))
        & (P.field(v, "$.enriched_at").isNull() | _moment(v, "$.enriched_at").isNotNull())
        & (extracted.isNull() | P.is_object(extracted))
        & (error.isNull() | P.is_null(error) | P.is_string(error))
        & (destination.isNull() | F.coalesce(P.string_at(v, "$.destination").isin(DESTINATIONS), F.lit(False)))
    )
    return P.compute(read, valid=ok).select(
        *df.columns,
        "valid",
        P.string_at(v, "$.alert.id").alias("alert_id"),
        P.string_at(v, "$.alert.source").alias("source"),
        P.string_at(v, "$.runbook").alias("runbook"),
        F.coalesce(_moment(v, "$.enriched_at"), stamp).alias("enriched_at"),
        F.coalesce(F.to_json(extracted), F.lit("{}")).alias("extracted"),
        P.string_at(v, "$.runbook_error").alias("runbook_error"),
        F.coalesce(P.string_at(v, "$.destination"), F.lit("splunk")).alias("destination"),
    )


def dead_letters(df: DataFrame, text: str = "text") -> DataFrame:
    """Stored dead letters -> columns; the alert inside is taken as it is, only the JSON must be readable."""
    read = P.compute(df, _v=P.parse(F.col(text)))
    v = F.col("_v")
    return read.select(
        *df.columns,
        P.is_object(v).alias("valid"),
        F.coalesce(P.string_at(v, "$.alert.id"), F.lit("unknown")).alias("alert_id"),
        F.coalesce(P.string_at(v, "$.alert.source"), F.lit("unknown")).alias("source"),
        F.coalesce(P.string_at(v, "$.dlq_reason"), F.lit("unknown")).alias("dlq_reason"),
        _moment(v, "$.dlq_at").alias("dlq_at"),
        P.string_at(v, "$.original_queue").alias("original_queue"),
        P.string_at(v, "$.error_detail").alias("error_detail"),
        F.to_json(P.field(v, "$.alert")).alias("alert"),
    )


def metric_events(df: DataFrame, text: str = "text") -> DataFrame:
    """Metric messages -> ``event, ts, data``; a missing event is ``""``, missing or empty data ``{}``."""
    read = P.compute(df, _v=P.parse(F.col(text)))
    v = F.col("_v")
    has_data = P.truthy(v, "$.data")
    return P.compute(read, valid=P.is_object(v) & (~has_data | P.is_object(P.field(v, "$.data")))).select(
        *df.columns,
        "valid",
        F.when(P.has_key(v, "$.event"), P.as_text(v, "$.event")).otherwise(F.lit("")).alias("event"),
        _moment(v, "$.ts").alias("ts"),
        F.when(has_data, F.to_json(P.field(v, "$.data"))).otherwise(F.lit("{}")).alias("data"),
    )


def queue_snapshots(df: DataFrame, reply: str = "reply", polled_at: str = "polled_at") -> DataFrame:
    """Management replies, one JSON list per poll -> one row per queue; any other reply gives none."""
    queues = F.from_json(F.col(reply), "array<variant>")
    listed = F.when(P.is_array(P.parse(F.col(reply))), queues)
    read = df.select(F.col(polled_at).alias("polled_at"), F.explode(listed).alias("_q"))
    q = F.col("_q")

    def number(path: str) -> Column:
        return F.when(P.has_key(q, path), F.try_variant_get(q, path, "bigint")).otherwise(F.lit(0).cast("bigint"))

    def text(path: str, default: str) -> Column:
        return F.when(P.has_key(q, path), P.string_at(q, path)).otherwise(F.lit(default))

    def rate(path: str) -> Column:
        return F.round(F.coalesce(F.try_variant_get(q, path, "double"), F.lit(0.0)), 2)

    return read.filter(P.is_object(q)).select(
        "polled_at",
        text("$.name", "").alias("name"),
        number("$.messages").alias("messages"),
        number("$.messages_ready").alias("messages_ready"),
        number("$.messages_unacknowledged").alias("messages_unacknowledged"),
        number("$.consumers").alias("consumers"),
        rate("$.message_stats.publish_details.rate").alias("publish_rate"),
        rate("$.message_stats.deliver_get_details.rate").alias("deliver_rate"),
        text("$.state", "unknown").alias("state"),
    )
