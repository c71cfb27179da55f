"""Streaming jobs built from the batch steps.

No watermark sits on the path of the alerts themselves: an alert must not be lost for being late. Watermarks
bound state only where a late row costs nothing but a metric or a duplicate.

Every job takes the arguments of ``DataStreamWriter.trigger`` as ``trigger``: by default it works off what there is and
ends, ``{"processingTime": "10 seconds"}`` keeps it running. How much a batch takes is an option of the source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertweave import settings as S
from alertweave.operators import delivery, metrics, queues, routing, ttl
from alertweave.plans.runbooks import Runbook, enrich_all
from alertweave.streaming import cache_state, history_state
from alertweave.streaming.folded import FoldedLog


AVAILABLE_NOW = {"availableNow": True}


def to_table(
    stream: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = (), trigger: dict | None = None
) -> StreamingQuery:
    """Append a stateless stream to a parquet table, each input row exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(**(trigger or AVAILABLE_NOW)).start(path)


def ingest(
    messages: DataFrame, normaliser: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Messages of one source -> normalised rows; the rejects are those with a reason."""
    return to_table(normaliser(messages).drop("payload"), path, checkpoint, (), trigger)


def route(
    alerts: DataFrame, path: str, checkpoint: str, catalog: routing.RouteCatalog | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Alerts -> one table with a folder per queue, the dead letters' among them."""
    routed = routing.route_alerts(alerts, catalog).select(
        *queues.STORED_ALERT, "route", F.coalesce(F.col("queue"), F.lit(S.QUEUE_DLQ)).alias("queue")
    )
    return to_table(routed, path, checkpoint, ("queue",), trigger)


def _each_batch(
    stream: DataFrame,
    checkpoint: str,
    write: Callable[[DataFrame, int], None],
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def enrich(
    routed: DataFrame,
    runbooks: list[Runbook],
    path: str,
    checkpoint: str,
    enriched_at: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Routed alerts -> enriched rows, one folder per micro-batch, overwritten when a batch is repeated.

    Each micro-batch runs the batch plan against the look-up tables as they are then, so an alert is never
    dropped for lateness and no state grows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # Every runbook reads the batch, some more than once.
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        rows = enrich_all(batch, runbooks, enriched_at)
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.unpersist()

    return _each_batch(routed, checkpoint, write, trigger=trigger)


def recent_events(
    alerts: DataFrame,
    audit_events: DataFrame,
    path: str,
    checkpoint: str,
    lookback_minutes: int = 60,
    max_results: int = 50,
    delay_seconds: int = 3600,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Alerts (``alert_id, username, received_at``) and audit events, both streams -> the newest events before each alert.

    Rows up to ``delay_seconds`` behind the newest may come in any order on either side, and ``answered`` then gives what the
    batch join gives. Later alerts are answered with what is known, later events are listed under ``path`` as late.
    """
    a = alerts.select("username", F.unix_micros("received_at").alias("at"), F.col("alert_id").alias("id"))
    e = audit_events.select("username", F.unix_micros("event_time").alias("at"), F.col("event_id").alias("id"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    found = history_state.answers(a, e, lookback_minutes * 60 * 1000000, max_results, delay_seconds)
    return _each_batch(found, checkpoint, write, "update", trigger)


def answered(spark: SparkSession, path: str) -> DataFrame:
    """``alert_id, username, at, late, event_ids, event_ats`` of every alert so far, newest events first."""
    versions = spark.read.schema(f"{history_state.ANSWER}, batch_id bigint").parquet(path).filter("kind <> 'late_event'")
    newest = versions.groupBy("id", "username", "at").agg(
        F.max_by(F.struct("kind", "event_ids", "event_ats"), "batch_id").alias("v")
    )
    late = (F.col("v.kind") == "late_answer").alias("late")
    return newest.select(F.col("id").alias("alert_id"), "username", "at", late, "v.event_ids", "v.event_ats")


def counter_log(spark: SparkSession, path: str, fold_every: int = 20) -> FoldedLog:
    """The running counters that ``count`` keeps under ``path``; ``read()`` gives ``bucket, name, value, updated_at``."""
    schema = "bucket string, name string, value bigint, updated_at timestamp"
    return FoldedLog(spark, path, schema, ("bucket", "name"), every=fold_every)


def count(
    metric_events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, fold_every: int = 20
) -> StreamingQuery:
    """Running counters. Each batch writes the counters it changed; every ``fold_every`` batches they become one snapshot."""

    def write(batch: DataFrame, batch_id: int) -> None:
        log = counter_log(batch.sparkSession, path, fold_every)
        log.append(batch.withColumn("updated_at", F.current_timestamp()), batch_id)
        log.fold_if_due()

    return _each_batch(metrics.counters(metric_events), checkpoint, write, "update", trigger)


def drop_repeats(alerts: DataFrame, delay: str) -> DataFrame:
    """For sources that re-read a back-fill window after a restart; ``delay`` must exceed that window.

    Rows later than ``delay`` are dropped with the repeats. ``append_new`` loses none.
    """
    return alerts.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["alert_id"])


def append_new(alerts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Alerts whose id is not stored under ``path`` yet, however late they come; of repeats in a batch the earliest."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = queues.earliest(batch)
        if batch_id > 0:
            # A repeated batch must not meet its own first try.
            stored = batch.sparkSession.read.schema("alert_id string, batch_id bigint").parquet(path)
            rows = rows.join(stored.filter(F.col("batch_id") < batch_id).select("alert_id"), "alert_id", "left_anti")
        rows.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _each_batch(alerts, checkpoint, write, trigger=trigger)


def replay_ttl(
    lookups: DataFrame,
    ttl_micros: int,
    path: str,
    checkpoint: str,
    delay_seconds: int = 3600,
    trigger: dict | None = None,
) -> list[StreamingQuery]:
    """Streaming form of the cache replay: ``key, at, lookup_id, lookup_ok`` as two tables under ``path``.

    ``lookups`` takes the rows as they come; ``openings`` takes what ``cache_state`` says of each key: the look-ups that open an
    entry, and those that a row out of order has overtaken. ``replayed_ttl`` puts both together. Rows up to ``delay_seconds``
    behind the newest may come in any order and the result is that of the batch replay; a later row is served by the
    entries that are known, opens none, and is listed under ``openings`` as late. None is dropped.

    Only instants travel to the keyed state, one for all look-ups of a key and instant in an Arrow batch, so a hot key costs
    what its clock ticks cost. A key's state goes when its entry has expired and nothing is waiting.
    """
    rows = lookups.select("key", "at", F.col("lookup_id").cast("string").alias("lookup_id"), "lookup_ok")
    stored = to_table(rows, f"{path}/lookups", f"{checkpoint}/lookups", (), trigger)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/openings/batch_id={batch_id}")

    opened = cache_state.openings(rows, ttl_micros, delay_seconds)
    return [stored, _each_batch(opened, f"{checkpoint}/openings", write, "update", trigger)]


def replayed_ttl(spark: SparkSession, path: str, ttl_micros: int) -> DataFrame:
    """The stored look-ups with ``hit, served_by``, given all openings so far."""
    rows = spark.read.schema("key string, at bigint, lookup_id string, lookup_ok boolean").parquet(f"{path}/lookups")
    versions = spark.read.schema(f"{cache_state.OPENING}, batch_id bigint").parquet(f"{path}/openings")
    newest = (
        versions.filter("state <> 'late'")
        .groupBy("key", "at")
        .agg(F.max_by(F.struct("anchor_id", "state"), "batch_id").alias("v"))
    )
    anchors = newest.filter("v.state = 'open'").select("key", "at", "v.anchor_id")
    return ttl.served(rows, anchors, ttl_micros)


def deliver(
    enriched: DataFrame,
    path: str,
    undelivered: str,
    checkpoint: str,
    settings: S.Settings = S.DEFAULTS,
    universal_configured: bool = True,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Enriched rows -> payload files per micro-batch, and undeliverable rows with their reason.

    Both are keyed by the batch id and overwritten when a batch is repeated, so a restart sends nothing twice
    and loses nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        lines = delivery.delivery_lines(batch, settings, universal_configured)
        payloads = delivery.batches(lines, settings.delivery_batch_size)
        payloads.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        failed = delivery.split_destination(batch, universal_configured).filter(F.col("undeliverable").isNotNull())
        failed.write.mode("overwrite").parquet(f"{undelivered}/batch_id={batch_id}")
        batch.unpersist()

    return _each_batch(enriched, checkpoint, write, trigger=trigger)


def windowed_rates(routed: DataFrame, width: str = "1 minute", seconds: int = 60, delay: str | None = None) -> DataFrame:
    """Alerts per second of each queue in tumbling windows; ``delay`` bounds the state."""
    timed = routed.withWatermark("received_at", delay) if delay and routed.isStreaming else routed
    return (
        timed.filter(F.col("queue").isNotNull())
        .groupBy(F.window("received_at", width).alias("w"), "queue")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .select(F.col("w.start").alias("window_start"), "queue", "alerts", (F.col("alerts") / seconds).alias("rate"))
    )


def rate_log(spark: SparkSession, path: str, fold_every: int = 20) -> FoldedLog:
    """Counts by window and queue that ``rates`` keeps under ``path``, and how many of them were late."""
    schema = "window_start timestamp, queue string, alerts bigint, late bigint, newest timestamp"
    return FoldedLog(spark, f"{path}/windows", schema, ("window_start", "queue"), ("alerts", "late"), ("newest",), fold_every)


def rates(
    routed: DataFrame, path: str, checkpoint: str, delay_seconds: int = 600, width: str = "1 minute", trigger: dict | None = None,
    fold_every: int = 20,
) -> StreamingQuery:
    """Alerts by window and queue. Every batch adds its own counts to the windows, so a late alert is counted in its window too.

    An alert is late if it is older than the newest of earlier batches by more than ``delay_seconds``. Late alerts are also
    listed under ``late``, one folder a batch. No state is held between batches: counts of batches are folded as they add up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        log = rate_log(batch.sparkSession, path, fold_every)
        before = log.read().agg(F.max("newest")).first()[0]
        mark = F.lit(before).cast("timestamp") - F.expr(f"interval {int(delay_seconds)} seconds")
        late = F.coalesce(F.col("received_at") < mark, F.lit(False)) if before is not None else F.lit(False)
        rows = batch.filter(F.col("queue").isNotNull() & F.col("received_at").isNotNull()).withColumn("_late", late)
        rows = rows.select("alert_id", "queue", "received_at", "_late").persist(StorageLevel.MEMORY_AND_DISK)
        counted = rows.groupBy(F.window("received_at", width)["start"].alias("window_start"), "queue").agg(
            F.count(F.lit(1)).alias("alerts"), F.count_if("_late").alias("late"), F.max("received_at").alias("newest")
        )
        rows.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        log.append(counted, batch_id)
        log.fold_if_due()
        rows.unpersist()

    return _each_batch(routed, checkpoint, write, trigger=trigger)


def current_rates(spark: SparkSession, path: str, seconds: int = 60) -> DataFrame:
    """``window_start, queue, alerts, late, rate`` of all windows so far."""
    return rate_log(spark, path).read().select(
        "window_start", "queue", "alerts", "late", (F.col("alerts") / seconds).alias("rate")
    )
