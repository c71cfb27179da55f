"""Metric events derived from the tables, and the numbers made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.functions import payload as P
from alertweave.operators.numbering import positions

# Metric event -> (counter bucket, field that names the counter).
COUNTED = {
    "alert_ingested": ("alert_ingested", "source"),
    "route_matched": ("route_counts", "route"),
    "dlq_enqueued": ("dlq_counts", "reason"),
    "runbook_success": ("runbook_success", "runbook"),
    "runbook_error": ("runbook_error", "runbook"),
}
BUCKETS = [bucket for bucket, _ in COUNTED.values()]

PIPELINE_STAGES = 3


def _event(df: DataFrame, event: str, ts: str, *fields: Column) -> DataFrame:
    return df.select(F.lit(event).alias("event"), F.col(ts).alias("ts"), P.render(F.struct(*fields)).alias("data"))


def ingested_events(alerts: DataFrame) -> DataFrame:
    return _event(alerts, "alert_ingested", "received_at", F.col("source"))


def routed_events(routed: DataFrame) -> DataFrame:
    return _event(routed, "route_matched", "received_at", F.col("route"))


def dlq_events(dead_letters: DataFrame) -> DataFrame:
    return _event(dead_letters, "dlq_enqueued", "dlq_at", F.col("dlq_reason").alias("reason"))


def runbook_events(enriched: DataFrame, failed: Column | None = None) -> DataFrame:
    """One event per run: an error where ``failed`` holds, a success otherwise, also for one that recorded its own error."""
    if failed is None:
        return _event(enriched, "runbook_success", "enriched_at", F.col("runbook"))
    marked = enriched.select("enriched_at", "runbook", "runbook_error", F.coalesce(failed, F.lit(False)).alias("_failed"))
    return union(
        _event(marked.filter(~F.col("_failed")), "runbook_success", "enriched_at", F.col("runbook")),
        _event(marked.filter("_failed"), "runbook_error", "enriched_at", F.col("runbook"), F.col("runbook_error").alias("error")),
    )


def enricher_error_events(enriched: DataFrame) -> DataFrame:
    """From rows with ``enricher_errors``: one event per recorded error."""
    rows = enriched.select("enriched_at", "runbook", F.explode("enricher_errors").alias("e"))
    return _event(
        rows, "enricher_error", "enriched_at", F.col("e.enricher").alias("enricher"), F.col("e.type").alias("type"),
        F.col("runbook"),
    )


def timing_events(runs: DataFrame) -> DataFrame:
    """From an enricher run log ``ts, runbook, enricher, duration_ms``."""
    return _event(runs, "enricher_duration_ms", "ts", F.col("enricher"), F.col("duration_ms"), F.col("runbook"))


def pipeline_events(runs: DataFrame) -> DataFrame:
    """From a pipeline run log ``ts, runbook, duration_ms, stages_completed``."""
    return _event(
        runs, "enricher_pipeline_duration_ms", "ts", F.col("runbook"), F.col("duration_ms"), F.col("stages_completed")
    )


def cache_stats_events(stats: DataFrame) -> DataFrame:
    """From ``stats_every_n`` rows: the hits and misses of a runbook's cache so far."""
    return _event(stats, "principal_cache_stats", "ts", F.col("hits"), F.col("misses"), F.col("runbook"))


def union(*events: DataFrame) -> DataFrame:
    first, *rest = events
    for other in rest:
        first = first.unionByName(other)
    return first


def counters(metric_events: DataFrame) -> DataFrame:
    """``bucket, name, value`` of the five counted events in one pass; a missing name is ``unknown``."""
    read = metric_events.filter(F.col("event").isin(list(COUNTED))).select("event", "data")
    read = P.compute(read, _d=P.parse(F.col("data")))
    bucket, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for event, (into, field) in COUNTED.items():
        hit = F.col("event") == event
        bucket = F.when(hit, F.lit(into)).otherwise(bucket)
        name = F.when(hit & P.has_value(F.col("_d"), f"$.{field}"), P.as_text(F.col("_d"), f"$.{field}")).otherwise(name)
    return (
        P.compute(read, bucket=bucket, name=F.coalesce(name, F.lit("unknown")))
        .groupBy("bucket", "name")
        .agg(F.count(F.lit(1)).alias("value"))
    )


def one_counter(metric_events: DataFrame, event: str, label: str) -> DataFrame:
    """A single bucket as ``label, value``."""
    bucket, _ = COUNTED[event]
    found = counters(metric_events.filter(F.col("event") == event))
    return found.filter(F.col("bucket") == bucket).select(F.col("name").alias(label), "value")


def add_to_snapshot(snapshot: DataFrame, deltas: DataFrame, updated_at: Column) -> DataFrame:
    """A new counter snapshot; rows of unknown buckets are left out."""
    old = snapshot.filter(F.col("bucket").isin(BUCKETS)).select(
        "bucket", "name", F.col("value").alias("_old"), F.col("updated_at").alias("_stamp")
    )
    both = old.join(deltas.withColumnRenamed("value", "_new"), ["bucket", "name"], "full_outer")
    return both.select(
        "bucket",
        "name",
        (F.coalesce("_old", F.lit(0)) + F.coalesce("_new", F.lit(0))).cast("bigint").alias("value"),
        F.when(F.col("_new").isNotNull(), updated_at).otherwise(F.col("_stamp")).alias("updated_at"),
    )


def counter_keys(counted: DataFrame) -> DataFrame:
    """Counters in their stored form: one text key ``bucket:name``."""
    return counted.select(F.concat_ws(":", "bucket", "name").alias("key"), "value")


def from_counter_keys(stored: DataFrame) -> DataFrame:
    """The stored form read back, split at the first colon; unknown buckets are left out."""
    parts = F.split("key", ":", 2)
    rows = stored.select(
        parts[0].alias("bucket"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("name"), "value"
    )
    return rows.filter(F.col("bucket").isin(BUCKETS))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Current state of each queue."""
    rest = [c for c in snapshots.columns if c not in ("name", "polled_at")]
    newest = F.max(F.struct("polled_at", *rest))
    return snapshots.groupBy("name").agg(newest.alias("_s")).select("name", "_s.*")


def _bucket_sum(bucket: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("bucket") == bucket, F.col("value"))), F.lit(0)).cast("bigint")


def overview(counted: DataFrame, queues: DataFrame, dlq_queue: str, metrics_queue: str) -> DataFrame:
    """One row of totals. The live depth of the dead-letter queue is preferred to its counter."""
    totals = counted.agg(
        _bucket_sum("alert_ingested").alias("total_ingested"),
        _bucket_sum("runbook_success").alias("total_processed"),
        _bucket_sum("runbook_error").alias("total_errors"),
        _bucket_sum("dlq_counts").alias("_dlq"),
    )

    def depth(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("messages")))

    live = queues.agg(
        depth(dlq_queue).alias("_live_dlq"),
        F.coalesce(depth(metrics_queue), F.lit(0)).alias("metrics_queue_depth"),
        F.count(F.lit(1)).alias("queue_count"),
    )
    # Both sides are global aggregates, one row each.
    return totals.join(F.broadcast(live)).select(
        "total_ingested",
        "total_processed",
        "total_errors",
        F.coalesce("_live_dlq", "_dlq").alias("dlq_count"),
        "metrics_queue_depth",
        "queue_count",
    )


def runbook_performance(counted: DataFrame) -> DataFrame:
    """``runbook, success, errors, error_rate`` (percent) in name order; names from either counter."""

    def part(bucket: str) -> Column:
        return F.sum(F.when(F.col("bucket") == bucket, F.col("value")).otherwise(0)).cast("bigint")

    rows = (
        counted.filter(F.col("bucket").isin("runbook_success", "runbook_error"))
        .groupBy(F.col("name").alias("runbook"))
        .agg(part("runbook_success").alias("success"), part("runbook_error").alias("errors"))
    )
    total = F.col("success") + F.col("errors")
    rate = F.when(total > 0, F.round(F.col("errors") * 100 / total, 1)).otherwise(F.lit(0.0))
    badge = F.when(F.col("errors") == 0, F.lit("green")).otherwise(F.lit("red"))
    return rows.select("runbook", "success", "errors", rate.alias("error_rate"), badge.alias("badge")).orderBy("runbook")


def source_share(counted: DataFrame) -> DataFrame:
    """Share of alerts by source; counters are one row per source by now."""
    rows = counted.filter(F.col("bucket") == "alert_ingested").select(F.col("name").alias("source"), "value")
    total = rows.agg(F.sum("value").alias("_total"))
    return rows.join(F.broadcast(total)).select(
        "source", "value", F.round(F.col("value") / F.col("_total"), 4).alias("share")
    )


def ingest_balance(counted: DataFrame) -> DataFrame:
    """Ingested alerts that are neither processed nor dead letters yet."""
    return counted.agg(
        _bucket_sum("alert_ingested").alias("ingested"),
        _bucket_sum("runbook_success").alias("processed"),
        _bucket_sum("dlq_counts").alias("dead_letters"),
    ).withColumn("in_flight", F.col("ingested") - F.col("processed") - F.col("dead_letters"))


def dlq_reasons_ranked(counted: DataFrame) -> DataFrame:
    return (
        counted.filter(F.col("bucket") == "dlq_counts")
        .select(F.col("name").alias("reason"), "value")
        .orderBy(F.col("value").desc(), "reason")
    )


def queue_backlog(snapshots: DataFrame, high_water: int) -> DataFrame:
    """Diagnosis per queue from its latest snapshot."""
    deep = F.col("messages") >= high_water
    diagnosis = (
        F.when(deep & (F.col("consumers") == 0), F.lit("consumer_down"))
        .when(deep, F.lit("falling_behind"))
        .when(F.col("consumers") == 0, F.lit("no_consumer"))
        .otherwise(F.lit("ok"))
    )
    return latest_snapshot(snapshots).select("name", "messages", "consumers", diagnosis.alias("diagnosis"))


def enricher_duration(runs: DataFrame) -> DataFrame:
    """Run times per enricher; the percentiles are exact up to the accuracy of the sketch."""
    return runs.groupBy("enricher").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("duration_ms").alias("avg_ms"),
        F.percentile_approx("duration_ms", 0.5, 10000).alias("p50_ms"),
        F.percentile_approx("duration_ms", 0.95, 10000).alias("p95_ms"),
        F.max("duration_ms").alias("max_ms"),
    )


def enricher_errors(errors: DataFrame) -> DataFrame:
    """From ``enricher_errors`` arrays: count by enricher and type."""
    rows = errors.select(F.explode("enricher_errors").alias("e"))
    return rows.groupBy(F.col("e.enricher").alias("enricher"), F.col("e.type").alias("type")).agg(
        F.count(F.lit(1)).alias("value")
    )


def pipeline_incomplete(runs: DataFrame, stages: int = PIPELINE_STAGES) -> DataFrame:
    return runs.groupBy("runbook").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("stages_completed") < stages).alias("incomplete")
    )


def cache_hit_proxy(runs: DataFrame, hit_below_ms: int = 5, miss_above_ms: int = 50) -> DataFrame:
    """Guess hits and misses of the history look-up from its run time."""
    history = runs.filter(F.col("enricher") == "principal_history")
    return history.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("duration_ms") < hit_below_ms).alias("likely_hits"),
        F.count_if(F.col("duration_ms") > miss_above_ms).alias("likely_misses"),
    )


def cache_stats(replayed: DataFrame, ttl_micros: int, now_micros: Column) -> DataFrame:
    """Hits, misses and entries still alive at ``now``, from replayed look-ups.

    ``anchor`` rows are the misses that stored a result; those younger than one life are alive.
    """
    alive = ~F.col("hit") & F.col("lookup_ok") & (F.col("at") + ttl_micros > now_micros)
    return replayed.agg(
        F.count_if(F.col("hit")).alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        F.count_if(alive).alias("size"),
    )


def enrichment_latency(enriched: DataFrame) -> DataFrame:
    """Seconds from arrival to enrichment, by runbook."""
    micros = F.unix_micros("enriched_at") - F.unix_micros("alert.received_at")
    return enriched.groupBy("runbook").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.min(micros).alias("min_micros"),
        F.max(micros).alias("max_micros"),
        F.sum(micros).alias("sum_micros"),
    )


def stats_every_n(processed: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th processed alert of a runbook with the hits and misses so far, in the order of time and id.

    ``processed`` has ``runbook, ts, alert_id, hit``; ``hit`` is NULL for an alert without a look-up, which counts as processed only.
    """
    every = max(1, every)
    rows = processed.select(
        "runbook", "ts", "alert_id",
        F.coalesce(F.col("hit"), F.lit(False)).cast("bigint").alias("hits"),
        F.coalesce(~F.col("hit"), F.lit(False)).cast("bigint").alias("misses"),
    )
    placed = positions(rows, ["runbook"], ["ts", "alert_id"], ("hits", "misses"))
    return placed.filter(F.col("position") % every == 0).select(
        "runbook", "ts", "alert_id", "position", F.col("running_hits").alias("hits"), F.col("running_misses").alias("misses")
    )
