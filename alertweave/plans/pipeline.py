"""The whole flow from normalised messages to delivery lines and metrics."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave import settings as S
from alertweave.functions import payload as P
from alertweave.operators import delivery, metrics, queues, routing
from alertweave.plans.runbooks import Runbook, enrich_all, failed
from alertweave.session import materialise
from alertweave.sources import normalise


@dataclass(frozen=True)
class Flow:
    """The tables of one run. ``failed`` are the rows of ``enriched`` that count as errors and have no line."""

    rejects: DataFrame
    routed: DataFrame
    dead_letters: DataFrame
    enriched: DataFrame
    failed: DataFrame
    lines: DataFrame
    metric_events: DataFrame


def finished(enriched: DataFrame, runbooks: Iterable[Runbook], settings: S.Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to deliver, rows that failed, and the metric events of both, the cache's statistics among them."""
    wrong = failed(runbooks)
    looked = enriched.select("runbook", F.col("enriched_at").alias("ts"), F.col("alert.alert_id").alias("alert_id"), F.col("cache_hit").alias("hit"))
    cached = looked.join(F.broadcast(looked.filter("hit IS NOT NULL").select("runbook").distinct()), "runbook", "left_semi")
    events = metrics.union(
        metrics.runbook_events(enriched, wrong),
        metrics.enricher_error_events(enriched),
        metrics.cache_stats_events(metrics.stats_every_n(cached, settings.cache_stats_every)),
    )
    return enriched.filter(~wrong), enriched.filter(wrong), events


def flow(
    normalised: DataFrame,
    runbooks: Iterable[Runbook],
    catalog: routing.RouteCatalog | None = None,
    settings: S.Settings = S.DEFAULTS,
    now: Column | None = None,
) -> Flow:
    """All steps as one plan per table, for looks at some of them; ``run`` shares the work between all.

    The messages are stored once first, so that a message has one arrival time in all of them.
    """
    normalised = materialise(normalised.drop("payload"), "normalised")
    normalised = P.compute(normalised, payload=P.parse(F.col("raw_payload")))
    alerts = normalise.alerts(normalised, with_payload=True)
    routed = routing.route_alerts(alerts, catalog or routing.default_catalog(settings))
    dead = queues.dead_letters(routing.unmatched(routed), now)
    runbooks = list(runbooks)
    enriched = enrich_all(routing.matched(routed), runbooks, now)
    done, wrong, outcomes = finished(enriched, runbooks, settings)
    lines = delivery.delivery_lines(done, settings).unionByName(delivery.dlq_lines(dead, settings))
    events = metrics.union(
        metrics.ingested_events(alerts),
        metrics.routed_events(routing.matched(routed)),
        metrics.dlq_events(dead),
        outcomes,
    )
    return Flow(normalise.rejects(normalised), routed.drop("payload"), dead, enriched, wrong, lines, events)


REJECTS = "rejects"


def run(
    normalised: DataFrame,
    runbooks: Iterable[Runbook],
    folder: str,
    catalog: routing.RouteCatalog | None = None,
    settings: S.Settings = S.DEFAULTS,
    now: Column | None = None,
) -> Flow:
    """As ``flow``, with every stage written once under ``folder`` and read back.

    The messages are scanned and parsed in one pass, which writes routed alerts, dead letters and rejects to one
    table partitioned by queue. Every later step reads its own partitions only.
    """
    spark = normalised.sparkSession
    runbooks = list(runbooks)
    routed = routing.route_alerts(normalised, catalog or routing.default_catalog(settings))
    ok = F.col("reject_reason").isNull()
    place = F.when(~ok, F.lit(REJECTS)).otherwise(F.coalesce(F.col("queue"), F.lit(S.QUEUE_DLQ)))
    routed.withColumn("queue", place).drop("payload").write.partitionBy("queue").parquet(f"{folder}/messages")
    stored = spark.read.parquet(f"{folder}/messages")

    accepted = stored.filter(F.col("queue") != REJECTS)
    alerts = accepted.select(*queues.STORED_ALERT, "route", "queue")
    matched = alerts.filter(F.col("queue") != S.QUEUE_DLQ)
    dead = queues.dead_letters(alerts.filter(F.col("queue") == S.QUEUE_DLQ), now)
    dead.write.parquet(f"{folder}/dead_letters")
    dead = spark.read.parquet(f"{folder}/dead_letters")
    enrich_all(matched, runbooks, now).write.partitionBy("runbook").parquet(f"{folder}/enriched")
    enriched = spark.read.parquet(f"{folder}/enriched")
    done, wrong, outcomes = finished(enriched, runbooks, settings)
    lines = delivery.delivery_lines(done, settings).unionByName(delivery.dlq_lines(dead, settings))
    events = metrics.union(
        metrics.ingested_events(alerts),
        metrics.routed_events(matched),
        metrics.dlq_events(dead),
        outcomes,
    )
    return Flow(normalise.rejects(stored.filter(F.col("queue") == REJECTS)), alerts, dead, enriched, wrong, lines, events)


def routing_summary(normalised: DataFrame, catalog: routing.RouteCatalog | None = None) -> DataFrame:
    """How many messages went to each route, became dead letters or were rejected, and why: one scan, one shuffle."""
    routed = routing.route_alerts(normalised, catalog)
    rejected = F.col("reject_reason").isNotNull()
    outcome = F.when(rejected, F.lit("reject")).when(F.col("route").isNull(), F.lit("dlq")).otherwise(F.lit("route"))
    name = F.when(rejected, F.col("reject_reason")).when(F.col("route").isNull(), F.lit(queues.NO_ROUTE)).otherwise(
        F.col("route")
    )
    return (
        routed.select(outcome.alias("outcome"), name.alias("name"))
        .groupBy("outcome", "name")
        .agg(F.count(F.lit(1)).alias("value"))
    )
