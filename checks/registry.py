"""Registered queries: each operator over whole tables, with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave import settings as S
from alertweave.functions import arn, identity
from alertweave.functions import payload as P
from alertweave.operators import delivery, extract, history, metrics, queues, resources, routing, ttl
from alertweave.plans import pipeline, runbooks
from alertweave.plans.guard import RowFunction
from alertweave.session import fresh_path, materialise
from alertweave.sources import normalise, polling, stored
from alertweave.streaming import jobs, sending
from checks import inputs as I
from checks.sql import CACHED_HISTORY, CATALOG, DAY, MATCH, RUNBOOKS, WHOLE_HISTORY, query, ttl_chain, uuid

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# A look-back of an hour finds little in a month of sparse events, so the checks use a day and three results.
LOOKBACK_MINUTES = 24 * 60
MAX_RESULTS = 3
CHECK_SETTINGS = S.Settings(
    lookback_minutes=LOOKBACK_MINUTES, history_max_results=MAX_RESULTS, cache_ttl_seconds=86400
)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def micros(c: str) -> Column:
    return F.unix_micros(c)


def at(doc: str, path: str, alias: str) -> Column:
    return F.get_json_object(doc, f"$.{path}").alias(alias)


# ---------------------------------------------------------------- frames shared by the queries


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Every payload that is a JSON object, as an alert."""
    rows = I.frame(spark, sf, "alerts")
    return P.compute(rows, payload=P.parse(F.col("raw_payload"))).filter(P.is_object(F.col("payload")))


def routed(spark: SparkSession, sf: str) -> DataFrame:
    return routing.route_alerts(alerts(spark, sf))


def cloudtrail(spark: SparkSession, sf: str) -> DataFrame:
    return routed(spark, sf).filter(F.col("route") == "cloud.aws.cloudtrail")


def identified(spark: SparkSession, sf: str) -> DataFrame:
    return history.eligibility(history.identify(cloudtrail(spark, sf)))


def with_writes(spark: SparkSession, sf: str, max_results: int | None = MAX_RESULTS) -> DataFrame:
    slim = identified(spark, sf).select(
        "alert_id", "received_at", "principal", "eligible", "identity_error", "history_error"
    )
    slim = materialise(slim, "identified")
    recent = history.with_history(slim, I.frame(spark, sf, "audit"), LOOKBACK_MINUTES, max_results)
    return materialise(history.successful_writes(recent), "writes")


def known_resources(spark: SparkSession, sf: str) -> DataFrame:
    return resources.load_resources(I.resources(spark, sf))


def stored_resources(spark: SparkSession, sf: str) -> resources.Stored:
    return resources.Stored(I.resources(spark, sf))


def stored_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched rows with fixture values for runbook, time and destination."""
    rows = routing.matched(routed(spark, sf))
    return rows.select(
        F.struct(*queues.STORED_ALERT).alias("alert"),
        F.when(F.col("event_id") % 9 == 0, "").otherwise(F.col("route")).alias("runbook"),
        F.timestamp_micros(micros("received_at") + (F.col("event_id") % 1000) * 1000).alias("enriched_at"),
        F.lit("{}").alias("extracted"),
        F.lit(None).cast("string").alias("runbook_error"),
        F.when(F.col("event_id") % 4 == 0, "universal").otherwise("splunk").alias("destination"),
    )


def dead(spark: SparkSession, sf: str) -> DataFrame:
    return queues.dead_letters(routing.unmatched(routed(spark, sf)), F.col("received_at"))


def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    return stored.metric_events(I.frame(spark, sf, "metrics")).filter("valid")


def counted(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.counters(metric_rows(spark, sf))


def lookups(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.frame(spark, sf, "lookups").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withColumn("at", micros("ts"))


# ---------------------------------------------------------------- sources


def kafka(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.kafka(I.kafka(spark, sf), F.col("timestamp"))


def sqs(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.sqs(I.frame(spark, sf, "sqs"), F.col("ts"))


def pubsub(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.pubsub(I.pubsub(spark, sf), F.col("ts"))


def splunk(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.splunk(I.frame(spark, sf, "splunk"), I.SEARCH, F.col("ts"))


def universal(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.universal(I.frame(spark, sf, "universal"), F.col("ts"))


KAFKA_ID = uuid("concat_ws('|', 'kafka', topic, CAST(part AS STRING), CAST(event_id AS STRING))")
KAFKA_SQL = query(
    f"""SELECT {KAFKA_ID} AS alert_id, 'kafka' AS source, epoch_us(received_at) AS received_us, raw_payload,
 topic, CAST(part AS STRING) AS part, CAST(event_id AS STRING) AS "offset", key FROM kafka_reasons WHERE reason IS NULL""",
    "kafka_reasons",
)


def kafka_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "alert_id", "source", micros("received_at").alias("received_us"), "raw_payload",
        at("metadata", "topic", "topic"), at("metadata", "partition", "part"), at("metadata", "offset", "offset"),
        at("metadata", "key", "key"),
    )


@register("kafka_normalize", KAFKA_SQL)
def kafka_normalize(spark, sf):
    return kafka_columns(normalise.alerts(kafka(spark, sf)))


SQS_ID = uuid("concat_ws('|', 'sqs', MessageId)")


@register(
    "sqs_normalize",
    query(
        f"""SELECT {SQS_ID} AS alert_id, payload AS raw_payload, MessageId AS message_id, ReceiptHandle AS receipt_handle,
 b->>'$.TopicArn' AS topic_arn, b->>'$.Subject' AS subject FROM sqs_reasons WHERE reason IS NULL""",
        "sqs_reasons",
    ),
)
def sqs_normalize(spark, sf):
    return normalise.alerts(sqs(spark, sf)).select(
        "alert_id", "raw_payload", at("metadata", "message_id", "message_id"),
        at("metadata", "receipt_handle", "receipt_handle"), at("metadata", "topic_arn", "topic_arn"),
        at("metadata", "subject", "subject"),
    )


PUBSUB_ID = uuid("concat_ws('|', 'pubsub', 'projects/p/subscriptions/s', concat('m', CAST(event_id AS STRING)))")


@register(
    "pubsub_normalize",
    query(
        f"""SELECT {PUBSUB_ID} AS alert_id, payload AS raw_payload, concat('m', CAST(event_id AS STRING)) AS message_id,
 CASE WHEN event_id % 17 = 0 THEN NULL WHEN epoch_us(received_at) % 1000000 = 0 THEN strftime(received_at, '%Y-%m-%dT%H:%M:%S+00:00')
  ELSE strftime(received_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS publish_time,
 CAST(event_id % 5 AS STRING) AS n, 'projects/p/subscriptions/s' AS subscription FROM pubsub_reasons WHERE reason IS NULL""",
        "pubsub_reasons",
    ),
)
def pubsub_normalize(spark, sf):
    return normalise.alerts(pubsub(spark, sf)).select(
        "alert_id", "raw_payload", at("metadata", "message_id", "message_id"),
        at("metadata", "publish_time", "publish_time"), at("metadata", "attributes.n", "n"),
        at("metadata", "subscription", "subscription"),
    )


SPLUNK_ID = uuid("concat_ws('|', 'splunk_es', \"row\")")
SPLUNK_SQL = (
    f"SELECT {SPLUNK_ID} AS alert_id, \"row\" AS raw_payload, '{I.SEARCH}' AS search, j->>'$._time' AS event_time,"
    " j->>'$.host' AS host, j->>'$.sourcetype' AS sourcetype FROM splunk_reasons WHERE reason IS NULL"
)


def splunk_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "alert_id", "raw_payload", at("metadata", "search", "search"), at("metadata", "event_time", "event_time"),
        at("metadata", "host", "host"), at("metadata", "sourcetype", "sourcetype"),
    )


@register("splunk_normalize", query(SPLUNK_SQL, "splunk_reasons"))
def splunk_normalize(spark, sf):
    return splunk_columns(normalise.alerts(splunk(spark, sf)))


POLL_SPLIT = "2024-01-15 12:00:00"
POLL_END = "2024-01-31 00:00:00"


@register(
    "incremental_poll",
    query(
        f"""SELECT alert_id, CASE WHEN ts <= TIMESTAMP '{POLL_SPLIT}' THEN 1 ELSE 2 END AS poll,
 max(CASE WHEN ts <= TIMESTAMP '{POLL_SPLIT}' THEN epoch_us(ts) END) OVER () AS checkpoint_us
 FROM (SELECT {SPLUNK_ID} AS alert_id, ts FROM splunk_reasons WHERE reason IS NULL)""",
        "splunk_reasons",
    ),
)
def incremental_poll(spark, sf):
    """Two polls: the first with a back-fill over everything before it, the second from the checkpoint it leaves."""
    rows = normalise.alerts(splunk(spark, sf)).select("alert_id", "received_at")
    middle, end = F.lit(POLL_SPLIT).cast("timestamp"), F.lit(POLL_END).cast("timestamp")
    first = polling.poll(rows, "received_at", polling.start_checkpoint(middle, 45 * 24 * 60), middle)
    mark = polling.next_checkpoint(first, "received_at", F.lit(None).cast("timestamp"))
    # One row with one timestamp.
    marked = rows.join(F.broadcast(mark))
    second = polling.poll(marked, "received_at", F.col("checkpoint"), end)
    fresh = polling.drop_boundary_repeats(
        second, first.join(F.broadcast(mark)), "received_at", F.col("checkpoint")
    )
    both = first.select("alert_id", F.lit(1).alias("poll")).unionByName(
        fresh.select("alert_id", F.lit(2).alias("poll"))
    )
    return both.join(F.broadcast(mark)).select("alert_id", "poll", micros("checkpoint").alias("checkpoint_us"))


UNIVERSAL_ID = uuid("concat_ws('|', 'universal', CAST(request_id AS STRING))")


@register(
    "universal_normalize",
    query(
        f"""SELECT {UNIVERSAL_ID} AS alert_id, coalesce(j->>'$.source', 'universal') AS source,
 CAST(j->'$.raw_payload' AS STRING) AS raw_payload, j->>'$.metadata.team' AS team, remote_addr
 FROM universal_reasons WHERE reason IS NULL""",
        "universal_reasons",
    ),
)
def universal_normalize(spark, sf):
    return normalise.alerts(universal(spark, sf)).select(
        "alert_id", "source", "raw_payload", at("metadata", "team", "team"),
        at("metadata", "remote_addr", "remote_addr"),
    )


@register(
    "alert_identity",
    query(
        f"""SELECT count(DISTINCT id) AS ids, count(*) AS alerts, min(length(id)) AS shortest, max(length(id)) AS longest,
 epoch_us(min(received_at)) AS first_us, epoch_us(max(received_at)) AS last_us
 FROM (SELECT {KAFKA_ID} AS id, received_at FROM kafka_reasons WHERE reason IS NULL)""",
        "kafka_reasons",
    ),
)
def alert_identity(spark, sf):
    return normalise.alerts(kafka(spark, sf)).agg(
        F.countDistinct("alert_id").alias("ids"), F.count(F.lit(1)).alias("alerts"),
        F.min(F.length("alert_id").cast("bigint")).alias("shortest"),
        F.max(F.length("alert_id").cast("bigint")).alias("longest"),
        F.min(micros("received_at")).alias("first_us"), F.max(micros("received_at")).alias("last_us"),
    )


ALL_REASONS = """SELECT 'kafka' AS source, event_id, reason FROM kafka_reasons
UNION ALL SELECT 'sqs', event_id, reason FROM sqs_reasons
UNION ALL SELECT 'pubsub', event_id, reason FROM pubsub_reasons
UNION ALL SELECT 'splunk_es', event_id, reason FROM splunk_reasons
UNION ALL SELECT coalesce(CASE WHEN json_type(j, '$.source') = 'VARCHAR' THEN j->>'$.source' END, 'universal'), event_id, reason FROM universal_reasons"""
FIVE = ("kafka_reasons", "sqs_reasons", "pubsub_reasons", "splunk_reasons", "universal_reasons")


def five_sources(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.all_sources(*[f(spark, sf) for f in (kafka, sqs, pubsub, splunk, universal)])


@register(
    "ingest_rejects",
    query(
        f"SELECT source, reason, count(*) AS messages FROM ({ALL_REASONS}) WHERE reason IS NOT NULL GROUP BY 1, 2", *FIVE
    ),
)
def ingest_rejects(spark, sf):
    return (
        normalise.rejects(five_sources(spark, sf)).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("messages"))
    )


@register(
    "all_sources",
    query(
        f"""SELECT {KAFKA_ID} AS alert_id, 'kafka' AS source, raw_payload FROM kafka_reasons WHERE reason IS NULL
UNION ALL SELECT {SQS_ID}, 'sqs', payload FROM sqs_reasons WHERE reason IS NULL
UNION ALL SELECT {PUBSUB_ID}, 'pubsub', payload FROM pubsub_reasons WHERE reason IS NULL
UNION ALL SELECT {SPLUNK_ID}, 'splunk_es', "row" FROM splunk_reasons WHERE reason IS NULL
UNION ALL SELECT {UNIVERSAL_ID}, coalesce(j->>'$.source', 'universal'), CAST(j->'$.raw_payload' AS STRING)
 FROM universal_reasons WHERE reason IS NULL""",
        *FIVE,
    ),
)
def all_sources(spark, sf):
    return normalise.alerts(five_sources(spark, sf)).select("alert_id", "source", "raw_payload")


# Stored texts: alerts written out as JSON, some of them spoiled. The texts read alike in both engines.
EID = I.EID
STORED_ALERT_TEXT = f"""CASE
 WHEN event_id % 31 = 0 THEN concat('{{"id":"a', {EID}, '","source":7,"raw_payload":{{}}}}')
 WHEN event_id % 37 = 0 THEN concat('{{"id":"a', {EID}, '","source":"kafka"}}')
 WHEN event_id % 41 = 0 THEN concat('{{"id":"a', {EID}, '","source":"kafka","raw_payload":{{}},"received_at":"never"}}')
 WHEN event_id % 43 = 0 THEN 'broken'
 WHEN event_id % 47 = 0 THEN concat('{{"source":"kafka","raw_payload":{{"k":', {EID}, '}},"received_at":1704067200}}')
 ELSE concat('{{"id":"a', {EID}, '","source":"kafka","received_at":"2024-01-02T03:04:05Z","raw_payload":', raw_payload,
  ',"metadata":{{"n":1}}}}') END"""


def stored_alert_texts(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(spark, sf).select("event_id", F.expr(STORED_ALERT_TEXT).alias("text"))


STORED_GOOD = "event_id % 31 <> 0 AND event_id % 37 <> 0 AND event_id % 41 <> 0 AND event_id % 43 <> 0"


@register(
    "alert_parse",
    query(
        f"""SELECT CASE WHEN NOT ok THEN NULL WHEN odd THEN {uuid("concat_ws('|', 'stored', text)")}
  ELSE concat('a', {EID}) END AS alert_id,
 CASE WHEN ok THEN 'kafka' END AS source,
 CASE WHEN NOT ok THEN NULL WHEN odd THEN 1704067200000000 ELSE 1704164645000000 END AS received_us,
 CASE WHEN NOT ok THEN NULL WHEN odd THEN concat('{{"k":', {EID}, '}}') ELSE raw_payload END AS raw_payload,
 CASE WHEN NOT ok THEN 'alert_invalid' END AS reason
 FROM (SELECT event_id, raw_payload, {STORED_ALERT_TEXT} AS text, {STORED_GOOD} AS ok, event_id % 47 = 0 AS odd FROM objects)""",
        "objects",
    ),
)
def alert_parse(spark, sf):
    ok = F.col("reject_reason").isNull()
    return stored.alerts(stored_alert_texts(spark, sf)).select(
        "alert_id", F.when(ok, F.col("source")).alias("source"),
        F.when(ok, micros("received_at")).alias("received_us"), "raw_payload", F.col("reject_reason").alias("reason"),
    )


ENRICHED_TEXT = f"""CASE
 WHEN event_id % 31 = 0 THEN concat('{{"alert":{{"id":"a', {EID}, '","source":"kafka","raw_payload":{{}}}},"runbook":"test","destination":"mail"}}')
 WHEN event_id % 37 = 0 THEN concat('{{"alert":{{"id":"a', {EID}, '","source":"kafka"}},"runbook":"test"}}')
 WHEN event_id % 41 = 0 THEN concat('{{"alert":{{"id":"a', {EID}, '","source":"kafka","raw_payload":{{}}}}}}')
 WHEN event_id % 43 = 0 THEN '[]'
 ELSE concat('{{"alert":{{"id":"a', {EID}, '","source":"kafka","raw_payload":', raw_payload, '}},"runbook":"',
  CASE WHEN event_id % 2 = 0 THEN 'test' ELSE 'cloud.gcp.event_audit' END, '","enriched_at":"2024-01-02T03:04:05.5+00:00","extracted":{{"k":', {EID},
  '}}', CASE WHEN event_id % 5 = 0 THEN ',"runbook_error":"x"' ELSE '' END,
  CASE WHEN event_id % 3 = 0 THEN ',"destination":"universal"' ELSE '' END, '}}') END"""


@register(
    "enriched_parse",
    query(
        f"""SELECT event_id, {STORED_GOOD} AS valid, CASE WHEN {STORED_GOOD} THEN concat('a', {EID}) END AS alert_id,
 CASE WHEN NOT ({STORED_GOOD}) THEN NULL WHEN event_id % 2 = 0 THEN 'test' ELSE 'cloud.gcp.event_audit' END AS runbook,
 CASE WHEN {STORED_GOOD} THEN concat('{{"k":', {EID}, '}}') END AS extracted,
 CASE WHEN {STORED_GOOD} AND event_id % 5 = 0 THEN 'x' END AS runbook_error,
 CASE WHEN NOT ({STORED_GOOD}) THEN NULL WHEN event_id % 3 = 0 THEN 'universal' ELSE 'splunk' END AS destination,
 CASE WHEN {STORED_GOOD} THEN 1704164645500000 END AS enriched_us FROM objects""",
        "objects",
    ),
)
def enriched_parse(spark, sf):
    rows = stored.enriched(alerts(spark, sf).select("event_id", F.expr(ENRICHED_TEXT).alias("text")))
    kept = {c: F.when(F.col("valid"), F.col(c)) for c in ("alert_id", "runbook", "extracted", "runbook_error", "destination")}
    return rows.select(
        "event_id", "valid", *[e.alias(c) for c, e in kept.items()],
        F.when(F.col("valid"), micros("enriched_at")).alias("enriched_us"),
    )


DLQ_TEXT = f"""CASE
 WHEN event_id % 31 = 0 THEN 'broken'
 WHEN event_id % 37 = 0 THEN '{{"dlq_reason":"publish_failed"}}'
 WHEN event_id % 41 = 0 THEN '[1]'
 ELSE concat('{{"alert":{{"id":"a', {EID}, '","source":"sqs","raw_payload":', raw_payload,
  '}},"dlq_reason":"no_route_matched","dlq_at":"2024-01-02T03:04:05+00:00","original_queue":"alerts","error_detail":"d"}}') END"""


@register(
    "dlq_parse",
    query(
        f"""SELECT event_id, event_id % 31 <> 0 AND (event_id % 37 = 0 OR event_id % 41 <> 0) AS valid,
 CASE WHEN good THEN concat('a', {EID}) ELSE 'unknown' END AS alert_id, CASE WHEN good THEN 'sqs' ELSE 'unknown' END AS source,
 CASE WHEN good THEN 'no_route_matched' WHEN event_id % 31 <> 0 AND event_id % 37 = 0 THEN 'publish_failed' ELSE 'unknown' END AS dlq_reason,
 CASE WHEN good THEN 'alerts' END AS original_queue, CASE WHEN good THEN 'd' END AS error_detail
 FROM (SELECT event_id, event_id % 31 <> 0 AND event_id % 37 <> 0 AND event_id % 41 <> 0 AS good FROM objects)""",
        "objects",
    ),
)
def dlq_parse(spark, sf):
    return stored.dead_letters(alerts(spark, sf).select("event_id", F.expr(DLQ_TEXT).alias("text"))).select(
        "event_id", "valid", "alert_id", "source", "dlq_reason", "original_queue", "error_detail"
    )


@register(
    "metric_event_parse",
    query(
        """SELECT event_id, coalesce(json_type(j) = 'OBJECT', false) AS valid, CASE WHEN j IS NULL THEN '' ELSE coalesce(j->>'$.event', '') END AS event,
 CASE WHEN json_type(j, '$.data') = 'OBJECT' THEN j->>'$.data.source' END AS source,
 CASE WHEN j->>'$.ts' IS NOT NULL THEN 1704067200000000 END AS ts_us FROM metric_docs""",
        "metric_docs",
    ),
)
def metric_event_parse(spark, sf):
    return stored.metric_events(I.frame(spark, sf, "metrics")).select(
        "event_id", "valid", "event", at("data", "source", "source"), micros("ts").alias("ts_us")
    )


SNAPSHOT_COLUMNS = [
    "name", "messages", "messages_ready", "messages_unacknowledged", "consumers", "publish_rate", "deliver_rate", "state",
]


@register(
    "queue_snapshot_normalize",
    query(f"SELECT epoch_us(polled_at) AS polled_us, {', '.join(SNAPSHOT_COLUMNS)} FROM snapshots", "snapshots"),
)
def queue_snapshot_normalize(spark, sf):
    return snapshots(spark, sf).select(micros("polled_at").alias("polled_us"), *SNAPSHOT_COLUMNS)


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return stored.queue_snapshots(I.frame(spark, sf, "queues"))


# ---------------------------------------------------------------- predicates and routing

MATCHERS = {
    "match_eks": routing.match_eks,
    "match_cloudtrail": routing.match_cloudtrail,
    "match_guardduty": routing.match_guardduty,
    "match_gcp_audit": routing.match_gcp_audit,
    "match_test": routing.match_test(),
}


def _matcher(name: str) -> None:
    @register(name, query(f"SELECT event_id, {MATCH[name]} AS matched FROM parsed", "parsed"))
    def run(spark, sf):
        rows = P.compute(I.frame(spark, sf, "alerts").select("event_id", "raw_payload"), v=P.parse(F.col("raw_payload")))
        return rows.select("event_id", F.coalesce(MATCHERS[name](F.col("v")), F.lit(False)).alias("matched"))


for _name in MATCHERS:
    _matcher(_name)


@register("route_alerts", query("SELECT event_id, route, queue FROM routed", "routed"))
def route_alerts(spark, sf):
    return routed(spark, sf).select("event_id", "route", "queue")


@register(
    "matcher_isolation",
    query(
        """SELECT event_id, CASE WHEN route = 'cloud.aws.guardduty' AND CAST(j->>'$.schemaVersion' AS DOUBLE) > 1 THEN 'odd' ELSE route END AS route
 FROM routed""",
        "routed",
    ),
)
def matcher_isolation(spark, sf):
    """A matcher that cannot read most payloads stands first; it yields no match there and the next ones are tried."""

    def odd(v: Column) -> Column:
        version = F.try_variant_get(v, "$.schemaVersion", "string").try_cast("double")
        finding = F.try_variant_get(v, "$.type", "string")
        return (version > 1) & F.try_element_at(F.split(finding, ":"), F.lit(2)).contains("/")

    catalog = routing.RouteCatalog([routing.Route("odd", "runbook.odd", odd), *routing.default_catalog()])
    rows = routing.route_alerts(alerts(spark, sf), catalog)
    return rows.select("event_id", "route")


@register(
    "route_catalog_unique",
    query(
        f"""SELECT c.name, count(DISTINCT c.position) AS registrations, count(DISTINCT r.queue) AS queues, count(r.event_id) AS alerts
 FROM {CATALOG} LEFT JOIN routed r ON r.route = c.name GROUP BY c.name""",
        "routed",
    ),
)
def route_catalog_unique(spark, sf):
    """Each name is registered once and stands for one queue; with the alerts it received."""
    used = routed(spark, sf).groupBy(F.col("route").alias("name")).agg(
        F.countDistinct("queue").alias("queues"), F.count(F.lit(1)).alias("alerts")
    )
    names = routing.default_catalog().table(spark).groupBy("name").agg(F.count(F.lit(1)).alias("registrations"))
    return names.join(used, "name", "left").select(
        "name", "registrations", F.coalesce("queues", F.lit(0)).alias("queues"),
        F.coalesce("alerts", F.lit(0)).alias("alerts"),
    )


@register(
    "successful_writes",
    query("SELECT alert_id, place, eid AS event_id, e->>'$.eventName' AS event_name FROM writes", "writes"),
)
def successful_writes(spark, sf):
    """One row per kept history item, with its place in the history."""
    rows = with_writes(spark, sf).select(
        "alert_id", F.posexplode("events").alias("i", "item")
    ).withColumn("writes", F.array("item"))
    again = rows.select("alert_id", "i", F.array("item").alias("events"))
    kept = history.successful_writes(again).filter(F.size("writes") == 1)
    return kept.select(
        "alert_id", (F.col("i") + 1).cast("bigint").alias("place"), F.col("events")[0]["event_id"].alias("event_id"),
        P.string_at(F.col("writes")[0], "$.eventName").alias("event_name"),
    )


@register(
    "write_parse_errors",
    query("SELECT alert_id, error, type FROM errors WHERE enricher = 'write_filter'", "errors"),
)
def write_parse_errors(spark, sf):
    return with_writes(spark, sf).filter(F.col("write_error").isNotNull()).select(
        "alert_id", "write_error.error", "write_error.type"
    )


@register(
    "history_eligible",
    query(
        """SELECT e.alert_id, e.ok AS eligible, x.error, x.type FROM eligible e
 LEFT JOIN (SELECT * FROM errors WHERE enricher = 'principal_history') x ON x.alert_id = e.alert_id""",
        "eligible", "errors",
    ),
)
def history_eligible(spark, sf):
    return identified(spark, sf).select("alert_id", "eligible", "history_error.error", "history_error.type")


@register(
    "inspect_dispatch",
    query(
        """SELECT eid AS event_id, CASE WHEN c IN ('s3.amazonaws.com|PutObject') THEN 's3:object' WHEN c = 'iam.amazonaws.com|CreateUser' THEN 'iam:user'
 WHEN c = 'ec2.amazonaws.com|RunInstances' THEN 'ec2:instance' END AS kind FROM (
 SELECT event_id AS eid, concat(e->>'$.eventSource', '|', e->>'$.eventName') AS c FROM (
  SELECT event_id, CASE WHEN json_valid(cloudtrail_event) THEN CAST(cloudtrail_event AS JSON) END AS e FROM audit))""",
        "audit",
    ),
)
def inspect_dispatch(spark, sf):
    rows = I.frame(spark, sf, "audit").select("event_id", P.parse(F.col("cloudtrail_event")).alias("v"))
    return rows.select("event_id", resources.resource_type(F.col("v")).alias("kind"))


ITEM_TEXT = f"""CASE WHEN CAST(event_id AS BIGINT) % 17 = 0 THEN '42' WHEN CAST(event_id AS BIGINT) % 19 = 0 THEN 'null'
 WHEN CAST(event_id AS BIGINT) % 3 = 0 AND cloudtrail_event <> 'not json' THEN concat('{{"EventId":"', event_id, '","Username":"', username, '","CloudTrailEvent":', cloudtrail_event, '}}')
 ELSE concat('{{"EventId":"', event_id, '","Username":"', username, '","CloudTrailEvent":"', username, '"}}') END"""


@register(
    "history_dict_filter",
    query(
        """SELECT event_id, username, CASE WHEN CAST(event_id AS BIGINT) % 3 = 0 AND cloudtrail_event <> 'not json'
  THEN CAST(cloudtrail_event AS JSON)->>'$.eventName' ELSE username END AS shown FROM audit
 WHERE CAST(event_id AS BIGINT) % 17 <> 0 AND CAST(event_id AS BIGINT) % 19 <> 0""",
        "audit",
    ),
)
def history_dict_filter(spark, sf):
    items = I.frame(spark, sf, "audit").select(F.expr(ITEM_TEXT).alias("item"))
    read = history.audit_events_from_items(items)
    return read.select(
        "event_id", "username",
        F.coalesce(F.get_json_object("cloudtrail_event", "$.eventName"), F.col("cloudtrail_event")).alias("shown"),
    )


# ---------------------------------------------------------------- projections

_READABLE = "(NOT json_exists(j, '$.userIdentity') OR json_type(j, '$.userIdentity') = 'OBJECT')"


@register(
    "cloudtrail_fields",
    query(
        f"""SELECT event_id, CASE WHEN {_READABLE} THEN CASE WHEN coalesce(j->>'$.userIdentity.userName', '') <> '' THEN j->>'$.userIdentity.userName'
  ELSE coalesce(j->>'$.userIdentity.arn', 'unknown') END END AS "user",
 CASE WHEN {_READABLE} THEN coalesce(j->>'$.userIdentity.type', 'unknown') END AS user_type,
 j->>'$.eventName' AS event_name, j->>'$.eventSource' AS event_source, j->>'$.awsRegion' AS aws_region, j->>'$.sourceIPAddress' AS source_ip
 FROM routed WHERE route = 'cloud.aws.cloudtrail'""",
        "routed",
    ),
)
def cloudtrail_fields(spark, sf):
    rows = cloudtrail(spark, sf).select(
        "event_id", extract.as_json(extract.cloudtrail_fields(F.col("payload"))).alias("x")
    )
    names = ["user", "user_type", "event_name", "event_source", "aws_region", "source_ip"]
    return rows.select("event_id", *[at("x", n, n) for n in names])


@register(
    "gcp_fields",
    query(
        """SELECT event_id, j->>'$.resource.labels.project_id' AS project_id, j->>'$.protoPayload.methodName' AS method_name,
 j->>'$.protoPayload.serviceName' AS service_name, j->>'$.protoPayload.authenticationInfo.principalEmail' AS principal_email
 FROM routed WHERE route = 'cloud.gcp.event_audit'""",
        "routed",
    ),
)
def gcp_fields(spark, sf):
    rows = routed(spark, sf).filter(F.col("route") == "cloud.gcp.event_audit").select(
        "event_id", extract.as_json(extract.gcp_fields(F.col("payload"))).alias("x")
    )
    names = ["project_id", "method_name", "service_name", "principal_email"]
    return rows.select("event_id", *[at("x", n, n) for n in names])


@register("test_echo", query("SELECT alert_id, raw_payload AS extracted FROM routed WHERE route = 'test'", "routed"))
def test_echo(spark, sf):
    return runbooks.test_echo().enrich(routed(spark, sf)).select(F.col("alert.alert_id").alias("alert_id"), "extracted")


PRINCIPAL_SQL = "SELECT alert_id, provider, nid AS normalized_id, raw_id, display_name, account AS account_or_project, problem AS error, problem_type AS type FROM who"


@register("principal_aws", query(PRINCIPAL_SQL, "who"))
def principal_aws(spark, sf):
    return identified(spark, sf).select("alert_id", "principal.*", "identity_error.error", "identity_error.type")


def _arn_rows(spark: SparkSession, sf: str) -> DataFrame:
    return I.frame(spark, sf, "identities").select("event_id", F.get_json_object("identity", "$.arn").alias("arn"))


ARN_FROM = "(SELECT event_id, identity->>'$.arn' AS arn FROM identities)"


@register(
    "arn_collapse",
    query(
        f"""SELECT event_id, regexp_replace(arn, '^arn:([^:]*):sts:[^:]*:([^:]*):assumed-role/([^/]*)/.*$', 'arn:\\1:iam::\\2:role/\\3') AS collapsed
 FROM {ARN_FROM}""",
        "identities",
    ),
)
def arn_collapse(spark, sf):
    return _arn_rows(spark, sf).select("event_id", arn.collapse_session(F.col("arn")).alias("collapsed"))


@register(
    "arn_account",
    query(f"SELECT event_id, nullif(split_part(arn, ':', 5), '') AS account FROM {ARN_FROM}", "identities"),
)
def arn_account(spark, sf):
    return _arn_rows(spark, sf).select("event_id", arn.account(F.col("arn")).alias("account"))


@register(
    "arn_name",
    query(
        f"""SELECT event_id, CASE WHEN contains(part, '/') THEN substr(part, strpos(part, '/') + 1) ELSE part END AS name
 FROM (SELECT event_id, split_part(arn, ':', 6) AS part FROM {ARN_FROM})""",
        "identities",
    ),
)
def arn_name(spark, sf):
    return _arn_rows(spark, sf).select("event_id", arn.resource_name(F.col("arn")).alias("name"))


GCP_EMAIL = f"""CASE WHEN event_id % 5 = 0 THEN concat('Svc', {I.s('user_id')}, '@Proj', {I.s('user_id % 7')}, '.iam.gserviceaccount.com')
 WHEN event_id % 5 = 1 THEN concat('U', {I.s('user_id')}, '@Example.com') WHEN event_id % 5 = 2 THEN '' WHEN event_id % 5 = 3 THEN '@.iam.gserviceaccount.com' END"""


@register(
    "principal_gcp",
    f"""SELECT event_id, CASE WHEN email IS NULL OR email = '' THEN NULL WHEN service THEN lower(email) ELSE concat('user:', lower(email)) END AS normalized_id,
 nullif(email, '') AS display_name, CASE WHEN service THEN nullif(replace(split_part(lower(email), '@', 2), '.iam.gserviceaccount.com', ''), '') END AS project,
 CASE WHEN email IS NULL OR email = '' THEN 'authenticationInfo missing principalEmail' END AS problem
 FROM (SELECT event_id, email, coalesce(ends_with(lower(email), '.iam.gserviceaccount.com'), false) AS service
  FROM (SELECT event_id, {GCP_EMAIL} AS email FROM events))""",
)
def principal_gcp(spark, sf):
    rows = I.events(spark, sf).select("event_id", F.expr(GCP_EMAIL).alias("principalEmail"))
    info = rows.select("event_id", P.parse(F.to_json(F.struct("principalEmail"))).alias("auth"))
    return identity.add_principal_gcp(info, "auth").select(
        "event_id", "principal.normalized_id", "principal.display_name",
        F.col("principal.account_or_project").alias("project"), "problem",
    )


AD_EVENT = f"""CASE WHEN event_id % 4 = 0 THEN concat('{{"domain_name":"corp', {I.s('user_id % 3')}, '","sam_account_name":"User', {I.s('user_id')}, '"}}')
 WHEN event_id % 4 = 1 THEN concat('{{"domain_name":"","domain":"Corp', {I.s('user_id % 3')}, '","sam_account":', {I.s('user_id')}, '}}')
 WHEN event_id % 4 = 2 THEN '{{"domain":"corp"}}' ELSE '{{"sam_account":"x","domain":null}}' END"""


@register(
    "principal_ad",
    f"""SELECT event_id, CASE WHEN d IS NULL OR a IS NULL THEN NULL ELSE concat(upper(d), '\\', lower(a)) END AS normalized_id,
 CASE WHEN d IS NULL OR a IS NULL THEN NULL ELSE concat(d, '\\', a) END AS raw_id, CASE WHEN d IS NOT NULL AND a IS NOT NULL THEN upper(d) END AS domain,
 CASE WHEN d IS NULL OR a IS NULL THEN 'AD event missing domain and sam_account fields' END AS problem
 FROM (SELECT event_id, coalesce(nullif(json_extract_string(j, '$.domain_name'), ''), json_extract_string(j, '$.domain')) AS d,
  coalesce(json_extract_string(j, '$.sam_account_name'), nullif(json_extract_string(j, '$.sam_account'), '0')) AS a
  FROM (SELECT event_id, CAST({AD_EVENT} AS JSON) AS j FROM events))""",
)
def principal_ad(spark, sf):
    rows = I.events(spark, sf).select("event_id", P.parse(F.expr(AD_EVENT)).alias("v"))
    return identity.add_principal_ad(rows, "v").select(
        "event_id", "principal.normalized_id", "principal.raw_id",
        F.col("principal.account_or_project").alias("domain"), "problem",
    )


@register(
    "principal_key",
    query("SELECT concat(provider, '::', nid) AS principal, count(*) AS alerts FROM who WHERE nid IS NOT NULL GROUP BY 1", "who"),
)
def principal_key(spark, sf):
    rows = identified(spark, sf).select(identity.principal_key(F.col("principal")).alias("principal"))
    return rows.filter(F.col("principal").isNotNull()).groupBy("principal").agg(F.count(F.lit(1)).alias("alerts"))


@register("lookup_username", query("SELECT alert_id, display_name AS username FROM who", "who"))
def lookup_username(spark, sf):
    return identified(spark, sf).select("alert_id", identity.lookup_username(F.col("principal")).alias("username"))


@register("resource_keys", query("SELECT alert_id, place, event_name, resource_key FROM targets", "targets"))
def resource_keys(spark, sf):
    """Resource keys of the writes; ``place`` is found again from the event's place in the history."""
    rows = with_writes(spark, sf)
    single = rows.select("alert_id", "received_at", F.posexplode("events").alias("i", "item")).select(
        "alert_id", "received_at", "i", F.array("item").alias("events")
    )
    written = history.successful_writes(single).filter(F.size("writes") == 1)
    place = written.select("alert_id", "i", F.col("writes")[0].alias("event"))
    kinds = P.compute(place, kind=resources.resource_type(F.col("event"))).filter(F.col("kind").isNotNull())
    return kinds.select(
        "alert_id", (F.col("i") + 1).cast("bigint").alias("place"),
        P.string_at(F.col("event"), "$.eventName").alias("event_name"),
        F.explode(resources.resource_keys(F.col("event"), F.col("kind"))).alias("resource_key"),
    )


@register(
    "route_catalog",
    query(
        f"""SELECT c.position, c.name, c.queue, count(r.event_id) AS alerts FROM {CATALOG} LEFT JOIN routed r ON r.route = c.name
 GROUP BY 1, 2, 3""",
        "routed",
    ),
)
def route_catalog(spark, sf):
    """The catalog with the alerts each route received."""
    used = routed(spark, sf).groupBy("route").agg(F.count(F.lit(1)).alias("alerts"))
    names = routing.default_catalog().table(spark)
    return names.join(used, names["name"] == used["route"], "left").select(
        "position", "name", "queue", F.coalesce("alerts", F.lit(0)).alias("alerts")
    )


@register("routes_in_order", query(
    f"""SELECT c.position, c.name, count(r.event_id) AS alerts FROM {CATALOG} LEFT JOIN routed r ON r.route = c.name
 GROUP BY 1, 2 ORDER BY c.position""", "routed"))
def routes_in_order(spark, sf):
    return route_catalog(spark, sf).select("position", "name", "alerts").orderBy("position")


@register(
    "runbook_catalog",
    query(
        f"""SELECT b.name, b.source_queue, count(r.event_id) AS alerts FROM {RUNBOOKS} LEFT JOIN routed r ON r.queue = b.source_queue
 GROUP BY 1, 2""",
        "routed",
    ),
)
def runbook_catalog(spark, sf):
    waiting = routed(spark, sf).groupBy("queue").agg(F.count(F.lit(1)).alias("alerts"))
    names = runbooks.runbook_table(spark)
    return names.join(waiting, names["source_queue"] == waiting["queue"], "left").select(
        "name", "source_queue", F.coalesce("alerts", F.lit(0)).alias("alerts")
    )


@register(
    "strip_response_metadata",
    query("SELECT resource_key, epoch_us(valid_from) AS from_us, payload FROM resources", "resources"),
)
def strip_response_metadata(spark, sf):
    return known_resources(spark, sf).select("resource_key", micros("valid_from").alias("from_us"), "payload")


PRINCIPAL_LOOKUPS = (
    "pl AS (SELECT concat(provider, '::', nid) AS key, epoch_us(received_at) AS moment, alert_id AS lookup_id, true AS lookup_ok,"
    " display_name FROM eligible WHERE ok)"
)


EXTRACTED_SQL = """SELECT w.alert_id, 'cloud.aws.cloudtrail' AS runbook, nid AS principal, CASE WHEN nid IS NULL THEN NULL ELSE coalesce(h.n, 0) END AS recent,
 coalesce(s.n, 0) AS writes, coalesce(i.n, 0) AS inspected, coalesce(x.n, 0) AS errors, j->>'$.eventName' AS event_name
 FROM who w LEFT JOIN (SELECT alert_id, count(*) AS n FROM history GROUP BY 1) h ON h.alert_id = w.alert_id
 LEFT JOIN (SELECT alert_id, count(*) AS n FROM writes GROUP BY 1) s ON s.alert_id = w.alert_id
 LEFT JOIN (SELECT alert_id, count(DISTINCT resource_key) AS n FROM found_writes WHERE missing IS NULL GROUP BY 1) i ON i.alert_id = w.alert_id
 LEFT JOIN (SELECT alert_id, count(*) AS n FROM errors GROUP BY 1) x ON x.alert_id = w.alert_id
UNION ALL SELECT alert_id, route, NULL, NULL, NULL, NULL, NULL, NULL FROM routed WHERE route IN ('cloud.gcp.event_audit', 'test')"""


@register(
    "enriched_assemble",
    query(
        EXTRACTED_SQL, "eligible", "own_history", "who", "history", "writes", "found_writes", "errors", "routed",
        extra=PRINCIPAL_LOOKUPS + ", " + ttl_chain("pl"), before="history", swap={"history": CACHED_HISTORY},
    ),
)
def enriched_assemble(spark, sf):
    """All runbooks over the routed alerts, look-ups shared through the cache; what they wrote is read back from the extracted JSON."""
    return _assembled(spark, sf, True)


@register("enriched_uncached", query(EXTRACTED_SQL, "who", "history", "writes", "found_writes", "errors", "routed"))
def enriched_uncached(spark, sf):
    """The same with a look-up for every alert."""
    return _assembled(spark, sf, False)


def _assembled(spark: SparkSession, sf: str, cached: bool) -> DataFrame:
    books = runbooks.default_runbooks(I.frame(spark, sf, "audit"), stored_resources(spark, sf), CHECK_SETTINGS, cached)
    rows = runbooks.enrich_all(routed(spark, sf), books, F.col("received_at"))
    x = F.col("_x")
    read = P.compute(rows, _x=P.parse(F.col("extracted")))

    def size(path: str) -> Column:
        return F.size(F.try_variant_get(x, path, "array<variant>")).cast("bigint")

    full = F.col("runbook") == "cloud.aws.cloudtrail"
    inspected = F.map_keys(F.try_variant_get(x, "$.cloudtrail.inspected_objects", "map<string,variant>"))
    recent = P.field(x, "$.cloudtrail.principal_recent_events")
    return read.select(
        F.col("alert.alert_id").alias("alert_id"), "runbook",
        P.string_at(x, "$.principal.normalized_id").alias("principal"),
        F.when(recent.isNotNull(), size("$.cloudtrail.principal_recent_events")).alias("recent"),
        F.when(full, size("$.cloudtrail.successful_writes")).alias("writes"),
        F.when(full, F.size(inspected).cast("bigint")).alias("inspected"),
        F.when(full, F.coalesce(F.when(P.has_key(x, "$.enricher_errors"), size("$.enricher_errors")), F.lit(0))).alias("errors"),
        F.when(full, P.string_at(x, "$.event_name")).alias("event_name"),
    )


SUMMARY_SQL = """SELECT CASE WHEN reason IS NOT NULL THEN 'reject' WHEN route IS NULL THEN 'dlq' ELSE 'route' END AS outcome,
 coalesce(reason, route, 'no_route_matched') AS name, count(*) AS value
 FROM kafka_reasons LEFT JOIN (SELECT event_id AS eid, route FROM routed) ON eid = event_id GROUP BY 1, 2"""


@register("routing_summary", query(SUMMARY_SQL, "kafka_reasons", "routed"))
def routing_summary(spark, sf):
    return pipeline.routing_summary(kafka(spark, sf))


# ---------------------------------------------------------------- sinks


@register(
    "queue_fanout",
    query("SELECT alert_id, coalesce(queue, 'alerts.dlq') AS queue, raw_payload, epoch_us(received_at) AS received_us FROM routed", "routed"),
)
def queue_fanout(spark, sf):
    """Written by queue in one pass and read back."""
    path = fresh_path(spark, "queues")
    queues.write_queues(routed(spark, sf), path)
    return spark.read.parquet(path).select("alert_id", "queue", "raw_payload", micros("received_at").alias("received_us"))


@register(
    "dlq_envelope",
    query(
        """SELECT alert_id, 'no_route_matched' AS dlq_reason, 'alerts' AS original_queue, epoch_us(received_at) AS dlq_us,
 concat('No matcher returned True for payload keys: [''', array_to_string(json_keys(j), ''', '''), ''']') AS error_detail FROM dlq""",
        "dlq",
    ),
)
def dlq_envelope(spark, sf):
    return dead(spark, sf).select(
        "alert.alert_id", "dlq_reason", "original_queue", micros("dlq_at").alias("dlq_us"), "error_detail"
    )


@register(
    "enriched_write",
    query("SELECT alert_id, runbook, epoch_us(enriched_at) AS enriched_us, CASE WHEN runbook = 'cloud.gcp.event_audit' THEN 'universal' WHEN runbook = 'test' THEN 'splunk' ELSE destination END AS destination FROM stored", "stored"),
)
def enriched_write(spark, sf):
    """The destination is forced to the runbook's own, then the rows are stored and read back."""
    books = [
        runbooks.Runbook("cloud.gcp.event_audit", S.QUEUE_GCP_AUDIT, extract.gcp_fields, "universal"),
        runbooks.test_echo(),
    ]
    path = fresh_path(spark, "enriched")
    runbooks.force_destination(stored_rows(spark, sf), books).write.parquet(path)
    return spark.read.parquet(path).select(
        "alert.alert_id", "runbook", micros("enriched_at").alias("enriched_us"), "destination"
    )


def _event_columns(rows: DataFrame, line: Column, index: bool) -> DataFrame:
    """Fields of a rendered event, read back from its text."""
    read = P.compute(rows.select("alert.alert_id", line.alias("line")), _e=P.parse(F.col("line")))
    e = F.col("_e")
    columns = [
        (F.try_variant_get(e, "$.time", "decimal(20,6)") * 1000000).cast("bigint").alias("time_us"),
        *[P.string_at(e, f"$.{n}").alias(n) for n in ("host", "source", "sourcetype")],
        P.has_key(e, "$.index").alias("has_index"),
        P.string_at(e, "$.event.alert.id").alias("event_alert"),
        P.is_object(P.field(e, "$.event.alert.raw_payload")).alias("payload_is_object"),
    ]
    return read.select("alert_id", *columns)


def _hec_sql(source: str, stamp: str, kind: str, table: str, has_index: bool) -> str:
    settings = S.DEFAULTS
    name = settings.enriched_sourcetype if kind == "enriched" else settings.dlq_sourcetype
    return query(
        f"""SELECT alert_id, epoch_us({stamp}) AS time_us, '{settings.host}' AS host, {source} AS source,
 '{name}' AS sourcetype, {str(has_index).lower()} AS has_index, alert_id AS event_alert, true AS payload_is_object FROM {table}""",
        table,
    )


_SOURCE = "CASE WHEN runbook = '' THEN 'kafka' ELSE runbook END"


@register("hec_enriched_event", _hec_sql(_SOURCE, "enriched_at", "enriched", "stored", True))
def hec_enriched_event(spark, sf):
    return _event_columns(stored_rows(spark, sf), P.render(delivery.hec_enriched_event()), True)


@register("universal_event", _hec_sql(_SOURCE, "enriched_at", "enriched", "stored", False))
def universal_event(spark, sf):
    return _event_columns(stored_rows(spark, sf), P.render(delivery.universal_event()), False)


@register("hec_dlq_event", _hec_sql("'kafka'", "received_at", "dlq", "dlq", True))
def hec_dlq_event(spark, sf):
    return _event_columns(dead(spark, sf), P.render(delivery.hec_dlq_event()), True)


@register(
    "destination_split",
    query(
        """SELECT alert_id, destination AS target, CASE WHEN destination = 'universal' THEN 'destination=universal but no client is configured' END AS undeliverable
 FROM stored""",
        "stored",
    ),
)
def destination_split(spark, sf):
    return delivery.split_destination(stored_rows(spark, sf), universal_configured=False).select(
        "alert.alert_id", "target", "undeliverable"
    )


@register(
    "hec_batches",
    query(
        """SELECT target, batch, count(*) AS events, string_agg(alert_id, ',' ORDER BY position) AS ids, string_agg(runbook, ',' ORDER BY position) AS sources
 FROM (SELECT *, CAST(floor((position - 1) / 50.0) AS BIGINT) AS batch FROM (SELECT destination AS target, alert_id,
  CASE WHEN runbook = '' THEN 'kafka' ELSE runbook END AS runbook, row_number() OVER (PARTITION BY destination ORDER BY alert_id) AS position FROM stored))
 GROUP BY 1, 2""",
        "stored",
    ),
)
def hec_batches(spark, sf):
    """Payloads of up to 50 lines; what stands in each line is read back from its text, in order."""
    sent = delivery.batches(delivery.delivery_lines(stored_rows(spark, sf)))
    lines = F.split("payload", "\n")
    read = lambda path: F.array_join(F.transform(lines, lambda x: F.get_json_object(x, path)), ",")
    return sent.select("target", "batch", "events", read("$.event.alert.id").alias("ids"), read("$.source").alias("sources"))


@register(
    "hec_batch_totals",
    query(
        """SELECT destination AS target, count(*) AS events, CAST(0 AS BIGINT) AS oversized, count(*) AS lines FROM stored GROUP BY 1""",
        "stored",
    ),
)
def hec_batch_totals(spark, sf):
    lines = F.size(F.split("payload", "\n")).cast("bigint")
    return delivery.batches(delivery.delivery_lines(stored_rows(spark, sf))).groupBy("target").agg(
        F.sum("events").alias("events"),
        F.count_if(F.col("events") > S.DEFAULTS.delivery_batch_size).alias("oversized"),
        F.sum(lines).alias("lines"),
    )


@register(
    "delivery_outcome",
    query(
        """SELECT target, batch_id, attempts, last_status, CASE WHEN first_final IS NULL THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'retry' END
  WHEN first_final = 200 OR (target = 'universal' AND first_final BETWEEN 200 AND 299) THEN 'delivered' ELSE 'permanent_error' END AS outcome,
 CASE WHEN first_final IS NULL AND attempts < 3 THEN CAST(pow(2, attempts - 1) AS BIGINT) END AS wait_seconds
 FROM (SELECT target, batch_id, max(attempt) AS attempts, max_by(status, attempt) AS last_status,
  min_by(status, attempt) FILTER (WHERE NOT (status = 0 OR status = 429 OR status >= 500)) AS first_final FROM attempts GROUP BY 1, 2)""",
        "attempts",
    ),
)
def delivery_outcome(spark, sf):
    return delivery.delivery_outcome(I.frame(spark, sf, "attempts"))


def strict_gcp(guarded: bool) -> runbooks.Runbook:
    """A runbook that reads its fields with a plain Python function, which raises on what it does not expect."""

    def read(payload: dict) -> dict:
        if not isinstance(payload.get("resource"), dict):
            raise ValueError("resource is not an object")
        call = payload["protoPayload"]
        if "authenticationInfo" not in call:
            raise LookupError("nobody is named")
        return {"project_id": payload["resource"]["labels"]["project_id"], "method": call["methodName"]}

    fields = RowFunction(read, "project_id string, method string")
    return runbooks.Runbook("cloud.gcp.event_audit", S.QUEUE_GCP_AUDIT, fields, guarded=guarded)


def strict_rows(spark: SparkSession, sf: str, guarded: bool) -> DataFrame:
    return strict_gcp(guarded).enrich(routing.matched(routed(spark, sf)), F.col("received_at"))


@register(
    "runbook_failures",
    query(
        """SELECT alert_id, CASE WHEN event_id % 9 = 0 THEN 'ValueError: resource is not an object'
  WHEN event_id % 3 = 0 THEN 'LookupError: nobody is named' END AS runbook_error,
 CASE WHEN event_id % 3 <> 0 THEN j->>'$.resource.labels.project_id' END AS project_id, raw_payload, event_id % 3 = 0 AS failed
 FROM routed WHERE route = 'cloud.gcp.event_audit'""",
        "routed",
    ),
)
def runbook_failures(spark, sf):
    """Every alert of the queue comes out; those whose fields could not be read carry the reason."""
    return strict_rows(spark, sf, False).select(
        "alert.alert_id", "runbook_error", F.get_json_object("extracted", "$.project_id").alias("project_id"),
        "alert.raw_payload", runbooks.failed([strict_gcp(False)]).alias("failed"),
    )


METRIC_COUNTS = """SELECT 'alert_ingested' AS event, 'kafka' AS name, count(*) AS value FROM objects
UNION ALL SELECT 'route_matched', route, count(*) FROM routed WHERE route IS NOT NULL GROUP BY route
UNION ALL SELECT 'dlq_enqueued', 'no_route_matched', count(*) FROM dlq
UNION ALL SELECT 'runbook_success', name, sum(n) FROM (SELECT runbook AS name, count(*) AS n FROM stored GROUP BY runbook
  UNION ALL SELECT route, count(*) FROM routed WHERE route = 'cloud.gcp.event_audit' AND event_id % 3 <> 0 GROUP BY route) GROUP BY name
UNION ALL SELECT 'runbook_error', concat(route, '/', CASE WHEN event_id % 9 = 0 THEN 'ValueError: resource is not an object' ELSE 'LookupError: nobody is named' END),
 count(*) FROM routed WHERE route = 'cloud.gcp.event_audit' AND event_id % 3 = 0 GROUP BY 2
UNION ALL SELECT 'enricher_error', concat(enricher, '/', type), count(*) FROM errors WHERE enricher = 'principal_identity' GROUP BY 2
UNION ALL SELECT 'enricher_duration_ms', enricher, count(*) FROM runs GROUP BY enricher
UNION ALL SELECT 'enricher_pipeline_duration_ms', runbook, count(*) FROM runs GROUP BY runbook
UNION ALL SELECT 'principal_cache_stats', concat(runbook, '/', CAST(hits AS STRING), '/', CAST(position - hits AS STRING)), count(*) FROM (
 SELECT runbook, row_number() OVER w AS position, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS BIGINT) AS hits
 FROM (SELECT l.runbook, l.lookup_id, l.ts, r.hit FROM lookups l JOIN r ON r.lookup_id = l.lookup_id)
 WINDOW w AS (PARTITION BY runbook ORDER BY ts, lookup_id ROWS UNBOUNDED PRECEDING)) WHERE position % 50 = 0 GROUP BY 2"""


@register(
    "metric_events",
    query(METRIC_COUNTS, "objects", "routed", "dlq", "stored", "errors", "runs", "lookups", extra=ttl_chain("lookups")),
)
def metric_events(spark, sf):
    """Every kind of event derived from its table, counted by the name it carries."""
    r = routed(spark, sf)
    wrong = identified(spark, sf).select(
        F.col("received_at").alias("enriched_at"), F.lit("cloud.aws.cloudtrail").alias("runbook"),
        F.filter(F.array("identity_error"), lambda e: e.isNotNull()).alias("enricher_errors"),
    )
    runs = I.frame(spark, sf, "runs")
    events = metrics.union(
        metrics.ingested_events(alerts(spark, sf)), metrics.routed_events(routing.matched(r)),
        metrics.dlq_events(dead(spark, sf)), metrics.runbook_events(stored_rows(spark, sf)),
        metrics.runbook_events(strict_rows(spark, sf, False), runbooks.failed([strict_gcp(False)])),
        metrics.enricher_error_events(wrong), metrics.timing_events(runs), metrics.pipeline_events(runs),
        metrics.cache_stats_events(replay_stats(spark, sf)),
    )
    event = F.col("event")
    names = ("source", "route", "reason", "runbook", "enricher", "type", "error", "hits", "misses")
    field = {n: F.get_json_object("data", f"$.{n}") for n in names}
    name = (
        F.when(event == "alert_ingested", field["source"])
        .when(event == "route_matched", field["route"])
        .when(event == "dlq_enqueued", field["reason"])
        .when(event == "runbook_error", F.concat_ws("/", field["runbook"], field["error"]))
        .when(event == "enricher_error", F.concat_ws("/", field["enricher"], field["type"]))
        .when(event == "enricher_duration_ms", field["enricher"])
        .when(event == "principal_cache_stats", F.concat_ws("/", field["runbook"], field["hits"], field["misses"]))
        .otherwise(field["runbook"])
    )
    return events.groupBy("event", name.alias("name")).agg(F.count(F.lit(1)).alias("value"))


@register(
    "counter_snapshot",
    query(
        """SELECT coalesce(o.bucket, n.bucket) AS bucket, coalesce(o.name, n.name) AS name,
 coalesce(o.value, 0) + coalesce(n.value, 0) AS value, CASE WHEN n.bucket IS NULL THEN 1 ELSE 2 END AS stamp FROM
 (SELECT CASE WHEN bucket = 'dlq_counts' THEN 'alert_ingested' ELSE bucket END AS bucket, name, value FROM counters) o
 FULL OUTER JOIN counters n ON n.bucket = o.bucket AND n.name = o.name""",
        "counters",
    ),
)
def counter_snapshot(spark, sf):
    """The counters in stored form, loaded back and added to once more; an unknown bucket is ignored."""
    now = counted(spark, sf)
    renamed = now.withColumn(
        "bucket", F.when(F.col("bucket") == "dlq_counts", "alert_ingested").otherwise(F.col("bucket"))
    )
    unknown = now.agg(F.max("name").alias("name"), F.max("value").alias("value")).select(F.lit("other").alias("bucket"), "name", "value")
    saved = metrics.from_counter_keys(metrics.counter_keys(renamed.unionByName(unknown)))
    snapshot = saved.withColumn("updated_at", F.timestamp_seconds(F.lit(1)))
    return metrics.add_to_snapshot(snapshot, now, F.timestamp_seconds(F.lit(2))).select(
        "bucket", "name", "value", F.unix_seconds("updated_at").cast("int").alias("stamp")
    )


# ---------------------------------------------------------------- joins


HISTORY_SQL = query("SELECT alert_id, eid AS event_id, place FROM history", "history")


@register("principal_history", HISTORY_SQL)
def principal_history(spark, sf):
    slim = materialise(identified(spark, sf).select("alert_id", "received_at", "principal", "eligible"), "identified")
    rows = history.with_history(slim, I.frame(spark, sf, "audit"), LOOKBACK_MINUTES, MAX_RESULTS)
    return rows.select("alert_id", F.posexplode("events").alias("i", "item")).select(
        "alert_id", "item.event_id", (F.col("i") + 1).cast("bigint").alias("place")
    )


@register(
    "history_top_n",
    query(
        """SELECT username, epoch_us(received_at) AS at, eid AS event_id, place FROM (SELECT DISTINCT x.username, x.received_at, a.event_id AS eid,
 row_number() OVER (PARTITION BY x.event_id ORDER BY a.event_time DESC, a.event_id DESC) AS place
 FROM alerts x JOIN audit a ON a.username = x.username AND a.event_time BETWEEN x.received_at - INTERVAL 1 DAY AND x.received_at) WHERE place <= 3""",
        "alerts", "audit",
    ),
)
def history_top_n(spark, sf):
    """The three newest events of the last day for every distinct name and time, over all events."""
    pairs = history.history_pairs(
        I.frame(spark, sf, "alerts").select("username", "received_at"), I.frame(spark, sf, "audit"),
        LOOKBACK_MINUTES, MAX_RESULTS,
    )
    return pairs.select("username", "at", "event_id", "place")


@register(
    "inspect_resources",
    query("SELECT alert_id, place, event_name, resource_key, payload FROM found", "found"),
)
def inspect_resources(spark, sf):
    wanted = resource_keys(spark, sf)
    moments = cloudtrail(spark, sf).select("alert_id", micros("received_at").alias("at"))
    rows = materialise(wanted.join(moments, "alert_id"), "targets")
    return resources.looked_up(rows, stored_resources(spark, sf)).select(
        "alert_id", "place", "event_name", "resource_key", "payload"
    )


@register(
    "inspected_map",
    query(
        """SELECT alert_id, resource_key, max_by(payload, place) AS payload FROM found_writes WHERE missing IS NULL GROUP BY 1, 2""",
        "found_writes", swap={"history": WHOLE_HISTORY},
    ),
)
def inspected_map(spark, sf):
    """The objects of all writes of an alert's look-back, however many events there are."""
    rows = resources.with_inspection(
        with_writes(spark, sf, None).select("alert_id", "received_at", "writes"), stored_resources(spark, sf)
    )
    return rows.select("alert_id", F.explode("inspected_objects").alias("resource_key", "payload"))


@register("alert_errors", query("SELECT alert_id, enricher, error, type FROM errors", "errors"))
def alert_errors(spark, sf):
    """The error list of each alert, one row per error."""
    books = [runbooks.cloudtrail(I.frame(spark, sf, "audit"), stored_resources(spark, sf), CHECK_SETTINGS, False)]
    rows = runbooks.enrich_all(routed(spark, sf), books, F.col("received_at"))
    return rows.select("alert.alert_id", F.explode("enricher_errors").alias("e")).select("alert_id", "e.*")


@register(
    "enricher_errors", query("SELECT enricher, type, count(*) AS value FROM errors GROUP BY 1, 2", "errors")
)
def enricher_errors(spark, sf):
    rows = alert_errors(spark, sf).select(F.array(F.struct("enricher", "error", "type")).alias("enricher_errors"))
    return metrics.enricher_errors(rows)


@register(
    "cached_history",
    query(
        """SELECT alert_id, hit, served_by, place, event_id FROM (
 SELECT r.lookup_id AS alert_id, r.hit, r.served_by, h.place, h.eid AS event_id FROM r LEFT JOIN history h ON h.alert_id = r.served_by)""",
        "eligible", "history",
        extra=PRINCIPAL_LOOKUPS + ", " + ttl_chain("pl"),
    ),
)
def cached_history(spark, sf):
    slim = materialise(identified(spark, sf).select("alert_id", "received_at", "principal", "eligible"), "identified")
    served, found = history.lookups(
        slim, I.frame(spark, sf, "audit"), CHECK_SETTINGS.cache_ttl_seconds, LOOKBACK_MINUTES, MAX_RESULTS
    )
    # The ids of a look-up go to the alerts that it serves; its texts stay where they are.
    ids = found.select("anchor_id", F.posexplode_outer("events").alias("i", "item")).select("anchor_id", "i", "item.event_id")
    return served.join(ids, "anchor_id", "left").select(
        "alert_id", F.col("cache_hit").alias("hit"), F.col("anchor_id").alias("served_by"),
        (F.col("i") + 1).cast("bigint").alias("place"), "event_id",
    )


@register(
    "route_without_runbook",
    query(
        f"""SELECT c.name, c.queue, count(r.event_id) AS waiting FROM {CATALOG} LEFT JOIN routed r ON r.route = c.name
 WHERE c.queue NOT IN (SELECT source_queue FROM {RUNBOOKS}) GROUP BY 1, 2""",
        "routed",
    ),
)
def route_without_runbook(spark, sf):
    """Routes nobody serves, with the alerts that wait there."""
    served = runbooks.runbook_table(spark)
    gap = route_catalog(spark, sf).join(F.broadcast(served), F.col("queue") == F.col("source_queue"), "left_anti")
    return gap.select("name", "queue", F.col("alerts").alias("waiting"))


PERFORMANCE = """SELECT name AS runbook, CAST(sum(CASE WHEN bucket = 'runbook_success' THEN value ELSE 0 END) AS BIGINT) AS success,
 CAST(sum(CASE WHEN bucket = 'runbook_error' THEN value ELSE 0 END) AS BIGINT) AS errors FROM counters
 WHERE bucket IN ('runbook_success', 'runbook_error') GROUP BY 1"""


@register("runbook_performance", query(PERFORMANCE, "counters"))
def runbook_performance(spark, sf):
    return metrics.runbook_performance(counted(spark, sf)).select("runbook", "success", "errors")


@register("runbooks_sorted", query(f"SELECT runbook FROM ({PERFORMANCE}) ORDER BY runbook", "counters"))
def runbooks_sorted(spark, sf):
    return metrics.runbook_performance(counted(spark, sf)).select("runbook")


@register("runbook_names", query("SELECT DISTINCT name AS runbook FROM counters WHERE bucket LIKE 'runbook%'", "counters"))
def runbook_names(spark, sf):
    names = counted(spark, sf)
    success = names.filter(F.col("bucket") == "runbook_success").select(F.col("name").alias("runbook"))
    errors = names.filter(F.col("bucket") == "runbook_error").select(F.col("name").alias("runbook"))
    return success.union(errors).distinct()


@register(
    "runbook_error_rate",
    query(
        f"""SELECT runbook, CASE WHEN success + errors > 0 THEN round(errors * 100.0 / (success + errors), 1) ELSE 0.0 END AS error_rate,
 CASE WHEN errors = 0 THEN 'green' ELSE 'red' END AS badge FROM ({PERFORMANCE})""",
        "counters",
    ),
)
def runbook_error_rate(spark, sf):
    return metrics.runbook_performance(counted(spark, sf)).select("runbook", "error_rate", "badge")


OVERVIEW_SQL = """SELECT t.*, coalesce(l.live, t0.dlq) AS dlq_count, l.metrics_queue_depth, l.queue_count FROM
 (SELECT CAST(sum(CASE WHEN bucket = 'alert_ingested' THEN value ELSE 0 END) AS BIGINT) AS total_ingested,
  CAST(sum(CASE WHEN bucket = 'runbook_success' THEN value ELSE 0 END) AS BIGINT) AS total_processed,
  CAST(sum(CASE WHEN bucket = 'runbook_error' THEN value ELSE 0 END) AS BIGINT) AS total_errors FROM counters) t,
 (SELECT CAST(sum(value) AS BIGINT) AS dlq FROM counters WHERE bucket = 'dlq_counts') t0,
 (SELECT max(CASE WHEN name = '{dlq}' THEN messages END) AS live, coalesce(max(CASE WHEN name = 'alerts.metrics' THEN messages END), 0) AS metrics_queue_depth,
  count(*) AS queue_count FROM latest) l"""


@register("overview", query(OVERVIEW_SQL.format(dlq="alerts.dlq"), "counters", "latest"))
def overview(spark, sf):
    return metrics.overview(
        counted(spark, sf), metrics.latest_snapshot(snapshots(spark, sf)), S.QUEUE_DLQ, S.QUEUE_METRICS
    )


@register(
    "overview_dlq",
    "SELECT 'live' AS basis, dlq_count FROM (" + query(OVERVIEW_SQL.format(dlq="alerts.dlq"), "counters", "latest")
    + ") UNION ALL SELECT 'counter', dlq_count FROM (" + query(OVERVIEW_SQL.format(dlq="none"), "counters", "latest") + ")",
)
def overview_dlq(spark, sf):
    """Once with the dead-letter queue listed, once under a name no snapshot has."""
    both = [
        metrics.overview(counted(spark, sf), metrics.latest_snapshot(snapshots(spark, sf)), name, S.QUEUE_METRICS).select(
            F.lit(basis).alias("basis"), "dlq_count"
        )
        for basis, name in (("live", S.QUEUE_DLQ), ("counter", "none"))
    ]
    return both[0].unionByName(both[1])


# ---------------------------------------------------------------- aggregates


def _bucket(name: str, event: str, bucket: str, label: str) -> None:
    @register(name, query(f"SELECT name AS {label}, value FROM counters WHERE bucket = '{bucket}'", "counters"))
    def run(spark, sf):
        return metrics.one_counter(metric_rows(spark, sf), event, label)


_bucket("ingested_by_source", "alert_ingested", "alert_ingested", "source")
_bucket("routed_by_route", "route_matched", "route_counts", "route")
_bucket("dlq_by_reason", "dlq_enqueued", "dlq_counts", "reason")
_bucket("runbook_success", "runbook_success", "runbook_success", "runbook")
_bucket("runbook_error", "runbook_error", "runbook_error", "runbook")


@register("counters_all", query("SELECT bucket, name, value FROM counters", "counters"))
def counters_all(spark, sf):
    return counted(spark, sf)


@register(
    "source_share",
    query(
        "SELECT name AS source, value, round(CAST(value AS DOUBLE) / sum(value) OVER (), 4) AS share FROM counters WHERE bucket = 'alert_ingested'",
        "counters",
    ),
)
def source_share(spark, sf):
    return metrics.source_share(counted(spark, sf))


@register(
    "ingest_balance",
    query(
        """SELECT *, ingested - processed - dead_letters AS in_flight FROM (
 SELECT CAST(sum(CASE WHEN bucket = 'alert_ingested' THEN value ELSE 0 END) AS BIGINT) AS ingested,
 CAST(sum(CASE WHEN bucket = 'runbook_success' THEN value ELSE 0 END) AS BIGINT) AS processed,
 CAST(sum(CASE WHEN bucket = 'dlq_counts' THEN value ELSE 0 END) AS BIGINT) AS dead_letters FROM counters)""",
        "counters",
    ),
)
def ingest_balance(spark, sf):
    return metrics.ingest_balance(counted(spark, sf))


@register(
    "dlq_reasons_ranked",
    query("SELECT name AS reason, value FROM counters WHERE bucket = 'dlq_counts' ORDER BY value DESC, reason", "counters"),
)
def dlq_reasons_ranked(spark, sf):
    return metrics.dlq_reasons_ranked(counted(spark, sf))


@register(
    "queue_backlog",
    query(
        """SELECT name, messages, consumers, CASE WHEN messages >= 20 AND consumers = 0 THEN 'consumer_down' WHEN messages >= 20 THEN 'falling_behind'
 WHEN consumers = 0 THEN 'no_consumer' ELSE 'ok' END AS diagnosis FROM latest""",
        "latest",
    ),
)
def queue_backlog(spark, sf):
    return metrics.queue_backlog(snapshots(spark, sf), 20)


@register(
    "latest_snapshot",
    query(f"SELECT epoch_us(polled_at) AS polled_us, {', '.join(SNAPSHOT_COLUMNS)} FROM latest", "latest"),
)
def latest_snapshot(spark, sf):
    return metrics.latest_snapshot(snapshots(spark, sf)).select(micros("polled_at").alias("polled_us"), *SNAPSHOT_COLUMNS)


@register(
    "enricher_duration",
    query(
        """SELECT enricher, count(*) AS runs, avg(duration_ms) AS avg_ms, quantile_disc(duration_ms, 0.5) AS p50_ms,
 quantile_disc(duration_ms, 0.95) AS p95_ms, max(duration_ms) AS max_ms FROM runs GROUP BY 1""",
        "runs",
    ),
)
def enricher_duration(spark, sf):
    return metrics.enricher_duration(I.frame(spark, sf, "runs"))


@register(
    "pipeline_incomplete",
    query("SELECT runbook, count(*) AS runs, count(*) FILTER (WHERE stages_completed < 3) AS incomplete FROM runs GROUP BY 1", "runs"),
)
def pipeline_incomplete(spark, sf):
    return metrics.pipeline_incomplete(I.frame(spark, sf, "runs"))


@register(
    "cache_hit_proxy",
    query(
        """SELECT count(*) AS runs, count(*) FILTER (WHERE duration_ms < 5) AS likely_hits, count(*) FILTER (WHERE duration_ms > 50) AS likely_misses
 FROM runs WHERE enricher = 'principal_history'""",
        "runs",
    ),
)
def cache_hit_proxy(spark, sf):
    return metrics.cache_hit_proxy(I.frame(spark, sf, "runs"))


@register(
    "enrichment_latency",
    query(
        """SELECT runbook, count(*) AS alerts, min(d) AS min_micros, max(d) AS max_micros, CAST(sum(d) AS BIGINT) AS sum_micros
 FROM (SELECT runbook, epoch_us(enriched_at) - epoch_us(received_at) AS d FROM stored) GROUP BY 1""",
        "stored",
    ),
)
def enrichment_latency(spark, sf):
    return metrics.enrichment_latency(stored_rows(spark, sf))


# ---------------------------------------------------------------- cache replay and windows

NOW_MICROS = 1706659200000000  # 2024-01-31


@register(
    "ttl_replay",
    query("SELECT lookup_id, key, hit, served_by FROM r", "lookups", extra=ttl_chain("lookups")),
)
def ttl_replay(spark, sf):
    return ttl.replay(lookups(spark, sf), DAY).select("lookup_id", "key", "hit", "served_by")


@register(
    "cache_stats",
    query(
        f"""SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses,
 count(*) FILTER (WHERE NOT hit AND lookup_ok AND moment + {DAY} > {NOW_MICROS}) AS size FROM r""",
        "lookups",
        extra=ttl_chain("lookups"),
    ),
)
def cache_stats(spark, sf):
    return metrics.cache_stats(ttl.replay(lookups(spark, sf), DAY), DAY, F.lit(NOW_MICROS))


@register(
    "stats_every_n",
    query(
        """SELECT runbook, lookup_id, position, hits, position - hits AS misses FROM (
 SELECT runbook, lookup_id, row_number() OVER w AS position, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS BIGINT) AS hits
 FROM (SELECT l.runbook, l.lookup_id, l.ts, r.hit FROM lookups l JOIN r ON r.lookup_id = l.lookup_id)
 WINDOW w AS (PARTITION BY runbook ORDER BY ts, lookup_id ROWS UNBOUNDED PRECEDING)) WHERE position % 50 = 0""",
        "lookups",
        extra=ttl_chain("lookups"),
    ),
)
def stats_every_n(spark, sf):
    return replay_stats(spark, sf).select("runbook", F.col("alert_id").alias("lookup_id"), "position", "hits", "misses")


def replay_stats(spark: SparkSession, sf: str) -> DataFrame:
    processed = ttl.replay(lookups(spark, sf), DAY).withColumnRenamed("lookup_id", "alert_id")
    return metrics.stats_every_n(processed, 50)


@register(
    "batch_number",
    query(
        """SELECT alert_id, target, day, position, CAST(floor((position - 1) / 50.0) AS BIGINT) AS batch FROM (SELECT alert_id, destination AS target, day,
  row_number() OVER (PARTITION BY destination, day ORDER BY enriched_at, alert_id) AS position
 FROM (SELECT alert_id, destination, enriched_at, epoch_us(date_trunc('day', enriched_at)) AS day FROM stored))""",
        "stored",
    ),
)
def batch_number(spark, sf):
    rows = stored_rows(spark, sf).select(
        "alert.alert_id", F.col("destination").alias("target"), "enriched_at",
        F.unix_micros(F.date_trunc("day", "enriched_at")).alias("day"),
    )
    numbered = delivery.numbered_batches(rows, ["target", "day"], ["enriched_at", "alert_id"], 50)
    return numbered.select("alert_id", "target", "day", "position", "batch")


# ---------------------------------------------------------------- streams


STREAM_BATCHES = 4
#: Rows of a file of a batch, about. A file this small is one row group, which one task reads.
STREAM_FILE_ROWS = 50_000


def event_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Frame ``name`` over the events as a stream of batches by ``event_id`` modulo their number, in that order.

    Each has rows from the whole span of time. A batch is as many files as its rows need, so that its tasks grow with the table.
    """
    path = fresh_path(spark, f"stream-{name}")
    events = I.events(spark, sf)
    part = F.col("event_id") % STREAM_BATCHES
    sizes = {r["part"]: r["rows"] for r in events.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    rows = [sizes.get(i, 0) for i in range(STREAM_BATCHES)]
    files = max(1, min(rows) // STREAM_FILE_ROWS)
    for i in range(STREAM_BATCHES):
        # Files are read in the order in which they were written. Every batch has the same number of files, none of them empty.
        mine = events.filter(part == i)
        (mine.repartition(files) if files > 1 else mine.coalesce(1)).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)
    return I.from_events(stream, name)


def _paths(spark: SparkSession, label: str, *names: str) -> list[str]:
    base = fresh_path(spark, label)
    return [f"{base}/{n}" for n in names]


def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.compute(event_stream(spark, sf, "alerts"), payload=P.parse(F.col("raw_payload")))
    return rows.filter(P.is_object(F.col("payload")))


@register("stream_ingest", KAFKA_SQL)
def stream_ingest(spark, sf):
    out, ckpt = _paths(spark, "ingest", "out", "ckpt")
    messages = event_stream(spark, sf, "alerts").selectExpr(*I.KAFKA)
    jobs.ingest(messages, lambda m: normalise.kafka(m, F.col("timestamp")), out, ckpt).awaitTermination()
    return kafka_columns(normalise.alerts(spark.read.parquet(out)))


@register(
    "stream_route", query("SELECT alert_id, coalesce(queue, 'alerts.dlq') AS queue, route FROM routed", "routed")
)
def stream_route(spark, sf):
    out, ckpt = _paths(spark, "route", "out", "ckpt")
    jobs.route(stream_alerts(spark, sf), out, ckpt).awaitTermination()
    return spark.read.parquet(out).select("alert_id", "queue", "route")


@register(
    "stream_enrich",
    query(
        """SELECT w.alert_id, nid AS principal, coalesce(h.n, 0) AS recent FROM eligible w
 LEFT JOIN (SELECT alert_id, count(*) AS n FROM history GROUP BY 1) h ON h.alert_id = w.alert_id WHERE w.nid IS NOT NULL
UNION ALL SELECT alert_id, NULL, NULL FROM eligible WHERE nid IS NULL
UNION ALL SELECT alert_id, NULL, NULL FROM routed WHERE route IN ('cloud.gcp.event_audit', 'test')""",
        "eligible", "history", "routed",
    ),
)
def stream_enrich(spark, sf):
    out, ckpt = _paths(spark, "enrich", "out", "ckpt")
    books = runbooks.default_runbooks(I.frame(spark, sf, "audit"), stored_resources(spark, sf), CHECK_SETTINGS, False)
    stream = routing.matched(routing.route_alerts(stream_alerts(spark, sf)))
    jobs.enrich(stream, books, out, ckpt, F.col("received_at")).awaitTermination()
    rows = P.compute(spark.read.parquet(out), _x=P.parse(F.col("extracted")))
    x = F.col("_x")
    recent = F.size(F.try_variant_get(x, "$.cloudtrail.principal_recent_events", "array<variant>")).cast("bigint")
    return rows.select(
        "alert.alert_id", P.string_at(x, "$.principal.normalized_id").alias("principal"),
        F.when(P.field(x, "$.cloudtrail.principal_recent_events").isNotNull(), recent).alias("recent"),
    )


@register("stream_history", HISTORY_SQL)
def stream_history(spark, sf):
    """Recent events of the alerts' actors, alerts and events both as streams whose files span the whole time."""
    out, ckpt = _paths(spark, "history", "out", "ckpt")
    stream = routing.route_alerts(stream_alerts(spark, sf)).filter(F.col("route") == "cloud.aws.cloudtrail")
    who = history.eligibility(history.identify(stream)).filter("eligible")
    asked = who.select("alert_id", identity.lookup_username(F.col("principal")).alias("username"), "received_at")
    jobs.recent_events(
        asked, event_stream(spark, sf, "audit"), out, ckpt, LOOKBACK_MINUTES, MAX_RESULTS, delay_seconds=40 * 86400
    ).awaitTermination()
    found = jobs.answered(spark, out).select("alert_id", F.posexplode("event_ids").alias("i", "event_id"))
    return found.select("alert_id", "event_id", (F.col("i") + 1).cast("bigint").alias("place"))


@register("stream_counters", query("SELECT bucket, name, value FROM counters", "counters"))
def stream_counters(spark, sf):
    out, ckpt = _paths(spark, "counters", "out", "ckpt")
    rows = stored.metric_events(event_stream(spark, sf, "metrics")).filter("valid")
    # Folded every other batch, so the result comes from a snapshot and a tail.
    jobs.count(rows, out, ckpt, fold_every=2).awaitTermination()
    return jobs.counter_log(spark, out).read().select("bucket", "name", "value")


@register(
    "stream_ttl",
    query("SELECT CAST(lookup_id AS STRING) AS lookup_id, key, hit, CAST(served_by AS STRING) AS served_by FROM r", "lookups", extra=ttl_chain("lookups")),
)
def stream_ttl(spark, sf):
    """The files come in any order, so rows up to the whole span of the table behind the newest may be overtaken."""
    out, ckpt = _paths(spark, "ttl", "out", "ckpt")
    rows = event_stream(spark, sf, "lookups").select(
        "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "lookup_id", "lookup_ok"
    )
    for query_ in jobs.replay_ttl(rows, DAY, out, ckpt, delay_seconds=40 * 86400):
        query_.awaitTermination()
    return jobs.replayed_ttl(spark, out, DAY).select("lookup_id", "key", "hit", "served_by")


@register("stream_dedup", query(f"SELECT DISTINCT alert_id FROM ({SPLUNK_SQL})", "splunk_reasons"))
def stream_dedup(spark, sf):
    """The search rows read twice, as after a restart, kept once."""
    out, ckpt = _paths(spark, "dedup", "out", "ckpt")
    once, again = (
        normalise.alerts(normalise.splunk(event_stream(spark, sf, "splunk"), I.SEARCH, F.col("ts"))) for _ in range(2)
    )
    jobs.to_table(jobs.drop_repeats(once.unionByName(again), "60 days"), out, ckpt).awaitTermination()
    return spark.read.parquet(out).select("alert_id")


@register(
    "stream_delivery",
    query(
        """SELECT 'payload' AS outcome, destination AS target, count(*) AS events FROM stored WHERE destination = 'splunk' GROUP BY 2
UNION ALL SELECT 'undelivered', destination, count(*) FROM stored WHERE destination = 'universal' GROUP BY 2""",
        "stored",
    ),
)
def stream_delivery(spark, sf):
    """Without a universal client: those rows end up in the undelivered table."""
    out, undelivered, ckpt = _paths(spark, "delivery", "out", "undelivered", "ckpt")
    rows = routing.matched(routing.route_alerts(stream_alerts(spark, sf)))
    enriched = rows.select(
        F.struct(*queues.STORED_ALERT).alias("alert"), F.col("route").alias("runbook"),
        F.col("received_at").alias("enriched_at"), F.lit("{}").alias("extracted"),
        F.lit(None).cast("string").alias("runbook_error"),
        F.when(F.col("event_id") % 4 == 0, "universal").otherwise("splunk").alias("destination"),
    )
    jobs.deliver(enriched, out, undelivered, ckpt, universal_configured=False).awaitTermination()
    sent = spark.read.parquet(out).groupBy("target").agg(F.sum("events").alias("events"))
    failed = spark.read.parquet(undelivered).groupBy("target").agg(F.count(F.lit(1)).alias("events"))
    return sent.select(F.lit("payload").alias("outcome"), "target", "events").unionByName(
        failed.select(F.lit("undelivered").alias("outcome"), "target", "events")
    )


@register(
    "stream_destinations",
    query(
        """SELECT part, batch, count(*) AS events, CASE WHEN count(*) = 50 THEN 'delivered' ELSE 'permanent_error' END AS outcome,
 CASE WHEN count(*) = 50 THEN 202 ELSE 400 END AS last_status FROM (SELECT event_id % 4 AS part,
  CAST(floor((row_number() OVER (PARTITION BY event_id % 4 ORDER BY alert_id) - 1) / 50.0) AS BIGINT) AS batch
 FROM routed WHERE route IS NOT NULL AND user_mark) GROUP BY 1, 2""".replace("user_mark", "event_id % 3 = 0"),
        "routed",
    ),
)
def stream_destinations(spark, sf):
    """A destination of the caller's own that takes full payloads only; what became of each payload of each micro-batch."""
    out, ckpt = _paths(spark, "destinations", "out", "ckpt")
    rows = routing.matched(routing.route_alerts(stream_alerts(spark, sf)))
    enriched = rows.select(
        F.struct(*queues.STORED_ALERT).alias("alert"), F.col("route").alias("runbook"),
        F.col("received_at").alias("enriched_at"), F.lit("{}").alias("extracted"),
        F.lit(None).cast("string").alias("runbook_error"),
        F.when(F.col("event_id") % 3 == 0, "archive").otherwise("splunk").alias("destination"),
    )
    archive = sending.Destination("archive", lambda text, _: 202 if text.count("\n") == 49 else 400)
    sending.deliver_to(enriched, [archive], out, ckpt).awaitTermination()
    sent = spark.read.parquet(f"{out}/outcomes")
    return sent.select(F.col("batch_id").cast("bigint").alias("part"), "batch", "events", "outcome", "last_status")


@register(
    "stream_windowed_rates",
    query(
        """SELECT epoch_us(date_trunc('minute', received_at)) AS window_us, queue, count(*) AS alerts, count(*) / 60.0 AS rate
 FROM routed WHERE queue IS NOT NULL GROUP BY 1, 2""",
        "routed",
    ),
)
def stream_windowed_rates(spark, sf):
    """With a delay of ten minutes most rows of the files are late, and all are counted."""
    out, ckpt = _paths(spark, "rates", "out", "ckpt")
    jobs.rates(routing.route_alerts(stream_alerts(spark, sf)), out, ckpt, 600, fold_every=3).awaitTermination()
    return jobs.current_rates(spark, out).select(micros("window_start").alias("window_us"), "queue", "alerts", "rate")


@register(
    "stream_late_alerts",
    query(
        """SELECT alert_id, queue FROM (SELECT *, max(received_at) FILTER (WHERE true) OVER (ORDER BY event_id % 4 RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
 FROM routed WHERE queue IS NOT NULL) WHERE received_at < before - INTERVAL 10 MINUTE""",
        "routed",
    ),
)
def stream_late_alerts(spark, sf):
    """The alerts that came late, listed beside the windows that count them; files are read by event_id modulo four."""
    out, ckpt = _paths(spark, "late", "out", "ckpt")
    jobs.rates(routing.route_alerts(stream_alerts(spark, sf)), out, ckpt, 600).awaitTermination()
    return spark.read.parquet(f"{out}/late").select("alert_id", "queue")
