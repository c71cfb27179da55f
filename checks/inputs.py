"""Input frames for the registered queries, derived from the ``events`` table.

Each frame is a list of SQL expressions over ``events`` that Spark and DuckDB read alike, so the query and its
check start from the same text. Times are microseconds in UTC; no floating-point number is ever printed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.session import configure, dealt
from alertweave.settings import DEFAULTS

SEARCH = "search index=notable"
ACCOUNT = "123456789012"


def s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


EID = s("event_id")
USER = cat("'u'", s("user_id"))

EVENT_NAME = (
    "CASE event_type WHEN 'view' THEN 'GetObject' WHEN 'click' THEN 'RunInstances' WHEN 'signup' THEN 'CreateUser'"
    " WHEN 'purchase' THEN 'PutObject' ELSE 'ConsoleLogin' END"
)
SERVICE = (
    "CASE event_type WHEN 'view' THEN 's3' WHEN 'click' THEN 'ec2' WHEN 'signup' THEN 'iam' WHEN 'purchase' THEN 's3'"
    " ELSE 'signin' END"
)

# What the call was about, as a fragment after the event name.
TARGET = f"""CASE event_type
 WHEN 'purchase' THEN {cat(lit(',"requestParameters":{"bucketName":"b'), s('user_id % 10'), lit('"'),
    f"CASE WHEN event_id % 13 = 0 THEN '' ELSE {cat(lit(',"key":"k'), s('event_id % 100'), lit('"'))} END", lit('}'))}
 WHEN 'signup' THEN {cat(lit(',"requestParameters":{"userName":"u'), s('user_id'), lit('"}'))}
 WHEN 'click' THEN {cat(lit(',"responseElements":{"instancesSet":{"items":[{"instanceId":"i-'), EID, lit('"}'),
    f"CASE WHEN event_id % 3 = 0 THEN {cat(lit(',{"instanceId":"j-'), EID, lit('"}'))} ELSE '' END", lit(']}}'))}
 ELSE '' END"""


def _identity(kind: str, body: str) -> str:
    return cat(lit('{"type":"' + kind + '"'), body, lit("}"))


_ACC = lit(f',"accountId":"{ACCOUNT}"')
_ARN = f'"arn:aws:iam::{ACCOUNT}:'
_STS = f'"arn:aws:sts::{ACCOUNT}:'

IDENTITY = f"""CASE event_id % 8
 WHEN 0 THEN {_identity('IAMUser', cat(lit(',"arn":' + _ARN + 'user/'), USER, lit('","userName":"'), USER, lit('"'), _ACC))}
 WHEN 1 THEN {_identity('AssumedRole', cat(lit(',"arn":' + _STS + 'assumed-role/'), USER, lit('/s'), EID,
    lit('","sessionContext":{"sessionIssuer":{"arn":' + _ARN + 'role/'), USER, lit('","userName":"'), USER, lit('"}}')))}
 WHEN 2 THEN {_identity('AssumedRole', cat(lit(',"arn":' + _STS + 'assumed-role/'), USER, lit('/s'), EID, lit('"')))}
 WHEN 3 THEN {_identity('Root', lit(',"arn":' + _ARN + 'root"'))}
 WHEN 4 THEN {_identity('AWSService', lit(',"invokedBy":"EC2.amazonaws.com"'))}
 WHEN 5 THEN {_identity('FederatedUser', cat(lit(',"arn":' + _STS + 'federated-user/path/'), USER, lit('"')))}
 WHEN 6 THEN {_identity('IAMUser', cat(lit(',"userName":"'), USER, lit('"')))}
 ELSE {_identity('IAMUser', cat(lit(',"arn":' + _ARN + 'user/team/'), USER, lit('"')))} END"""

USER_IDENTITY = f"""CASE WHEN event_id % 41 = 0 THEN ',"userIdentity":null' WHEN event_id % 43 = 0 THEN ''
 WHEN event_id % 47 = 0 THEN ',"userIdentity":"x"' ELSE {cat(lit(',"userIdentity":'), IDENTITY)} END"""

REGION = """CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"awsRegion":"us-east-1"' END"""
ADDRESS = f"""CASE WHEN event_id % 7 = 0 THEN ',"sourceIPAddress":null' ELSE
 {cat(lit(',"sourceIPAddress":"10.0.0.'), s('event_id % 250'), lit('"'))} END"""

GCP = cat(
    lit('{"protoPayload":{"@type":"type.googleapis.com/google.cloud.audit.AuditLog","methodName":"'),
    "event_type",
    lit('"'),
    """CASE WHEN event_id % 4 = 3 THEN ',"serviceName":null' ELSE ',"serviceName":"storage.googleapis.com"' END""",
    f"""CASE WHEN event_id % 3 = 0 THEN '' ELSE {cat(lit(',"authenticationInfo":{"principalEmail":"'), USER,
        lit('@example.com"}'))} END""",
    lit("}"),
    f"""CASE WHEN event_id % 9 = 0 THEN ',"resource":"none"' ELSE
    {cat(lit(',"resource":{"labels":{"project_id":"p'), s('user_id % 5'), lit('"}}'))} END""",
    lit("}"),
)

FLAG = DEFAULTS.test_flag

PAYLOAD = f"""CASE
 WHEN event_id % 10 <= 4 THEN {cat(lit('{"eventVersion":"1.08","eventSource":"'), SERVICE, lit('.amazonaws.com","eventName":"'),
    EVENT_NAME, lit('"'), USER_IDENTITY, REGION, ADDRESS, TARGET, lit('}'))}
 WHEN event_id % 10 = 5 THEN {cat(lit('{"schemaVersion":"2.0","type":"'), 'event_type', lit(':EC2/Tor"}'))}
 WHEN event_id % 10 = 6 THEN '{{"apiVersion":"audit.k8s.io/v1","kind":"Event"}}'
 WHEN event_id % 10 = 7 THEN {GCP}
 WHEN event_id % 10 = 8 THEN CASE WHEN event_id % 20 = 8 THEN '{{"{FLAG}":true}}' ELSE '{{"{FLAG}":"true"}}' END
 WHEN event_id % 30 = 9 THEN '{{"schemaVersion":"2.0","type":42}}'
 WHEN event_id % 30 = 19 THEN 'not json'
 ELSE '[1,2]' END"""

READ_ONLY = "CASE WHEN event_type IN ('view', 'error') THEN 'true' ELSE 'false' END"
AUDIT_TEXT = f"""CASE WHEN event_id % 50 = 49 THEN 'not json' ELSE {cat(lit('{"eventSource":"'), SERVICE,
    lit('.amazonaws.com","eventName":"'), EVENT_NAME, lit('","readOnly":'), READ_ONLY,
    '''CASE WHEN event_id % 7 = 0 THEN ',"errorCode":"AccessDenied"' WHEN event_id % 7 = 1 THEN ',"errorCode":null' ELSE '' END''',
    TARGET, lit('}'))} END"""

RESOURCE_KEY = f"""CASE event_type
 WHEN 'purchase' THEN {cat("'s3:object:b'", s('user_id % 10'), "'/k'", s('event_id % 100'))}
 WHEN 'signup' THEN {cat("'iam:user:u'", s('user_id'))}
 WHEN 'click' THEN {cat("'ec2:instance:i-'", EID)}
 ELSE {cat("'other:'", EID)} END"""

# Fixed choice of the fixture: one name or instance in ten is unknown to the resource table.
UNKNOWN_RESOURCE = "(event_type = 'click' AND event_id % 10 = 0) OR (event_type = 'signup' AND user_id % 10 = 3)"

SQS_BODY = f"""CASE WHEN event_id % 2 = 0 THEN {PAYLOAD}
 WHEN event_id % 21 = 5 THEN '{{"Type":"Notification","Message":null,"Subject":"none"}}'
 WHEN event_id % 15 = 1 THEN {cat(lit('{"Type":"Notification","Message":"plain text '), EID, lit('"}'))}
 WHEN event_id % 15 = 7 THEN {cat(lit('{"Type":"Notification","Subject":"no message","n":'), EID, lit('}'))}
 ELSE {cat(lit('{"Type":"Notification","TopicArn":"arn:t'), s('event_id % 3'), lit('","Subject":"alert","Message":"'),
    f"replace({PAYLOAD}, '\"', {chr(39)}__BS__\"{chr(39)})", lit('"}'))} END"""

UNIVERSAL_BODY = f"""CASE
 WHEN event_id % 23 = 0 THEN '{{"metadata":{{}}}}'
 WHEN event_id % 29 = 0 THEN '{{"raw_payload":[1]}}'
 WHEN event_id % 31 = 0 THEN '{{"raw_payload":{{"a":1}},"metadata":7}}'
 WHEN event_id % 37 = 0 THEN '{{"raw_payload":{{"a":1}},"source":5}}'
 WHEN event_id % 41 = 0 THEN 'broken'
 ELSE {cat(lit('{"raw_payload":{"b":"'), 'event_type', lit('","a":'), EID, lit('}'),
    f'''CASE WHEN event_id % 3 = 0 THEN '' ELSE {cat(lit(',"metadata":{"team":"t'), s('event_id % 4'), lit('","remote_addr":"0.0.0.0"}'))} END''',
    f'''CASE WHEN event_id % 4 = 0 THEN '' ELSE {cat(lit(',"source":"hook'), s('event_id % 3'), lit('"'))} END''', lit('}'))} END"""

SPLUNK_ROW = f"""CASE WHEN event_id % 53 = 0 THEN '"INFO message"' ELSE
 {cat(lit('{"_time":"'), "__TS__", lit('","host":"h'), s('user_id % 20'), lit('","rule_name":"'), 'event_type', lit('"'),
    '''CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"sourcetype":"notable"' END''', lit('}'))} END"""

METRIC_TEXT = f"""CASE
 WHEN event_id % 12 <= 3 THEN {cat(lit('{"event":"alert_ingested","ts":"2024-01-01T00:00:00+00:00","data":{"source":"'), 'event_type', lit('"}}'))}
 WHEN event_id % 12 <= 5 THEN {cat(lit('{"event":"route_matched","data":{"route":"r'), s('user_id % 5'), lit('"}}'))}
 WHEN event_id % 12 = 6 THEN CASE WHEN event_id % 5 = 0 THEN '{{"event":"dlq_enqueued","data":{{"reason":"publish_failed"}}}}'
   ELSE '{{"event":"dlq_enqueued","data":{{"reason":"no_route_matched"}}}}' END
 WHEN event_id % 12 <= 8 THEN {cat(lit('{"event":"runbook_success","data":{"runbook":"rb'), s('user_id % 4'), lit('"}}'))}
 WHEN event_id % 12 = 9 THEN {cat(lit('{"event":"runbook_error","data":{"runbook":"rb'), s('user_id % 3'), lit('","error":"x"}}'))}
 WHEN event_id % 12 = 10 THEN '{{"event":"heartbeat","data":{{"source":"none"}}}}'
 WHEN event_id % 36 = 11 THEN '{{"event":"alert_ingested","data":null}}'
 WHEN event_id % 36 = 23 THEN '{{"data":{{"source":"lost"}}}}'
 ELSE CASE WHEN event_id % 72 = 35 THEN 'broken' ELSE '{{"event":"alert_ingested","data":{{"source":null}}}}' END END"""

QUEUE_NAME = (
    "CASE event_id % 9 WHEN 0 THEN 'alerts' WHEN 1 THEN 'runbook.cloudtrail' WHEN 2 THEN 'runbook.guardduty'"
    " WHEN 3 THEN 'runbook.eks' WHEN 4 THEN 'runbook.gcp.event_audit' WHEN 5 THEN 'runbook.test'"
    " WHEN 6 THEN 'enriched' WHEN 7 THEN 'alerts.dlq' ELSE 'alerts.metrics' END"
)
QUEUE_REPLY = f"""CASE WHEN event_id % 19 = 0 THEN '{{"error":"down"}}' ELSE {cat(lit('[{"name":"'), QUEUE_NAME, lit('","messages":'),
    s('event_id % 40'), lit(',"consumers":'), s('event_id % 3'),
    '''CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"messages_ready":3,"state":"running"' END''',
    f'''CASE WHEN event_id % 4 = 0 THEN '' ELSE {cat(lit(',"message_stats":{"publish_details":{"rate":'), s('event_id % 7'), lit('.25}'),
        f"CASE WHEN event_id % 3 = 0 THEN '' ELSE {cat(lit(',"deliver_get_details":{"rate":'), s('event_id % 11'), lit('.5}'))} END", lit('}'))} END''',
    lit('}]'))} END"""

ENRICHER = (
    "CASE event_id % 4 WHEN 0 THEN 'principal_identity' WHEN 1 THEN 'principal_history' WHEN 2 THEN 'write_filter'"
    " ELSE 'object_inspection' END"
)
RUNBOOK = "CASE event_id % 3 WHEN 0 THEN 'cloud.aws.cloudtrail' WHEN 1 THEN 'cloud.gcp.event_audit' ELSE 'test' END"
STATUS = (
    "CASE event_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 0 WHEN 4 THEN 404 WHEN 5 THEN 200"
    " ELSE 201 END"
)

# Frame name -> (expression, alias). ``__TS__`` and ``__BS__`` are filled in per engine.
FRAMES: dict[str, list[tuple[str, str]]] = {
    "alerts": [
        ("event_id", "event_id"),
        (cat("'a'", EID), "alert_id"),
        ("'kafka'", "source"),
        ("CAST(ts AS TIMESTAMP)", "received_at"),
        (PAYLOAD, "raw_payload"),
        ("'{}'", "metadata"),
        (USER, "username"),
    ],
    "identities": [("event_id", "event_id"), (IDENTITY, "identity")],
    "audit": [
        (USER, "username"),
        ("CAST(ts AS TIMESTAMP)", "event_time"),
        (EID, "event_id"),
        (AUDIT_TEXT, "cloudtrail_event"),
    ],
    "resources_raw": [
        (RESOURCE_KEY, "resource_key"),
        (f"({UNKNOWN_RESOURCE})", "unknown"),
        ("event_id", "event_id"),
    ],
    "sqs": [
        ("event_id", "event_id"),
        (cat("'m'", EID), "MessageId"),
        (cat("'r'", EID), "ReceiptHandle"),
        (SQS_BODY, "Body"),
        ("CAST(ts AS TIMESTAMP)", "ts"),
    ],
    "universal": [
        ("event_id", "event_id"),
        ("event_id", "request_id"),
        (UNIVERSAL_BODY, "body"),
        (f"CASE WHEN event_id % 6 = 0 THEN NULL ELSE {cat(lit('192.168.1.'), s('user_id % 200'))} END", "remote_addr"),
        ("CAST(ts AS TIMESTAMP)", "ts"),
    ],
    "splunk": [("event_id", "event_id"), (SPLUNK_ROW, "row"), ("CAST(ts AS TIMESTAMP)", "ts")],
    "metrics": [("event_id", "event_id"), (METRIC_TEXT, "text"), ("CAST(ts AS TIMESTAMP)", "at")],
    "queues": [("event_id", "event_id"), ("CAST(ts AS TIMESTAMP)", "polled_at"), (QUEUE_REPLY, "reply")],
    "runs": [
        ("event_id", "event_id"),
        ("CAST(ts AS TIMESTAMP)", "ts"),
        (ENRICHER, "enricher"),
        (RUNBOOK, "runbook"),
        ("(event_id * 37) % 97", "duration_ms"),
        ("CASE WHEN event_id % 11 = 0 THEN 2 ELSE 3 END", "stages_completed"),
    ],
    "attempts": [
        ("CASE WHEN event_id % 6 < 3 THEN 'splunk' ELSE 'universal' END", "target"),
        ("CAST(floor(event_id / 3) AS BIGINT)", "batch_id"),
        ("event_id % 3 + 1", "attempt"),
        (STATUS, "status"),
    ],
    "lookups": [
        (USER, "key"),
        ("ts", "ts"),
        ("event_id", "lookup_id"),
        ("event_type <> 'error'", "lookup_ok"),
        (RUNBOOK, "runbook"),
    ],
}

SPARK_TS = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx\")"
DUCK_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def spark_exprs(name: str) -> list[str]:
    fixed = [(e.replace("__TS__", SPARK_TS).replace("__BS__", "\\\\"), a) for e, a in FRAMES[name]]
    return [f"{e} AS {a}" for e, a in fixed]


def from_events(rows: DataFrame, name: str) -> DataFrame:
    """Frame ``name`` from events, batch or stream."""
    if "__TS__" in "".join(e for e, _ in FRAMES[name]):
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.selectExpr(*spark_exprs(name))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return from_events(dealt(events(spark, sf_dir)), name)


def duck(name: str) -> str:
    """Frame ``name`` as a DuckDB select."""
    exprs = [f"{e.replace('__TS__', DUCK_TS).replace('__BS__', chr(92))} AS {a}" for e, a in FRAMES[name]]
    return f"SELECT {', '.join(exprs)} FROM events"


# The frames below hold bytes or maps, which only Spark needs.

KAFKA = [
    "CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 97 = 0 THEN unhex('FF') ELSE encode(raw_payload, 'UTF-8') END AS value",
    "CASE WHEN event_id % 11 = 0 THEN encode('', 'UTF-8') WHEN event_id % 13 = 0 THEN NULL"
    " ELSE encode(concat('k', event_id), 'UTF-8') END AS key",
    "concat('t', event_id % 3) AS topic",
    "CAST(event_id % 4 AS INT) AS partition",
    "event_id AS offset",
    "received_at AS timestamp",
]


def kafka_from_events(rows: DataFrame) -> DataFrame:
    return from_events(rows, "alerts").selectExpr(*KAFKA)


def kafka(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kafka_from_events(dealt(events(spark, sf_dir)))


def pubsub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "alerts").selectExpr(
        "CASE WHEN event_id % 97 = 0 THEN unhex('C3') ELSE encode(raw_payload, 'UTF-8') END AS data",
        "concat('m', event_id) AS message_id",
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE received_at END AS publish_time",
        "map('n', CAST(event_id % 5 AS STRING)) AS attributes",
        "'projects/p/subscriptions/s' AS subscription",
        "received_at AS ts",
    )


#: Versions of every known resource: one after another, nested, tied in their start or in both ends, and overlapping.
VERSIONS = [
    ("2024-01-01", "2024-01-16", 1),
    ("2024-01-16", "2024-01-29", 2),
    ("2024-01-04", "2024-01-12", 3),
    ("2024-01-04", "2024-01-07", 4),
    ("2024-01-06", "2024-01-08", 5),
    ("2024-01-06", "2024-01-08", 6),
    ("2024-01-10", "2024-01-20", 7),
    ("2024-01-22", "2024-01-22", 8),
]


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions above for each key."""
    raw = frame(spark, sf_dir, "resources_raw").filter("not unknown")
    per_key = raw.groupBy("resource_key").agg(F.max("event_id").alias("size"))
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(v).alias("v")) for a, b, v in VERSIONS]
    return per_key.select("resource_key", "size", F.explode(F.array(*each)).alias("x")).selectExpr(
        "resource_key",
        "CAST(x.a AS TIMESTAMP) AS valid_from",
        "CAST(x.b AS TIMESTAMP) AS valid_to",
        """concat('{"ResponseMetadata":{"id":1},"size":', size, ',"version":', x.v, '}') AS payload""",
    )


DUCK_RESOURCES = f"""SELECT resource_key, CAST(a AS TIMESTAMP) AS valid_from, CAST(b AS TIMESTAMP) AS valid_to,
 concat('{{"size":', CAST(size AS STRING), ',"version":', CAST(v AS STRING), '}}') AS payload
FROM (SELECT resource_key, max(event_id) AS size FROM resources_raw WHERE NOT unknown GROUP BY resource_key) k
CROSS JOIN (VALUES {', '.join(map(str, VERSIONS))}) x(a, b, v)"""
