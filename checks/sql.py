"""DuckDB side of the checks: named sub-queries and their dependencies."""

from __future__ import annotations

import re

from checks import inputs as I

DAY = 86400000000


def uuid(text: str) -> str:
    h = f"md5({text})"
    parts = ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"concat_ws('-', {parts})"


def doc(text: str) -> str:
    return f"CASE WHEN json_valid({text}) THEN CAST({text} AS JSON) END"


def _kind(path: str, kind: str) -> str:
    return f"coalesce(json_type(j, '{path}') = '{kind}', false)"


MATCH = {
    "match_eks": f"({_kind('$.apiVersion', 'VARCHAR')} AND j->>'$.apiVersion' = 'audit.k8s.io/v1')",
    "match_cloudtrail": f"({_kind('$.eventSource', 'VARCHAR')} AND ends_with(j->>'$.eventSource', '.amazonaws.com')"
    f" AND {_kind('$.eventVersion', 'VARCHAR')})",
    "match_guardduty": f"({_kind('$.schemaVersion', 'VARCHAR')} AND {_kind('$.type', 'VARCHAR')}"
    " AND contains(j->>'$.type', '/'))",
    "match_gcp_audit": f"({_kind('$.protoPayload.\"@type\"', 'VARCHAR')} AND"
    " j->>'$.protoPayload.\"@type\"' = 'type.googleapis.com/google.cloud.audit.AuditLog')",
    "match_test": f"({_kind('$.' + I.FLAG, 'BOOLEAN')} AND j->>'$.{I.FLAG}' = 'true')",
}

ROUTE = (
    f"CASE WHEN {MATCH['match_eks']} THEN 'cloud.aws.eks' WHEN {MATCH['match_cloudtrail']} THEN 'cloud.aws.cloudtrail'"
    f" WHEN {MATCH['match_guardduty']} THEN 'cloud.aws.guardduty' WHEN {MATCH['match_gcp_audit']}"
    f" THEN 'cloud.gcp.event_audit' WHEN {MATCH['match_test']} THEN 'test' END"
)

QUEUE = (
    "CASE route WHEN 'cloud.aws.eks' THEN 'runbook.eks' WHEN 'cloud.aws.cloudtrail' THEN 'runbook.cloudtrail'"
    " WHEN 'cloud.aws.guardduty' THEN 'runbook.guardduty' WHEN 'cloud.gcp.event_audit' THEN 'runbook.gcp.event_audit'"
    " WHEN 'test' THEN 'runbook.test' END"
)

CATALOG = """(VALUES (1, 'cloud.aws.eks', 'runbook.eks'), (2, 'cloud.aws.cloudtrail', 'runbook.cloudtrail'),
 (3, 'cloud.aws.guardduty', 'runbook.guardduty'), (4, 'cloud.gcp.event_audit', 'runbook.gcp.event_audit'),
 (5, 'test', 'runbook.test')) AS c(position, name, queue)"""

RUNBOOKS = """(VALUES ('cloud.aws.cloudtrail', 'runbook.cloudtrail'), ('cloud.gcp.event_audit', 'runbook.gcp.event_audit'),
 ('test', 'runbook.test')) AS b(name, source_queue)"""


def ttl_chain(source: str, ttl: int = DAY) -> str:
    """Row-by-row cache replay of ``source(key, moment, lookup_id, lookup_ok)`` as two sub-queries ``o`` and ``r``."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY moment, lookup_id) AS rn FROM {source}),
r AS (
 SELECT key, rn, moment, lookup_id, lookup_ok, false AS hit, CASE WHEN lookup_ok THEN moment + {ttl} END AS expires,
  CASE WHEN lookup_ok THEN lookup_id END AS opener, lookup_id AS served_by FROM o WHERE rn = 1
 UNION ALL
 SELECT o.key, o.rn, o.moment, o.lookup_id, o.lookup_ok, coalesce(o.moment < r.expires, false),
  CASE WHEN coalesce(o.moment < r.expires, false) THEN r.expires WHEN o.lookup_ok THEN o.moment + {ttl} ELSE r.expires END,
  CASE WHEN coalesce(o.moment < r.expires, false) THEN r.opener WHEN o.lookup_ok THEN o.lookup_id ELSE r.opener END,
  CASE WHEN coalesce(o.moment < r.expires, false) THEN r.opener ELSE o.lookup_id END
 FROM r JOIN o ON o.key = r.key AND o.rn = r.rn + 1)"""


_UI = "ui->>'$."

TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "alerts": (I.duck("alerts"), ()),
    "identities": (I.duck("identities"), ()),
    "audit": (I.duck("audit"), ()),
    "resources_raw": (I.duck("resources_raw"), ()),
    "resources": (I.DUCK_RESOURCES, ("resources_raw",)),
    "sqs": (I.duck("sqs"), ()),
    "universal": (I.duck("universal"), ()),
    "splunk": (I.duck("splunk"), ()),
    "metrics": (I.duck("metrics"), ()),
    "queues": (I.duck("queues"), ()),
    "runs": (I.duck("runs"), ()),
    "attempts": (I.duck("attempts"), ()),
    "lookups": (
        "SELECT key, epoch_us(ts) AS moment, lookup_id, lookup_ok, runbook, ts FROM (" + I.duck("lookups") + ")",
        (),
    ),
    "parsed": (f"SELECT *, {doc('raw_payload')} AS j FROM alerts", ("alerts",)),
    "objects": ("SELECT * FROM parsed WHERE json_type(j) = 'OBJECT'", ("parsed",)),
    "routed": (f"SELECT *, {QUEUE} AS queue FROM (SELECT *, {ROUTE} AS route FROM objects)", ("objects",)),
    "kafka_rows": (
        """SELECT event_id, raw_payload, j, received_at, event_id % 89 = 0 AS is_null, event_id % 89 <> 0 AND event_id % 97 = 0 AS is_bad,
 concat('t', CAST(event_id % 3 AS STRING)) AS topic, CAST(event_id % 4 AS INT) AS part,
 CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE concat('k', CAST(event_id AS STRING)) END AS key
 FROM parsed""",
        ("parsed",),
    ),
    "kafka_reasons": (
        "SELECT *, CASE WHEN is_null THEN 'null_value' WHEN is_bad THEN 'bad_utf8' WHEN j IS NULL THEN 'bad_json'"
        " WHEN json_type(j) <> 'OBJECT' THEN 'not_object' END AS reason FROM kafka_rows",
        ("kafka_rows",),
    ),
    "sqs_rows": (f"SELECT *, {doc('Body')} AS b FROM sqs", ("sqs",)),
    "sqs_inner": (
        "SELECT *, coalesce(json_type(b, '$.Type') = 'VARCHAR' AND b->>'$.Type' = 'Notification', false)"
        " AND json_exists(b, '$.Message') AS wrapped, CASE WHEN json_type(b, '$.Message') = 'VARCHAR' THEN b->>'$.Message' END"
        " AS inner_text FROM sqs_rows",
        ("sqs_rows",),
    ),
    "sqs_reasons": (
        f"SELECT *, CASE WHEN b IS NULL THEN 'bad_json' WHEN json_type(b) <> 'OBJECT' THEN 'not_object'"
        f" WHEN wrapped AND i IS NOT NULL AND json_type(i) <> 'OBJECT' THEN 'not_object' END AS reason,"
        " CASE WHEN NOT wrapped THEN Body WHEN i IS NOT NULL THEN inner_text"
        " ELSE concat('{\"message\":', CAST(b->'$.Message' AS STRING), '}') END AS payload"
        f" FROM (SELECT *, {doc('inner_text')} AS i FROM sqs_inner)",
        ("sqs_inner",),
    ),
    "pubsub_reasons": (
        "SELECT event_id, raw_payload, j, CASE WHEN event_id % 97 = 0 THEN 'bad_utf8'"
        " WHEN j IS NOT NULL AND json_type(j) <> 'OBJECT' THEN 'not_object' END AS reason,"
        " CASE WHEN j IS NULL THEN concat('{\"data\":\"', raw_payload, '\"}') ELSE raw_payload END AS payload, received_at FROM parsed",
        ("parsed",),
    ),
    "splunk_reasons": (
        f"SELECT *, CASE WHEN json_type(j) <> 'OBJECT' THEN 'not_object' END AS reason"
        f" FROM (SELECT *, {doc('row')} AS j FROM (SELECT event_id, \"row\", ts FROM splunk))",
        ("splunk",),
    ),
    "universal_reasons": (
        "SELECT *, CASE WHEN j IS NULL THEN 'bad_json' WHEN coalesce(json_type(j, '$.raw_payload'), 'X') <> 'OBJECT' THEN 'missing_payload'"
        " WHEN json_exists(j, '$.metadata') AND json_type(j, '$.metadata') <> 'OBJECT' THEN 'bad_metadata'"
        " WHEN json_exists(j, '$.source') AND json_type(j, '$.source') <> 'VARCHAR' THEN 'bad_source' END AS reason"
        f" FROM (SELECT *, {doc('body')} AS j FROM universal)",
        ("universal",),
    ),
    # Identity of the routed audit alerts.
    "ui_parts": (
        "SELECT event_id, alert_id, received_at, route, j, CASE WHEN json_type(j, '$.userIdentity') = 'OBJECT' THEN j->'$.userIdentity' END AS ui"
        " FROM routed WHERE route = 'cloud.aws.cloudtrail'",
        ("routed",),
    ),
    "ui_fields": (
        f"SELECT *, {_UI}type' AS t, {_UI}arn' AS arn, {_UI}accountId' AS acc, {_UI}userName' AS un, {_UI}invokedBy' AS inv,"
        f" {_UI}sessionContext.sessionIssuer.arn' AS iarn, {_UI}sessionContext.sessionIssuer.userName' AS iun FROM ui_parts",
        ("ui_parts",),
    ),
    "ui_ids": (
        "SELECT *, CASE WHEN ui IS NULL THEN NULL WHEN t = 'AWSService' THEN concat('service:', lower(inv)) WHEN t = 'AssumedRole' THEN"
        " coalesce(iarn, regexp_replace(arn, '^arn:([^:]*):sts::([^:]*):assumed-role/([^/]*)/.*$', 'arn:\\1:iam::\\2:role/\\3')) ELSE arn END AS nid"
        " FROM ui_fields",
        ("ui_fields",),
    ),
    "who": (
        "SELECT event_id, alert_id, received_at, j, ui, nid, CASE WHEN nid IS NOT NULL THEN 'aws' END AS provider,"
        " CASE WHEN t = 'AWSService' THEN inv WHEN t = 'AssumedRole' THEN coalesce(arn, nid) ELSE arn END AS raw_id,"
        " CASE WHEN nid IS NULL THEN NULL WHEN t = 'AWSService' THEN inv WHEN t = 'Root' THEN 'root' ELSE coalesce(CASE WHEN t = 'AssumedRole' THEN iun ELSE un END,"
        " CASE WHEN contains(split_part(nid, ':', 6), '/') THEN substr(split_part(nid, ':', 6), strpos(split_part(nid, ':', 6), '/') + 1)"
        " ELSE split_part(nid, ':', 6) END) END AS display_name,"
        " CASE WHEN t = 'AWSService' THEN NULL ELSE coalesce(acc, nullif(split_part(nid, ':', 5), '')) END AS account,"
        " CASE WHEN ui IS NULL THEN 'alert payload missing userIdentity' WHEN nid IS NULL THEN"
        " concat('userIdentity type=''', t, ''' missing arn') END AS problem,"
        " CASE WHEN ui IS NULL THEN 'PreconditionError' WHEN nid IS NULL THEN 'ValueError' END AS problem_type FROM ui_ids",
        ("ui_ids",),
    ),
    "eligible": (
        "SELECT *, coalesce(NOT (starts_with(nid, 'service:') OR ends_with(nid, ':root') OR contains(nid, ':federated-user/')), false) AS ok"
        " FROM who",
        ("who",),
    ),
    "history": (
        f"""SELECT event_id, alert_id, received_at, place, eid, cloudtrail_event, {doc('cloudtrail_event')} AS e FROM (
 SELECT x.event_id, x.alert_id, x.received_at, a.event_id AS eid, a.cloudtrail_event,
  row_number() OVER (PARTITION BY x.alert_id ORDER BY a.event_time DESC, a.event_id DESC) AS place
 FROM eligible x JOIN audit a ON a.username = x.display_name
  AND a.event_time BETWEEN x.received_at - INTERVAL 1 DAY AND x.received_at WHERE x.ok) WHERE place <= 3""",
        ("eligible", "audit"),
    ),
    "writes": (
        "SELECT * FROM history WHERE json_type(e) = 'OBJECT' AND json_type(e, '$.readOnly') = 'BOOLEAN' AND e->>'$.readOnly' = 'false'"
        " AND NOT json_exists(e, '$.errorCode')",
        ("history",),
    ),
    "write_kinds": (
        "SELECT *, CASE WHEN c IN ('s3.amazonaws.com|PutObject', 's3.amazonaws.com|DeleteObject', 's3.amazonaws.com|CopyObject') THEN 's3:object'"
        " WHEN c IN ('iam.amazonaws.com|CreateUser', 'iam.amazonaws.com|UpdateUser', 'iam.amazonaws.com|DeleteUser') THEN 'iam:user'"
        " WHEN c IN ('iam.amazonaws.com|CreateRole', 'iam.amazonaws.com|UpdateRole', 'iam.amazonaws.com|DeleteRole') THEN 'iam:role'"
        " WHEN c = 'ec2.amazonaws.com|RunInstances' THEN 'ec2:instance' END AS kind"
        " FROM (SELECT *, concat(e->>'$.eventSource', '|', e->>'$.eventName') AS c FROM writes)",
        ("writes",),
    ),
    "targets": (
        """SELECT alert_id, received_at, place, e->>'$.eventName' AS event_name, k.resource_key FROM (
 SELECT alert_id, received_at, place, e, CASE kind
  WHEN 's3:object' THEN CASE WHEN e->>'$.requestParameters.key' IS NULL THEN [] ELSE
   [concat('s3:object:', e->>'$.requestParameters.bucketName', '/', e->>'$.requestParameters.key')] END
  WHEN 'iam:user' THEN [concat('iam:user:', e->>'$.requestParameters.userName')]
  ELSE list_transform(json_extract_string(e, '$.responseElements.instancesSet.items[*].instanceId'), lambda x: concat('ec2:instance:', x)) END AS keys
 FROM write_kinds WHERE kind IS NOT NULL) t, unnest(t.keys) AS k(resource_key)""",
        ("write_kinds",),
    ),
    "states": (
        "SELECT * FROM (SELECT m.resource_key, m.received_at, v.payload, row_number() OVER (PARTITION BY m.resource_key, m.received_at"
        " ORDER BY v.valid_from DESC, v.valid_to DESC, v.payload DESC) AS rn"
        " FROM (SELECT DISTINCT resource_key, received_at FROM targets) m JOIN resources v ON v.resource_key = m.resource_key"
        " AND v.valid_from <= m.received_at AND m.received_at < v.valid_to) WHERE rn = 1",
        ("targets", "resources"),
    ),
    "found": (
        "SELECT t.*, s.payload FROM targets t LEFT JOIN states s ON s.resource_key = t.resource_key AND s.received_at = t.received_at",
        ("targets", "states"),
    ),
    "found_writes": (
        "SELECT *, min(CASE WHEN payload IS NULL THEN resource_key END) OVER (PARTITION BY alert_id, place) AS missing FROM found",
        ("found",),
    ),
    "errors": (
        """SELECT alert_id, 1 AS stage, 0 AS pos, 'principal_identity' AS enricher, problem AS error, problem_type AS type FROM eligible WHERE problem IS NOT NULL
UNION ALL SELECT alert_id, 2, 0, 'principal_history', 'no principal — run after PrincipalIdentityEnricher', 'PreconditionError' FROM eligible WHERE nid IS NULL
UNION ALL SELECT alert_id, 2, 0, 'principal_history', 'skipped: unsupported provider=aws', 'PrincipalSkipped' FROM eligible WHERE nid IS NOT NULL AND NOT ok
UNION ALL SELECT alert_id, 3, 0, 'write_filter', concat('failed to parse ', CAST(count(*) AS STRING), ' CloudTrailEvent entries'), 'PartialParseFailure'
 FROM history WHERE e IS NULL OR json_type(e) <> 'OBJECT' GROUP BY alert_id
UNION ALL SELECT DISTINCT alert_id, 4, place, 'object_inspection', concat(event_name, ' target inspection failed: no state of ', missing), 'ResourceNotFound'
 FROM found_writes WHERE missing IS NOT NULL""",
        ("eligible", "history", "found_writes"),
    ),
    "metric_docs": (f"SELECT *, {doc('text')} AS j FROM metrics", ("metrics",)),
    "metric_rows": (
        "SELECT event_id, coalesce(j->>'$.event', '') AS event, CASE WHEN json_type(j, '$.data') = 'OBJECT' THEN j->'$.data' ELSE '{}' END AS data"
        " FROM metric_docs WHERE json_type(j) = 'OBJECT'",
        ("metric_docs",),
    ),
    "counters": (
        """SELECT bucket, coalesce(name, 'unknown') AS name, CAST(count(*) AS BIGINT) AS value FROM (SELECT
 CASE event WHEN 'alert_ingested' THEN 'alert_ingested' WHEN 'route_matched' THEN 'route_counts' WHEN 'dlq_enqueued' THEN 'dlq_counts'
  WHEN 'runbook_success' THEN 'runbook_success' WHEN 'runbook_error' THEN 'runbook_error' END AS bucket,
 CASE event WHEN 'alert_ingested' THEN data->>'$.source' WHEN 'route_matched' THEN data->>'$.route' WHEN 'dlq_enqueued' THEN data->>'$.reason'
  ELSE data->>'$.runbook' END AS name FROM metric_rows) WHERE bucket IS NOT NULL GROUP BY 1, 2""",
        ("metric_rows",),
    ),
    "snapshots": (
        """SELECT polled_at, q->>'$.name' AS name, CAST(q->>'$.messages' AS BIGINT) AS messages,
 CAST(coalesce(q->>'$.messages_ready', '0') AS BIGINT) AS messages_ready, CAST(0 AS BIGINT) AS messages_unacknowledged,
 CAST(q->>'$.consumers' AS BIGINT) AS consumers,
 round(CAST(coalesce(q->>'$.message_stats.publish_details.rate', '0') AS DOUBLE), 2) AS publish_rate,
 round(CAST(coalesce(q->>'$.message_stats.deliver_get_details.rate', '0') AS DOUBLE), 2) AS deliver_rate,
 coalesce(q->>'$.state', 'unknown') AS state
FROM (SELECT polled_at, CAST(reply AS JSON)->'$[0]' AS q FROM queues WHERE json_type(CAST(reply AS JSON)) = 'ARRAY')""",
        ("queues",),
    ),
    "latest": (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY polled_at DESC) AS rn FROM snapshots) WHERE rn = 1",
        ("snapshots",),
    ),
    # Stored rows the delivery steps start from.
    "stored": (
        "SELECT event_id, alert_id, received_at, raw_payload, j, CASE WHEN event_id % 9 = 0 THEN '' ELSE route END AS runbook,"
        " received_at + to_milliseconds(event_id % 1000) AS enriched_at,"
        " CASE WHEN event_id % 4 = 0 THEN 'universal' ELSE 'splunk' END AS destination FROM routed WHERE route IS NOT NULL",
        ("routed",),
    ),
    "dlq": ("SELECT * FROM routed WHERE route IS NULL", ("routed",)),
}


# All events of the look-back of an alert, not the newest three.
WHOLE_HISTORY = (TABLES["history"][0].removesuffix(" WHERE place <= 3"), TABLES["history"][1])

# What each alert sees when look-ups are shared through the cache: the history of the look-up that serves it.
TABLES["own_history"] = TABLES["history"]
CACHED_HISTORY = (
    "SELECT w.event_id, r.lookup_id AS alert_id, w.received_at, h.place, h.eid, h.cloudtrail_event, h.e"
    " FROM r JOIN own_history h ON h.alert_id = r.served_by JOIN who w ON w.alert_id = r.lookup_id",
    ("own_history", "who"),
)


def query(select: str, *tables: str, extra: str = "", before: str = "", swap: dict | None = None) -> str:
    """``select`` behind the sub-queries it names; ``extra`` is added after them, or in front of the sub-query ``before``.

    ``swap`` gives other definitions for some of them.
    """
    known = TABLES | (swap or {})
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for needed in known[name][1]:
            add(needed)
        order.append(name)

    for table in tables:
        add(table)
    parts: list[str] = []
    for name in order:
        if extra and name == before:
            parts.append(extra)
        parts.append(f"{name} AS ({known[name][0]})")
    if extra and not before:
        parts.append(extra)
    text = f"WITH RECURSIVE {', '.join(parts)}\n{select}" if parts else select
    # The arrow binds weaker than a comparison, so every use gets brackets.
    return re.sub(r"\b([A-Za-z_][A-Za-z_.]*)(->>?)('[^']*')", r"(\1\2\3)", text)
