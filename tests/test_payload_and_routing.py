import json

import pytest
from pyspark.sql import functions as F

from alertweave.functions import payload as P
from alertweave.operators import queues, routing
from alertweave.plans import pipeline
from alertweave.sources import normalise

FLAG = "_pipeline_test"

# Payload -> expected route: the truth table of the matchers.
ROUTES = [
    ({"eventVersion": "1.08", "eventSource": "signin.amazonaws.com"}, "cloud.aws.cloudtrail"),
    ({"eventVersion": "1.08", "eventSource": "s3.amazonaws.com", "extra": None}, "cloud.aws.cloudtrail"),
    ({"eventSource": "s3.amazonaws.com"}, None),
    ({"eventVersion": 1.08, "eventSource": "s3.amazonaws.com"}, None),
    ({"eventVersion": "1.08", "eventSource": "example.com"}, None),
    ({"eventVersion": "1.08", "eventSource": 7}, None),
    ({"schemaVersion": "2.0", "type": "Sweep:Lab/ManyPorts"}, "cloud.aws.guardduty"),
    ({"schemaVersion": "2.0", "type": "NoSlash"}, None),
    ({"schemaVersion": "2.0", "type": 7.5}, None),
    ({"schemaVersion": 2, "type": "a/b"}, None),
    ({"type": "a/b"}, None),
    ({"apiVersion": "audit.k8s.io/v1", "kind": "Event"}, "cloud.aws.eks"),
    ({"apiVersion": "v1"}, None),
    ({"apiVersion": ["audit.k8s.io/v1"]}, None),
    ({"protoPayload": {"@type": "type.googleapis.com/google.cloud.audit.AuditLog"}}, "cloud.gcp.event_audit"),
    ({"protoPayload": {"@type": "other"}}, None),
    ({"protoPayload": "type.googleapis.com/google.cloud.audit.AuditLog"}, None),
    ({"protoPayload": {}}, None),
    ({FLAG: True}, "test"),
    ({FLAG: False}, None),
    ({FLAG: 1}, None),
    ({FLAG: "true"}, None),
    ({FLAG: "yes"}, None),
    ({FLAG: None}, None),
    ({}, None),
    # The first registered route wins.
    ({"apiVersion": "audit.k8s.io/v1", "eventVersion": "1", "eventSource": "x.amazonaws.com"}, "cloud.aws.eks"),
    ({"eventVersion": "1", "eventSource": "x.amazonaws.com", FLAG: True}, "cloud.aws.cloudtrail"),
]


def alert_rows(spark, payloads):
    rows = [(str(i), "kafka", json.dumps(p), "{}") for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "alert_id string, source string, raw_payload string, metadata string")
    return df.withColumn("received_at", F.timestamp_seconds(F.lit(1700000000)))


def test_routes(spark):
    routed = routing.route_alerts(alert_rows(spark, [p for p, _ in ROUTES]))
    found = {int(r["alert_id"]): r["route"] for r in routed.select("alert_id", "route").collect()}
    assert [found[i] for i in range(len(ROUTES))] == [r for _, r in ROUTES]


def test_route_names_are_unique():
    catalog = routing.default_catalog()
    with pytest.raises(ValueError):
        catalog.register(routing.Route("test", "q", lambda v: F.lit(True)))
    assert [r.name for r in catalog][0] == "cloud.aws.eks" and len(catalog) == 5


def test_empty_catalog_matches_nothing(spark):
    routed = routing.route_alerts(alert_rows(spark, [{}]), routing.RouteCatalog())
    assert routed.select("route", "queue").collect() == [(None, None)]


def test_unreadable_matcher_is_skipped(spark):
    odd = routing.Route("odd", "q", lambda v: F.try_variant_get(v, "$.n", "int") > 3)
    later = routing.Route("later", "q2", lambda v: F.lit(True))
    routed = routing.route_alerts(alert_rows(spark, [{"n": "x"}, {"n": 4}]), routing.RouteCatalog([odd, later]))
    assert sorted(r["route"] for r in routed.collect()) == ["later", "odd"]


def test_dead_letter_names_keys_in_order(spark):
    payloads = [{"zeta": 1, "alpha": 2}, {}, {"it's": 1}, {'a"b\'c': 1, "x\\y": 2}]
    dead = queues.dead_letters(routing.unmatched(routing.route_alerts(alert_rows(spark, payloads))))
    found = {r["alert"]["alert_id"]: r["error_detail"] for r in dead.collect()}
    prefix = "No matcher returned True for payload keys: "
    assert [found[str(i)] for i in range(4)] == [prefix + str(list(p)) for p in payloads]
    assert {r["dlq_reason"] for r in dead.collect()} == {"no_route_matched"}


def test_queue_folders_hold_everything_once(spark, tmp_path):
    routed = routing.route_alerts(alert_rows(spark, [p for p, _ in ROUTES]))
    queues.write_queues(routed, str(tmp_path / "q"))
    back = spark.read.parquet(str(tmp_path / "q"))
    assert back.count() == len(ROUTES)
    assert back.filter("queue = 'alerts.dlq'").count() == sum(r is None for _, r in ROUTES)
    one = back.filter("queue = 'runbook.eks'")
    assert "PartitionFilters: [isnotnull(queue" in one._jdf.queryExecution().toString()


VALUES = {
    "empty": "", "zero": 0, "half": 0.5, "nought": 0.0, "no": False, "yes": True, "list": [], "obj": {},
    "text": "x", "nulls": [None], "null": None,
}


def test_truthiness_follows_python(spark):
    df = spark.createDataFrame([(json.dumps(VALUES),)], "t string").select(P.parse(F.col("t")).alias("v"))
    row = df.select(*[P.truthy(F.col("v"), f"$.{k}").alias(k) for k in [*VALUES, "absent"]]).first()
    assert row.asDict() == {**{k: bool(v) for k, v in VALUES.items()}, "absent": False}


def test_absent_null_and_value_differ(spark):
    df = spark.createDataFrame([('{"a":null,"b":1}',)], "t string").select(P.parse(F.col("t")).alias("v"))
    v = F.col("v")
    checks = [P.has_key(v, "$.a"), P.has_key(v, "$.c"), P.has_value(v, "$.a"), P.has_value(v, "$.b"), P.is_null(P.field(v, "$.a"))]
    assert list(df.select(*[c.alias(str(i)) for i, c in enumerate(checks)]).first()) == [True, False, False, True, True]


def test_repeated_keys_keep_the_last_value(spark):
    df = spark.createDataFrame([('{"a":1,"a":"x"}',)], "t string").select(P.parse(F.col("t")).alias("v"))
    assert df.select(P.string_at(F.col("v"), "$.a")).first()[0] == "x"


def test_summary_scans_once_without_python_or_cross_join(spark):
    messages = spark.range(100).selectExpr(
        "encode('{}', 'UTF-8') AS value", "CAST(NULL AS BINARY) AS key", "'t' AS topic", "0 AS partition", "id AS offset"
    )
    plan = pipeline.routing_summary(normalise.kafka(messages))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan"):]
    assert physical.count("Exchange") == 1
    assert "CartesianProduct" not in physical and "NestedLoop" not in physical and "Python" not in physical
    assert physical.count("parseJson") == 1
