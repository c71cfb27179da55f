import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from alertweave import settings as S
from alertweave.operators import delivery, metrics, numbering, queues, routing
from alertweave.functions import payload
from alertweave.plans import guard, pipeline, runbooks
from alertweave.sources import normalise
from tests.test_payload_and_routing import alert_rows


def enriched(spark, n=1, runbook="test", destination="splunk"):
    rows = alert_rows(spark, [{"b": 1, "a": [1.50, None], "text": "line\nbreak"}] * n)
    return rows.select(
        F.struct(*queues.STORED_ALERT).alias("alert"), F.lit(runbook).alias("runbook"),
        F.timestamp_micros(F.lit(1700000000250000)).alias("enriched_at"), F.lit('{"k":null}').alias("extracted"),
        F.lit(None).cast("string").alias("runbook_error"), F.lit(destination).alias("destination"),
    )


def test_enriched_envelope(spark):
    line = enriched(spark).select(P_line(delivery.hec_enriched_event())).first()[0]
    event = json.loads(line)
    assert "\n" not in line and '"time":1700000000.250000' in line
    assert list(event) == ["time", "host", "source", "sourcetype", "index", "event"]
    assert event["source"] == "test" and event["index"] == "main"
    inner = event["event"]
    assert inner["alert"]["raw_payload"] == {"a": [1.5, None], "b": 1, "text": "line\nbreak"} and inner["alert"]["metadata"] == {}
    assert inner["runbook_error"] is None and inner["extracted"] == {"k": None} and inner["destination"] == "splunk"


def P_line(struct):
    return F.to_json(struct, {"ignoreNullFields": "false"})


def test_envelope_falls_back_to_the_alert_source_and_universal_has_no_index(spark):
    event = json.loads(enriched(spark, runbook="").select(P_line(delivery.universal_event())).first()[0])
    assert event["source"] == "kafka" and "index" not in event


def test_dead_letter_envelope(spark):
    dead = queues.dead_letters(routing.unmatched(routing.route_alerts(alert_rows(spark, [{"x": 1}]))), F.timestamp_seconds(F.lit(7)))
    event = json.loads(delivery.dlq_lines(dead).first()["line"])
    assert event["time"] == 7.0 and event["source"] == "kafka" and event["sourcetype"] == S.DEFAULTS.dlq_sourcetype
    assert event["event"]["dlq_reason"] == "no_route_matched" and event["event"]["original_queue"] == "alerts"


def test_unconfigured_destination_becomes_a_row(spark):
    rows = enriched(spark, 2, destination="universal")
    assert delivery.delivery_lines(rows, universal_configured=False).count() == 0
    assert delivery.split_destination(rows, False).filter("undeliverable IS NOT NULL").count() == 2
    assert delivery.delivery_lines(rows).filter("target = 'universal'").count() == 2


@pytest.mark.parametrize("n, expected", [(0, []), (1, [1]), (50, [50]), (101, [1, 50, 50])])
def test_batches(spark, n, expected):
    lines = spark.range(0, n, 1, 3).select(F.lit("splunk").alias("target"), F.col("id").alias("alert_id"), F.col("id").cast("string").alias("line"))
    rows = sorted(delivery.batches(lines, 50).collect(), key=lambda r: r["batch"])
    assert sorted(r["events"] for r in rows) == expected
    sent = [line for r in rows for line in r["payload"].split("\n")]
    assert list(map(int, sent)) == list(range(n)) and all(r["events"] == 50 for r in rows[:-1])


OUTCOMES = [
    ("splunk", [200], "delivered", None), ("splunk", [503, 200], "delivered", None), ("splunk", [201], "permanent_error", None),
    ("universal", [201], "delivered", None), ("splunk", [404], "permanent_error", None), ("splunk", [429], "retry", 1),
    ("splunk", [None, 500], "retry", 2), ("splunk", [0, 429, 599], "failed", None), ("universal", [301], "permanent_error", None),
]


def test_delivery_outcome(spark):
    rows = [(t, i, a, s) for i, (t, statuses, _, _) in enumerate(OUTCOMES) for a, s in enumerate(statuses, 1)]
    df = spark.createDataFrame(rows, "target string, batch_id int, attempt int, status int")
    found = {r["batch_id"]: (r["outcome"], r["wait_seconds"]) for r in delivery.delivery_outcome(df).collect()}
    assert [found[i] for i in range(len(OUTCOMES))] == [(o, w) for _, _, o, w in OUTCOMES]


def test_numbered_batches_fill_up_in_order(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 == 0, "rare").otherwise("splunk").alias("target"), (-F.col("id")).alias("at"))
    numbered = delivery.numbered_batches(rows, ["target"], ["at"], 7)
    got = sorted((r["target"], r["position"], r["batch"], -r["at"]) for r in numbered.collect())
    want = []
    for target, ids in (("rare", range(990, -1, -10)), ("splunk", [i for i in range(999, -1, -1) if i % 10])):
        want += [(target, k + 1, k // 7, i) for k, i in enumerate(ids)]
    assert got == want


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_and_sums_of_one_large_and_many_small_groups(spark, parts):
    rng = random.Random(parts)
    rows = [("hot" if rng.random() < 0.9 else rng.choice([None, "", "a", "z"]), rng.randrange(50), i, rng.choice([None, 1, 5])) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, at int, id int, w bigint").repartition(parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = numbering.positions(df, ["g"], ["at", "id"], ("w",))
        got = {(r["g"], r["id"]): (r["position"], r["running_w"]) for r in placed.collect()}
        tasks = placed.select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    counts, sums, want = collections.Counter(), collections.Counter(), {}
    for g, at, i, w in sorted(rows, key=lambda r: (r[1], r[2])):
        counts[g] += 1
        sums[g] += w or 0
        want[g, i] = counts[g], sums[g]
    assert got == want and tasks > 1
    assert numbering.positions(df.limit(0), ["g"], ["at"]).count() == 0


def test_counters(spark):
    events = [
        ("alert_ingested", '{"source":"kafka"}'), ("alert_ingested", '{"source":"kafka"}'), ("alert_ingested", "{}"),
        ("alert_ingested", '{"source":null}'), ("route_matched", '{"route":"a:b"}'), ("dlq_enqueued", '{"reason":"r"}'),
        ("runbook_success", '{"runbook":"x"}'), ("runbook_error", '{"runbook":"y"}'), ("other", '{"source":"z"}'), ("", "{}"),
    ]
    counted = metrics.counters(spark.createDataFrame(events, "event string, data string"))
    rows = {(r["bucket"], r["name"]): r["value"] for r in counted.collect()}
    assert rows == {
        ("alert_ingested", "kafka"): 2, ("alert_ingested", "unknown"): 2, ("route_counts", "a:b"): 1, ("dlq_counts", "r"): 1,
        ("runbook_success", "x"): 1, ("runbook_error", "y"): 1,
    }
    stored = metrics.counter_keys(counted).union(spark.createDataFrame([("odd:k", 1), ("route_counts", 3)], "key string, value bigint"))
    back = {(r["bucket"], r["name"]): r["value"] for r in metrics.from_counter_keys(stored).collect()}
    assert back == {**rows, ("route_counts", ""): 3}
    perf = [tuple(r) for r in metrics.runbook_performance(counted).collect()]
    assert perf == [("x", 1, 0, 0.0, "green"), ("y", 0, 1, 100.0, "red")]


def test_stats_every_n_counts_in_the_order_of_time(spark):
    rows = spark.range(1000).selectExpr(
        "if(id % 3 = 0, 'small', 'big') AS runbook", "timestamp_seconds(id * 7) AS ts", "cast(id AS string) AS alert_id",
        "if(id % 5 = 0, NULL, id % 2 = 0) AS hit",
    )
    out = sorted((r["runbook"], r["position"], r["alert_id"], r["hits"], r["misses"]) for r in metrics.stats_every_n(rows, 50).collect())
    want = []
    for name in ("big", "small"):
        ids = [i for i in range(1000) if (i % 3 == 0) == (name == "small")]
        for k in range(50, len(ids) + 1, 50):
            looked = [i for i in ids[:k] if i % 5]
            want.append((name, k, str(ids[k - 1]), sum(i % 2 == 0 for i in looked), sum(i % 2 for i in looked)))
    assert out == want


def test_enrichers_run_in_the_order_of_their_needs():
    e = runbooks.Enricher
    names = [x.name for x in runbooks.in_order([e("c", None, ("b",)), e("b", None, ("a",)), e("a", None)])]
    assert names == ["a", "b", "c"]
    for wrong in ([e("a", None, ("b",)), e("b", None, ("a",))], [e("a", None, ("z",))], [e("a", None), e("a", None)]):
        with pytest.raises(ValueError):
            runbooks.in_order(wrong)


ARN = "arn:aws:iam::1:user/ann"
CLOUD = {"eventVersion": "1", "eventSource": "s3.amazonaws.com", "eventName": "PutObject"}


@pytest.mark.parametrize("stored", [False, True])
def test_whole_flow(spark, tmp_path, stored):
    payloads = [
        {**CLOUD, "userIdentity": {"type": "IAMUser", "arn": ARN, "userName": "ann"}}, {**CLOUD, "userIdentity": None},
        {"protoPayload": {"@type": routing.GCP_AUDIT_TYPE, "methodName": "m"}}, {S.DEFAULTS.test_flag: True, "n": 1},
        {"schemaVersion": "2", "type": "a/b"}, {"lost": 1},
    ]
    messages = spark.createDataFrame(
        [(json.dumps(p).encode(), None, "t", 0, i) for i, p in enumerate(payloads)] + [(b"x", None, "t", 0, 99)],
        "value binary, key binary, topic string, partition int, offset long",
    )
    write = json.dumps({**CLOUD, "readOnly": False, "requestParameters": {"bucketName": "b", "key": "k"}})
    audit = spark.createDataFrame([("ann", 90, "e1", write), ("ann", 95, "e2", "broken")],
        "username string, t int, event_id string, cloudtrail_event string").withColumn("event_time", F.timestamp_seconds("t"))
    known = spark.createDataFrame([("s3:object:b/k", '{"size":3}')], "resource_key string, payload string").select(
        "resource_key", F.timestamp_seconds(F.lit(0)).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), "payload"
    )
    rows, books = normalise.kafka(messages, F.timestamp_seconds(F.lit(100))), runbooks.default_runbooks(audit, known)
    now = F.timestamp_seconds(F.lit(101))
    out = pipeline.run(rows, books, str(tmp_path / "run"), now=now) if stored else pipeline.flow(rows, books, now=now)
    assert out.rejects.count() == 1 and out.dead_letters.count() == 1 and out.routed.count() == 6
    rows = out.enriched.collect()
    assert sorted(r["runbook"] for r in rows) == ["cloud.aws.cloudtrail"] * 2 + ["cloud.gcp.event_audit", "test"]
    extracted = {r["alert"]["raw_payload"]: json.loads(r["extracted"]) for r in rows}
    full = extracted[json.dumps(payloads[0])]
    assert [e["EventId"] for e in full["cloudtrail"]["principal_recent_events"]] == ["e2", "e1"]
    assert full["cloudtrail"]["inspected_objects"] == {"s3:object:b/k": {"size": 3}}
    assert len(full["cloudtrail"]["successful_writes"]) == 1 and full["principal"]["normalized_id"] == ARN
    assert [e["type"] for e in full["enricher_errors"]] == ["PartialParseFailure"] and full["user"] == "ann"
    bare = extracted[json.dumps(payloads[1])]
    assert "principal" not in bare and "user" not in bare
    assert bare["cloudtrail"] == {"successful_writes": [], "inspected_objects": {}}
    assert [e["enricher"] for e in bare["enricher_errors"]] == ["principal_identity", "principal_history"]
    assert extracted[json.dumps(payloads[3])] == payloads[3]
    assert out.lines.count() == 5
    counts = {(r["bucket"], r["name"]): r["value"] for r in metrics.counters(out.metric_events).collect()}
    assert counts[("alert_ingested", "kafka")] == 6 and counts[("dlq_counts", "no_route_matched")] == 1
    assert counts[("runbook_success", "cloud.aws.cloudtrail")] == 2


def test_alerts_without_a_time_keep_their_columns(spark):
    text = json.dumps({**CLOUD, "userIdentity": {"type": "IAMUser", "arn": ARN, "userName": "ann"}})
    rows = spark.createDataFrame([("a", "s", text, "{}")] * 2, "alert_id string, source string, raw_payload string, metadata string")
    routed = rows.withColumn("received_at", F.lit(None).cast("timestamp")).withColumn("queue", F.lit(S.QUEUE_CLOUDTRAIL))
    audit = spark.createDataFrame([], "username string, event_time timestamp, event_id string, cloudtrail_event string")
    known = spark.createDataFrame([], "resource_key string, valid_from timestamp, valid_to timestamp, payload string")
    got = runbooks.cloudtrail(audit, known).enrich(routed, F.timestamp_seconds(F.lit(1))).collect()
    assert [(r["alert"]["source"], r["alert"]["raw_payload"]) for r in got] == [("s", text)] * 2
    assert all(json.loads(r["extracted"])["principal"]["normalized_id"] == ARN for r in got)
    assert [e["error"] for e in json.loads(got[0]["extracted"])["enricher_errors"]] == ["alert has no time to look back from"]


def strict(payload):
    if payload["n"] == 3:
        raise ValueError("three is too many")
    return {"double": payload["n"] * 2, "tags": payload.get("tags")}


@pytest.mark.parametrize("guarded", [True, False])
def test_a_failing_row_keeps_its_alert_and_stops_no_other(spark, tmp_path, guarded):
    flag = S.DEFAULTS.test_flag
    payloads = [{flag: True, "n": 1, "tags": ["a"]}, {flag: True, "n": 3}, {flag: True}, {flag: True, "n": 4}]
    messages = spark.createDataFrame(
        [(json.dumps(p).encode(), None, "t", 0, i) for i, p in enumerate(payloads)], "value binary, key binary, topic string, partition int, offset long"
    )
    book = runbooks.Runbook("test", S.QUEUE_TEST, guard.RowFunction(strict, "double int, tags array<string>"), guarded=guarded)
    now = F.timestamp_seconds(F.lit(101))
    out = pipeline.run(normalise.kafka(messages, F.timestamp_seconds(F.lit(100))), [book], str(tmp_path / "run"), now=now)
    rows = {r["alert"]["raw_payload"]: (r["runbook_error"], json.loads(r["extracted"])) for r in out.enriched.collect()}
    want = [(None, {"double": 2, "tags": ["a"]}), ("ValueError: three is too many", {}), ("KeyError: 'n'", {}), (None, {"double": 8})]
    assert rows == {json.dumps(p): w for p, w in zip(payloads, want)}
    counts = {(r["bucket"], r["name"]): r["value"] for r in metrics.counters(out.metric_events).collect()}
    errors = [json.loads(r["data"]) for r in out.metric_events.filter("event = 'runbook_error'").collect()]
    if guarded:
        assert counts["runbook_success", "test"] == 4 and not errors and out.lines.count() == 4 and out.failed.count() == 0
    else:
        assert counts["runbook_success", "test"] == 2 and counts["runbook_error", "test"] == 2 and out.lines.count() == 2
        assert sorted(e["error"] for e in errors) == ["KeyError: 'n'", "ValueError: three is too many"] and out.failed.count() == 2


def test_enrichers_from_functions_and_a_failure_check(spark):
    def first(payload, alert_id):
        if alert_id == "2":
            raise LookupError("no such alert")
        return {"size": len(payload)}

    def second(size):
        return None if size is None else {"large": size > 1}

    rows = alert_rows(spark, [{"a": 1}, {"a": 1, "b": 2}, {"c": 3}, {"bad": True}])
    routed = rows.withColumn("queue", F.lit("q")).drop("payload")
    book = runbooks.Runbook(
        "own", "q", lambda v: F.struct(payload.value_or_absent(v, "$.a").alias("a")),
        enrichers=(runbooks.row_enricher("second", second, ["size"], "large boolean", ("first",)), runbooks.row_enricher("first", first, ["payload", "alert_id"], "size int")),
        more=lambda: [F.col("size"), F.col("large")],
        failure=lambda v: F.when(payload.has_key(v, "$.bad"), F.lit("TypeError: bad")),
    )
    got = {r["alert"]["alert_id"]: (r["runbook_error"], json.loads(r["extracted"])) for r in book.enrich(routed, F.timestamp_seconds(F.lit(1))).collect()}
    assert got == {
        "0": (None, {"a": 1, "size": 1, "large": False}), "1": (None, {"a": 1, "size": 2, "large": True}),
        "2": (None, {"enricher_errors": [{"enricher": "first", "error": "no such alert", "type": "LookupError"}]}),
        "3": ("TypeError: bad", {}),
    }


def test_cache_statistics_are_among_the_events_of_a_run(spark, tmp_path):
    user = {"type": "IAMUser", "arn": ARN, "userName": "ann"}
    payloads = [{**CLOUD, "userIdentity": user, "n": i} for i in range(5)] + [{**CLOUD, "userIdentity": None}]
    messages = spark.createDataFrame(
        [(json.dumps(p).encode(), None, "t", 0, i) for i, p in enumerate(payloads)], "value binary, key binary, topic string, partition int, offset long"
    )
    audit = spark.createDataFrame([], "username string, event_time timestamp, event_id string, cloudtrail_event string")
    known = spark.createDataFrame([], "resource_key string, valid_from timestamp, valid_to timestamp, payload string")
    settings = S.Settings(cache_stats_every=3)
    out = pipeline.run(
        normalise.kafka(messages, F.timestamp_seconds(F.lit(100))), runbooks.default_runbooks(audit, known), str(tmp_path / "run"),
        settings=settings, now=F.timestamp_seconds(F.lit(101)),
    )
    stats = [json.loads(r["data"]) for r in out.metric_events.filter("event = 'principal_cache_stats'").collect()]
    assert len(stats) == 2 and max((s["hits"], s["misses"]) for s in stats) == (4, 1)
    assert {r["event"] for r in out.metric_events.select("event").distinct().collect()} >= {"runbook_success", "enricher_error", "principal_cache_stats"}
