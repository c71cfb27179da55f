import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from alertweave.operators import asof, history, metrics, numbering, resources, ttl

SECOND = 1000000


def brute_newest(probes, facts, n, lookback):
    out = set()
    for key, at in set(probes):
        seen = sorted(
            ((fa, fid) for k, fa, fid in facts if k == key and fa <= at and (lookback is None or fa >= at - lookback)),
            reverse=True,
        )
        out |= {(key, at, fid, fa, i) for i, (fa, fid) in enumerate(seen[:n], 1)}
    return out


@pytest.mark.parametrize("n, lookback", [(1, None), (3, 40 * SECOND), (5, 0), (50, 1000 * SECOND)])
def test_newest_before_matches_brute_force(spark, n, lookback):
    """Half of all rows share one key, many share one instant, and some keys are on one side only."""
    rng = random.Random(n)
    key = lambda: "hot" if rng.random() < 0.5 else f"k{rng.randrange(8)}"
    moment = lambda: rng.choice([-5, 100, 100, 100]) * SECOND + rng.choice([0, 1, rng.randrange(200 * SECOND)])
    facts = [(key(), moment(), f"f{i}") for i in range(700)] + [("facts only", 0, "x"), (None, 5, "none")]
    probes = [(key(), moment()) for _ in range(400)] + [("probes only", 5), (None, 5)]
    got = asof.newest_before(
        spark.createDataFrame(probes, "key string, at bigint"),
        spark.createDataFrame(facts, "key string, at bigint, fact_id string"), n, lookback,
    )
    rows = {(r["key"], r["at"], r["fact_id"], r["fact_at"], r["place"]) for r in got.collect()}
    assert got.count() == len(rows)
    assert rows == brute_newest([p for p in probes if p[0]], [f for f in facts if f[0]], n, lookback)


def test_newest_before_plan_has_no_pairing_within_a_key(spark):
    probes, facts = spark.range(9).selectExpr("'a' AS key", "id AS at"), spark.range(9).selectExpr("'a' AS key", "id AS at", "id AS fact_id")
    plan = asof.newest_before(probes, facts, 2, 5)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan"):]
    assert "CartesianProduct" not in physical and "NestedLoop" not in physical
    # The one window left is over the totals of partitions.
    assert re.findall(r"Window \[[^\]]*\], \[([^\]]*)\]", re.sub(r"#\d+L?", "", physical)) and "windowspecdefinition(at" not in physical


def test_instants_of_one_minute_are_spread_over_tasks(spark):
    n = 20_000
    facts = spark.range(n).selectExpr("'hot' AS key", "60000000 + id AS at", "id AS fact_id")
    probes = spark.createDataFrame([("hot", 60_000_000 + i) for i in (0, 1, 9_999, n + 5)], "key string, at bigint")
    got = sorted((r["at"], r["fact_id"]) for r in asof.newest_before(probes, facts, 2).collect())
    base = 60_000_000
    assert got == [(base, 0), (base + 1, 0), (base + 1, 1), (base + 9_999, 9_998), (base + 9_999, 9_999), (base + n + 5, n - 2), (base + n + 5, n - 1)]
    placed = numbering.positions(facts.select("key", "at"), ["key"], ["at"])
    sizes = [r["count"] for r in placed.groupBy(F.ceil(F.col("position") / 3000)).count().collect()]
    assert sum(sizes) == n


def brute_replay(rows, life):
    """rows: (key, at, id, ok) -> id -> (hit, served_by)"""
    entry, out = {}, {}
    for key, at, lookup, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        opened = entry.get(key)
        if opened and at < opened[0]:
            out[lookup] = (True, opened[1])
            continue
        if ok:
            entry[key] = (at + life, lookup)
        out[lookup] = (False, lookup)
    return out


def lookup_frame(spark, rows):
    return spark.createDataFrame(rows, "key string, at bigint, lookup_id bigint, lookup_ok boolean")


@pytest.mark.parametrize("life, span, rows_per_chunk", [(10, 400, 30), (1, 50, 7), (37, 5000, 100), (900, 1000, 64), (10, 9, 1), (37, 5000, 5000)])
def test_replay_matches_brute_force(spark, life, span, rows_per_chunk):
    rng = random.Random(span)
    rows = [
        ("hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}", rng.randrange(-20, span), i, rng.random() < 0.8)
        for i in range(3000)
    ]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {r["lookup_id"]: (r["hit"], r["served_by"]) for r in ttl.replay(lookup_frame(spark, rows), life, rows_per_chunk).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_replay(rows, life)


def test_a_key_with_most_of_the_rows_is_cut_into_chunks(spark):
    # 9,000 instants of one key, most of them in a few slots, beside many small keys.
    times = [*range(0, 3000), *range(3000, 300_000, 297), *range(400_000, 405_000)]
    instants = spark.createDataFrame([("hot", t // 50, t, t) for t in times] + [(f"k{t}", t // 50, t, t) for t in range(800)],
        "key string, slot bigint, at bigint, anchor_id bigint")
    chunks = ttl._chunks(instants, 50, 400)
    sizes = instants.join(chunks, ["key", "slot"]).groupBy("key", "chunk").agg(F.count("*").alias("n"), F.min("at"), F.max("at"), F.max("begins")).collect()
    assert {r["key"] for r in sizes} == {"hot"} and sum(r["n"] for r in sizes) == len(times)
    assert len(sizes) >= len(times) // 450 and max(r["n"] for r in sizes) <= 400 + 50
    ordered = sorted((r[3], r[4], r[5]) for r in sizes)
    assert all(a[1] < b[2] <= b[0] for a, b in zip(ordered, ordered[1:]))


def test_entry_is_dead_at_its_expiry_and_hits_do_not_extend_it(spark):
    rows = [("a", 0, 1, True), ("a", 9, 2, True), ("a", 10, 3, True), ("a", 19, 4, True), ("a", 20, 5, False), ("a", 21, 6, True), ("b", 9, 7, True)]
    got = {r["lookup_id"]: r["hit"] for r in ttl.replay(lookup_frame(spark, rows), 10).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False}
    stats = metrics.cache_stats(ttl.replay(lookup_frame(spark, rows), 10), 10, F.lit(25)).first()
    assert tuple(stats) == (2, 5, 1)


def test_life_must_be_positive(spark):
    with pytest.raises(ValueError):
        ttl.anchors(lookup_frame(spark, []), 0)


def item(text):
    return ("e", None, text if text is None or isinstance(text, str) else json.dumps(text))


ITEMS = [
    item({"eventName": "A", "readOnly": False}), item({"eventName": "B", "readOnly": True}),
    item({"eventName": "C", "readOnly": False, "errorCode": "X"}), item({"eventName": "D", "readOnly": False}),
    item({"eventName": "E", "readOnly": False, "errorCode": None}), item({"eventName": "F"}),
    item({"eventName": "G", "readOnly": "false"}), item({"eventName": "H", "readOnly": 0}),
    item("not json"), item(None), item([1]), item("42"),
]


def test_successful_writes(spark):
    df = spark.createDataFrame(
        [("a", ITEMS), ("b", []), ("c", None)], f"alert_id string, events array<{history.HISTORY_ITEM}>"
    )
    rows = {r["alert_id"]: r for r in history.successful_writes(df).select(
        "alert_id", F.to_json("writes").alias("w"), "unreadable", "write_error").collect()}
    assert [w["eventName"] for w in json.loads(rows["a"]["w"])] == ["A", "D"]
    assert rows["a"]["unreadable"] == 4
    assert tuple(rows["a"]["write_error"]) == ("write_filter", "failed to parse 4 CloudTrailEvent entries", "PartialParseFailure")
    assert json.loads(rows["b"]["w"]) == [] == json.loads(rows["c"]["w"]) and rows["b"]["write_error"] is None


def test_items_that_are_not_objects_are_left_out(spark):
    items = [
        {"EventId": "1", "CloudTrailEvent": '{"a":1}'}, {"EventId": "2", "CloudTrailEvent": {"a": 1}}, None, 42, "string",
        {"EventId": "3", "CloudTrailEvent": 7},
    ]
    df = spark.createDataFrame([(json.dumps(i),) for i in items], "item string")
    rows = {r["event_id"]: r["cloudtrail_event"] for r in history.audit_events_from_items(df).collect()}
    assert rows == {"1": '{"a":1}', "2": '{"a":1}', "3": None}


S3 = {"eventSource": "s3.amazonaws.com", "eventName": "PutObject", "requestParameters": {"bucketName": "my-bucket", "key": "path/to/file.txt"}}
USER = {"eventSource": "iam.amazonaws.com", "eventName": "CreateUser", "requestParameters": {"userName": "ann"}}
GONE = {"eventSource": "iam.amazonaws.com", "eventName": "DeleteRole", "requestParameters": {"roleName": "r"}}
EC2 = {"eventSource": "ec2.amazonaws.com", "eventName": "RunInstances",
       "responseElements": {"instancesSet": {"items": [{"instanceId": "i-1"}, {"other": 1}, "x", {"instanceId": "i-2"}]}}}
SILENT = [
    {"eventSource": "lambda.amazonaws.com", "eventName": "Invoke"}, {"eventSource": "s3.amazonaws.com", "eventName": "PutObject"},
    {"eventSource": "s3.amazonaws.com", "eventName": "PutObject", "requestParameters": {"bucketName": "b", "key": ""}},
    {"eventSource": "iam.amazonaws.com", "eventName": "CreateUser", "requestParameters": None},
    {"eventSource": "ec2.amazonaws.com", "eventName": "RunInstances", "responseElements": {"instancesSet": {"items": []}}},
]


def inspect(spark, writes, known, at="2024-01-10"):
    df = spark.createDataFrame([("a", json.dumps(writes)), ("b", "[]")], "alert_id string, t string").select(
        "alert_id", F.lit(at).cast("timestamp").alias("received_at"), F.from_json("t", "array<variant>").alias("writes")
    )
    table = spark.createDataFrame(known, "resource_key string, valid_from string, valid_to string, payload string").select(
        "resource_key", F.col("valid_from").cast("timestamp"), F.col("valid_to").cast("timestamp"), "payload"
    )
    rows = {r["alert_id"]: r for r in resources.with_inspection(df, table).collect()}
    assert rows["b"]["inspected_objects"] == {} and rows["b"]["inspection_errors"] == []
    return rows["a"]["inspected_objects"], [tuple(e) for e in rows["a"]["inspection_errors"]]


def test_inspection(spark):
    key = "s3:object:my-bucket/path/to/file.txt"
    known = [
        (key, "2024-01-01", "2024-01-10", "old"), (key, "2024-01-10", None, "new"), (key, "2024-02-01", None, "later"),
        ("iam:user:ann", "2024-01-01", "2024-01-09", "ended"), ("ec2:instance:i-1", "2024-01-01", None, "one"),
        ("ec2:instance:i-2", "2024-01-01", None, "two"),
    ]
    objects, errors = inspect(spark, [S3, USER, EC2, GONE, S3, *SILENT], known)
    assert objects == {key: "new", "ec2:instance:i-1": "one", "ec2:instance:i-2": "two"}
    assert [e[1] for e in errors] == [
        "CreateUser target inspection failed: no state of iam:user:ann", "DeleteRole target inspection failed: no state of iam:role:r",
    ]
    assert {e[0] for e in errors} == {"object_inspection"} and {e[2] for e in errors} == {"ResourceNotFound"}


def test_one_missing_instance_fails_its_write_only(spark):
    objects, errors = inspect(spark, [EC2, S3], [
        ("ec2:instance:i-1", "2024-01-01", None, "one"), ("s3:object:my-bucket/path/to/file.txt", "2024-01-01", None, "o"),
    ])
    assert list(objects.values()) == ["o"] and len(errors) == 1 and "RunInstances" in errors[0][1]


def test_cached_history_reuses_the_first_result(spark):
    who = ("aws", "arn:aws:iam::1:user/ann", "arn", "ann", "1")
    at = [0, 100, 899, 900, 2000]
    alerts = spark.createDataFrame([(f"a{i}", who, t, True) for i, t in enumerate(at)],
        "alert_id string, principal struct<provider:string,normalized_id:string,raw_id:string,display_name:string,account_or_project:string>, t int, eligible boolean",
    ).withColumn("received_at", F.timestamp_seconds("t"))
    audit = spark.createDataFrame([("ann", t, f"e{t}", "{}") for t in (-10, 50, 850, 1990)],
        "username string, t int, event_id string, cloudtrail_event string").withColumn("event_time", F.timestamp_seconds("t"))
    rows = {r["alert_id"]: r for r in history.with_cached_history(alerts, audit, 900, 60, 50).collect()}
    ids = {a: [e["event_id"] for e in r["events"]] for a, r in rows.items()}
    assert ids == {"a0": ["e-10"], "a1": ["e-10"], "a2": ["e-10"], "a3": ["e850", "e50", "e-10"], "a4": ["e1990", "e850", "e50", "e-10"]}
    assert [rows[f"a{i}"]["cache_hit"] for i in range(5)] == [False, True, True, False, False]


def test_overlapping_and_tied_versions(spark):
    r = random.Random(8)
    versions = [("a", 1, 100, "old"), ("a", 5, 7, "short"), ("b", 1, None, "x"), ("b", 1, 50, "y"), ("c", 3, 3, "empty")]
    for k in range(6):
        for _ in range(8):
            start = r.randint(0, 40)
            versions.append((f"r{k}", start, r.choice([None, start + r.randint(0, 15), start + r.randint(0, 60)]), str(r.random())))
    table = spark.createDataFrame(versions, "resource_key string, f long, t long, payload string").selectExpr(
        "resource_key", "timestamp_micros(f) AS valid_from", "timestamp_micros(t) AS valid_to", "payload"
    )
    moments = [(k, at) for k in ["a", "b", "c", "none", *(f"r{k}" for k in range(6))] for at in range(0, 110, 3)] * 2
    got = resources.state_at(spark.createDataFrame(moments, "resource_key string, at long"), table).collect()
    want = {}
    for key, at in moments:
        valid = [(f, t is None, t or 0, p) for k, f, t, p in versions if k == key and f <= at and (t is None or at < t)]
        if valid:
            want[key, at] = max(valid)[3]
    assert {(x["resource_key"], x["at"]): x["payload"] for x in got} == want and len(got) == len(want)
    assert want["a", 9] == "old" and want["a", 6] == "short" and want["b", 60] == "x"


def test_payloads_are_read_of_versions_in_reach_only(spark):
    raw = spark.range(400).selectExpr(
        "concat('k', id % 4) AS resource_key", "timestamp_micros(id) AS valid_from", "timestamp_micros(id + 9) AS valid_to",
        """concat('{"ResponseMetadata":{},"n":', id, '}') AS payload""",
    )
    moments = spark.createDataFrame([("k1", 105), ("k1", 120), ("k2", 3), ("k2", 500), ("none", 7)], "resource_key string, at long")
    kept = resources._in_reach(raw, moments).selectExpr("resource_key", "unix_micros(valid_from) AS f").collect()
    assert {r["f"] for r in kept if r["resource_key"] == "k1"} == {97, 101, 105, 109, 113, 117}
    assert {r["resource_key"] for r in kept} == {"k1", "k2"}
    stored = resources.state_at(moments, resources.Stored(raw))
    assert sorted(tuple(r) for r in stored.collect()) == [("k1", 105, '{"n":105}'), ("k1", 120, '{"n":117}'), ("k2", 3, '{"n":2}')]
    assert sorted(stored.collect()) == sorted(resources.state_at(moments, resources.load_resources(raw)).collect())


def test_deeply_nested_versions_take_one_pass(spark):
    n = 100_000
    # Each version lies inside the one before, and all begin before the first one ends.
    nested = spark.range(n).selectExpr("'deep' AS resource_key", "id AS valid_from", f"{4 * n} - id AS valid_to")
    start = time.perf_counter()
    seen = resources.visible(nested.unionByName(nested.selectExpr("'other' AS resource_key", "valid_from", "valid_from + 1 AS valid_to")))
    counts = {r["resource_key"]: (r["count"], r["first"], r["last"]) for r in seen.groupBy("resource_key").agg(
        F.count("*").alias("count"), F.min("seen_from").alias("first"), F.max("seen_to").alias("last")).collect()}
    assert counts == {"deep": (2 * n - 1, 0, 4 * n), "other": (n, 0, n)}
    assert time.perf_counter() - start < 60


def test_history_reads_the_events_in_reach_and_groups_no_text(spark, tmp_path):
    rows = [("u", 1_000_000 * k, f"e{k}", f'{{"k":{k}}}') for k in range(0, 20_000, 500)] + [("u", 9_500_000_000, "e9500", '{"k":0}')]
    path = str(tmp_path / "audit")
    spark.createDataFrame(rows, "username string, at long, event_id string, cloudtrail_event string").selectExpr(
        "username", "timestamp_micros(at) AS event_time", "event_id", "cloudtrail_event"
    ).write.parquet(path)
    audit = spark.read.parquet(path)
    probes = spark.createDataFrame([("u", 10_000), ("v", 10_000), (None, 5)], "username string, s long").selectExpr(
        "username", "timestamp_seconds(s) AS received_at"
    )
    pairs = history.history_pairs(probes, audit, lookback_minutes=30)
    asked = probes.selectExpr("username AS key", "unix_micros(received_at) AS at").filter("key IS NOT NULL")
    plan = history._in_reach(audit, asked, 30)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"event_time#\d+ >= 1970-01-01 02:16:40", plan) and re.search(r"event_time#\d+ <= 1970-01-01 02:46:40", plan)
    found = history.histories(pairs, audit)
    # Both copies of an event show, with the greater text.
    (row,) = found.collect()
    assert [e["event_id"] for e in row["events"]] == ["e10000", "e9500", "e9500", "e9000", "e8500"]
    assert {e["cloudtrail_event"] for e in row["events"][1:3]} == {'{"k":9500}'}
    text_plan = found._jdf.queryExecution().executedPlan().toString()
    assert "max(cloudtrail_event" not in text_plan and "SortAggregate" not in text_plan


def test_history_without_a_limit_has_every_event_of_the_look_back(spark):
    audit = spark.createDataFrame([("u", t, f"e{t}") for t in range(0, 400, 2)] + [("u", 390, "twin"), ("v", 390, "other")],
        "username string, s int, event_id string").selectExpr("username", "timestamp_seconds(s) AS event_time", "event_id", "'{}' AS cloudtrail_event")
    asked = spark.createDataFrame([("u", 391), ("u", 130), ("w", 391)], "username string, s int").selectExpr("username", "timestamp_seconds(s) AS received_at")

    def found(most):
        rows = history.histories(history_pairs_of(most), audit).collect()
        return {r["at"] // 1_000_000: [e["event_id"] for e in r["events"]] for r in rows}

    def history_pairs_of(most):
        return history.history_pairs(asked, audit, 2, most)

    want = {391: ["twin", *(f"e{t}" for t in range(390, 270, -2))], 130: [f"e{t}" for t in range(130, 8, -2)]}
    assert found(None) == want
    assert found(3) == {at: events[:3] for at, events in want.items()}
    with pytest.raises(ValueError):
        history_pairs_of(0)


def test_inspected_map_is_of_all_writes_of_the_look_back(spark, tmp_path):
    from checks import registry

    # Three purchases and later signups of one name within a day; the alert is the last of them.
    ids = [303, 304, 305, 310, 311, 312, 320]
    rows = [(i, f"2024-01-02 0{k}:00:00", 4, "purchase" if k < 3 else "signup", 1.0, "{}") for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    objects = {(r["alert_id"], r["resource_key"]) for r in registry.QUERIES["inspected_map"](spark, str(tmp_path)).collect()}
    last = {key for alert, key in objects if alert == "a320"}
    assert last == {"s3:object:b4/k3", "s3:object:b4/k4", "s3:object:b4/k5", "iam:user:u4"}
