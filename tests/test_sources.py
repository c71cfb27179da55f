import json
import uuid

import pytest
from pyspark.sql import functions as F

from alertweave.sources import normalise, polling, stored


def by(df, key="n"):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}


def kafka_rows(spark, values):
    rows = [(v, k, "t", 1, i) for i, (v, k) in enumerate(values)]
    df = spark.createDataFrame(rows, "value binary, key binary, topic string, partition int, offset long")
    return normalise.kafka(df).withColumn("n", F.get_json_object("metadata", "$.offset").cast("int"))


def test_kafka(spark):
    values = [
        (b'{"rule":"x"}', b"k"), (b'{"a":1}', None), (b'{"a":1}', b""), (None, b"k"), (b"\xff", None), (b"nope", None),
        (b"[1]", None), (b'"text"', None), (b'{"a":1}', b"\xff"), (b'{"x":NaN}', None),
    ]
    rows = by(kafka_rows(spark, values))
    assert [rows[i]["reject_reason"] for i in range(10)] == [
        None, None, None, "null_value", "bad_utf8", "bad_json", "not_object", "not_object", "bad_utf8", "bad_json"
    ]
    meta = json.loads(rows[0]["metadata"])
    assert meta == {"topic": "t", "partition": 1, "offset": 0, "key": "k"}
    assert json.loads(rows[1]["metadata"])["key"] is None and json.loads(rows[2]["metadata"])["key"] is None
    assert rows[8]["reject_detail"] == "key" and rows[3]["alert_id"] is None
    uuid.UUID(rows[0]["alert_id"])
    assert rows[1]["alert_id"] != rows[2]["alert_id"]


def test_kafka_replay_keeps_ids(spark):
    first, second = (by(kafka_rows(spark, [(b"{}", None)] * 3)) for _ in range(2))
    assert [first[i]["alert_id"] for i in range(3)] == [second[i]["alert_id"] for i in range(3)]


def test_sqs(spark):
    event = {"eventName": "ConsoleLogin"}
    note = {"Type": "Notification", "TopicArn": "arn", "Subject": "s"}
    bodies = [
        json.dumps({**note, "Message": json.dumps(event)}), json.dumps(event), json.dumps({**note, "Message": "plain"}),
        json.dumps({**note, "Message": {"a": 1}}), json.dumps({**note, "Message": None}), json.dumps(note), "broken", "[1]",
        json.dumps({**note, "Message": "[1]"}), None, json.dumps({"Type": "Other", "Message": "{}"}),
    ]
    df = spark.createDataFrame(
        [(f"m{i}", f"r{i}", b) for i, b in enumerate(bodies)], "MessageId string, ReceiptHandle string, Body string"
    )
    rows = by(normalise.sqs(df).withColumn("n", F.get_json_object("metadata", "$.message_id")))
    got = [rows[f"m{i}"] for i in range(len(bodies))]
    expected = [event, event, {"message": "plain"}, {"message": {"a": 1}}, {"message": None}, note]
    assert [json.loads(r["raw_payload"]) for r in got[:6]] == expected
    assert [r["reject_reason"] for r in got[6:9]] == ["bad_json", "not_object", "not_object"]
    assert json.loads(got[9]["raw_payload"]) == {} and json.loads(got[10]["raw_payload"])["Type"] == "Other"
    assert json.loads(got[0]["metadata"])["topic_arn"] == "arn" and json.loads(got[1]["metadata"])["subject"] is None


def test_pubsub(spark):
    data = [b'{"a":1}', "pläin \"text\"\n".encode(), b"\xc3", b"[1]", b"", None]
    df = spark.createDataFrame(
        [(d, f"m{i}", {"k": "v"}, "sub") for i, d in enumerate(data)],
        "data binary, message_id string, attributes map<string,string>, subscription string",
    ).withColumn("publish_time", F.when(F.col("message_id") == "m0", F.timestamp_micros(F.lit(1700000000000001))))
    rows = by(normalise.pubsub(df).withColumn("n", F.get_json_object("metadata", "$.message_id")))
    assert json.loads(rows["m0"]["raw_payload"]) == {"a": 1}
    assert json.loads(rows["m1"]["raw_payload"]) == {"data": "pläin \"text\"\n"}
    assert rows["m2"]["reject_reason"] == "bad_utf8" and rows["m3"]["reject_reason"] == "not_object"
    assert json.loads(rows["m4"]["raw_payload"]) == {"data": ""} == json.loads(rows["m5"]["raw_payload"])
    meta = json.loads(rows["m0"]["metadata"])
    assert meta["publish_time"] == "2023-11-14T22:13:20.000001+00:00" and meta["attributes"] == {"k": "v"}
    assert json.loads(rows["m1"]["metadata"])["publish_time"] is None


def test_universal(spark):
    bodies = [
        '{"raw_payload":{"a":1},"metadata":{"remote_addr":"6.6.6.6","t":[1,"x"]},"source":"hook"}', '{"raw_payload":{}}',
        '{"metadata":{}}', '{"raw_payload":[1]}', '{"raw_payload":{},"metadata":null}', '{"raw_payload":{},"source":3}', "x",
    ]
    df = spark.createDataFrame([(i, i, b, "1.2.3.4" if i else None) for i, b in enumerate(bodies)],
                               "n int, request_id int, body string, remote_addr string")
    out = normalise.universal(df)
    rows = {r["raw"] or r["raw_payload"]: r for r in out.collect()}
    first = rows['{"a":1}']
    assert first["source"] == "hook" and json.loads(first["metadata"]) == {"remote_addr": None, "t": [1, "x"]}
    assert rows["{}"]["source"] == "universal" and json.loads(rows["{}"]["metadata"]) == {"remote_addr": "1.2.3.4"}
    assert [rows[b]["reject_reason"] for b in bodies[2:]] == [
        "missing_payload", "missing_payload", "bad_metadata", "bad_source", "bad_json"
    ]


def test_alerts_and_rejects_cover_all_messages(spark):
    rows = kafka_rows(spark, [(b"{}", None), (b"x", None), (None, None)]).drop("n")
    assert normalise.alerts(rows).count() == 1 and normalise.rejects(rows).count() == 2


def test_polling_moves_the_checkpoint_and_drops_boundary_repeats(spark):
    df = spark.createDataFrame([(str(i), i) for i in (1, 2, 3, 3, 4, 5)], "alert_id string, t int")
    df = df.withColumn("at", F.timestamp_seconds("t"))
    start, now = (F.timestamp_seconds(F.lit(x)) for x in (0, 3))
    first = polling.poll(df, "at", start, now)
    mark = polling.next_checkpoint(first, "at", start).first()[0]
    assert first.count() == 4 and mark.timestamp() == 3
    again = polling.poll(df, "at", F.lit(mark), F.timestamp_seconds(F.lit(9)))
    fresh = polling.drop_boundary_repeats(again, first, "at", F.lit(mark))
    assert sorted(r["t"] for r in fresh.collect()) == [4, 5]
    empty = polling.poll(df, "at", F.timestamp_seconds(F.lit(50)), F.timestamp_seconds(F.lit(60)))
    assert polling.next_checkpoint(empty, "at", F.lit(mark)).first()[0] == mark


def test_stored_alerts(spark):
    good = {"id": "i", "source": "sqs", "received_at": "2024-01-01T00:00:00Z", "raw_payload": {"a": 1}, "metadata": {}}
    texts = [good, {**good, "raw_payload": []}, {**good, "source": None}, {**good, "received_at": "soon"}, [1]]
    df = spark.createDataFrame([(json.dumps(t),) for t in texts] + [("broken",)], "text string")
    rows = stored.alerts(df).collect()
    assert [r["reject_reason"] for r in rows] == [None] + ["alert_invalid"] * 5
    assert rows[0]["alert_id"] == "i" and json.loads(rows[0]["raw_payload"]) == {"a": 1}


def test_stored_enriched_destination(spark):
    alert = {"id": "i", "source": "s", "raw_payload": {}}
    texts = [
        {"alert": alert, "runbook": "r"}, {"alert": alert, "runbook": "r", "destination": "universal"},
        {"alert": alert, "runbook": "r", "destination": "mail"}, {"alert": {}, "runbook": "r"},
    ]
    rows = stored.enriched(spark.createDataFrame([(json.dumps(t),) for t in texts], "text string")).collect()
    assert [r["valid"] for r in rows] == [True, True, False, False]
    assert [r["destination"] for r in rows[:2]] == ["splunk", "universal"]


def test_queue_snapshots(spark):
    replies = [
        json.dumps([
            {"name": "alerts", "messages": 5, "consumers": 1, "state": "running",
             "message_stats": {"publish_details": {"rate": 1.239}, "deliver_get_details": {"rate": 2.0}}},
            {"name": "bare"}, {"message_stats": None, "messages": None},
        ]),
        "{}", "broken",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "polled_at int, reply string")
    rows = [r.asDict() for r in stored.queue_snapshots(df).collect()]
    assert len(rows) == 3
    assert (rows[0]["publish_rate"], rows[0]["deliver_rate"], rows[0]["messages"]) == (1.24, 2.0, 5)
    assert (rows[1]["messages"], rows[1]["state"], rows[1]["publish_rate"]) == (0, "unknown", 0.0)
    assert rows[2]["messages"] is None and rows[2]["name"] == ""


def test_a_position_with_a_gap_gives_no_shared_id(spark):
    messages = spark.createDataFrame(
        [(b'{"a":1}', None, "t", 0, None), (b'{"a":2}', None, "t", 0, None), (b'{"a":2}', None, "t", 0, None)],
        "value binary, key binary, topic string, partition int, offset long",
    )
    ids = [r["alert_id"] for r in normalise.kafka(messages).collect()]
    assert len(set(ids)) == 2
    rows = [(b'{"a":1}', None, None, {}, "s"), (b'{"a":2}', None, None, {}, "s"), (b'{"a":3}', "b|c", None, {}, "a"), (b'{"a":3}', "c", None, {}, "a|b")]
    df = spark.createDataFrame(rows, "data binary, message_id string, publish_time timestamp, attributes map<string,string>, subscription string")
    assert len({r["alert_id"] for r in normalise.pubsub(df).collect()}) == 4


def test_polling_by_the_time_of_the_event(spark):
    texts = ['{"_time":"2024-01-01T10:00:00Z"}', '{"_time":"2024-01-01T09:00:00Z"}', '{"_time":"2024-01-01T08:00:00+00:00"}', '{"_time":"soon"}', "{}"]
    rows = spark.createDataFrame([(t,) for t in texts], "row string").withColumn("_time", polling.event_time())
    now, start = (F.lit(f"2024-01-01 {h}:00:00").cast("timestamp") for h in ("09", "08"))
    polled = polling.poll(rows, "_time", start, now)
    assert sorted(r["row"] for r in polled.collect()) == sorted(texts[1:3])
    assert polling.next_checkpoint(polled, "_time", start).first()[0].hour == 9


def test_sources_register_their_normalisers(spark):
    catalog = normalise.default_sources()

    def csv(df):
        return normalise.kafka(df.select(F.encode("line", "UTF-8").alias("value"), F.lit(None).cast("binary").alias("key"),
            F.lit("csv").alias("topic"), F.lit(0).alias("partition"), "offset"))

    catalog.register("csv", csv)
    assert catalog.names == ["kafka", "sqs", "pubsub", "universal", "csv"]
    lines = spark.createDataFrame([('{"a":1}', 0), ("broken", 1)], "line string, offset long")
    posted = spark.createDataFrame([('{"raw_payload":{"b":2}}', None)], "body string, remote_addr string")
    rows = catalog.normalise({"csv": lines, "universal": posted})
    assert rows.columns == normalise.NORMALISED_COLUMNS
    assert sorted(r["raw_payload"] for r in normalise.alerts(rows).collect()) == ['{"a":1}', '{"b":2}']
    assert normalise.rejects(rows).count() == 1
    with pytest.raises(ValueError):
        catalog.register("csv", csv)
    for wrong in ({"other": lines}, {}):
        with pytest.raises(ValueError):
            catalog.normalise(wrong)
    catalog.register("short", lambda df: df)
    with pytest.raises(ValueError):
        catalog.normalise({"short": lines})
