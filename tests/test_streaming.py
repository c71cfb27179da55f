"""Streams of several micro-batches give what the batch steps give on the whole table."""

import collections
import os
import random

import pytest
from pyspark.sql import functions as F

from alertweave.operators import metrics, queues, routing
from alertweave.streaming import cache_state, history_state, jobs, sending
from alertweave.streaming.folded import FoldedLog
from tests.test_history_and_cache import brute_replay, lookup_frame
from tests.test_payload_and_routing import ROUTES, alert_rows


def as_stream(spark, frames, folder):
    """Each frame becomes one file, read one per micro-batch in the order given."""
    import time

    for i, frame in enumerate(frames):
        path = f"{folder}/part{i}"
        frame.coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet"):
                os.utime(f"{path}/{name}", (time.time() - 1000 + i, time.time() - 1000 + i))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part*")


def test_route(spark, tmp_path):
    whole = alert_rows(spark, [p for p, _ in ROUTES])
    parts = [whole.filter(F.col("alert_id").cast("int") % 3 == i) for i in range(3)]
    stream = as_stream(spark, parts, str(tmp_path / "in"))
    query = jobs.route(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination()
    got = {(r["alert_id"], r["queue"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["alert_id"], r["queue"] or "alerts.dlq") for r in routing.route_alerts(whole).collect()}
    assert got == want and len(got) == len(ROUTES)


@pytest.mark.parametrize("fold_every", [1, 2, 20])
def test_counters_over_batches_and_restart(spark, tmp_path, fold_every):
    events = spark.range(60).selectExpr(
        "if(id % 2 = 0, 'alert_ingested', 'runbook_error') AS event",
        "if(id % 2 = 0, concat('{\"source\":\"s', id % 3, '\"}'), '{\"runbook\":\"r\"}') AS data", "id",
    )
    parts = [events.filter(F.col("id") % 5 == i) for i in range(5)]
    stream = as_stream(spark, parts, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):  # the second start finds nothing new
        jobs.count(stream, out, str(tmp_path / "ckpt"), fold_every=fold_every).awaitTermination()
    log = jobs.counter_log(spark, out)
    got = log.read().select("bucket", "name", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, metrics.counters(events).collect()))
    assert len(log.tail()) == {1: 0, 2: 1, 20: 5}[fold_every]
    assert len([d for d in os.listdir(out) if d.startswith("batch_id=")]) == len(log.tail())


def log_of(spark, path, **more):
    return FoldedLog(spark, path, "k string, n bigint, total bigint", ("k",), ("total",), **more)


def test_a_crash_between_the_steps_of_a_fold_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    log = log_of(spark, path)
    assert log.read().count() == 0

    def batch(i):
        return spark.createDataFrame([("a", 10 * i, 1), (f"b{i}", i, 2)], "k string, n bigint, total bigint")

    def state():
        return {r["k"]: (r["n"], r["total"]) for r in log.read().collect()}

    def want(last):
        return {"a": (10 * last, last + 1)} | {f"b{i}": (i, 2) for i in range(last + 1)}

    for i in range(4):
        log.append(batch(i), i)
    assert state() == want(3)
    # The snapshot is written but its mark is not there yet.
    log._remove = lambda *_: None
    log.fold()
    mark = f"{path}/snapshot=3/_SUCCESS"
    held = open(mark, "rb").read()
    os.remove(mark)
    assert log.covered() == -1 and state() == want(3)
    # The mark is there, but nothing has been removed.
    open(mark, "wb").write(held)
    assert log.covered() == 3 and log.tail() == [] and state() == want(3)
    # A covered batch is repeated, and goes on.
    log = log_of(spark, path)
    log.append(batch(3), 3)
    log.append(batch(4), 4)
    assert state() == want(4)
    # A batch that is being written does not count yet.
    os.makedirs(f"{path}/batch_id=5")
    assert log.tail() == [4]
    log.fold()
    assert state() == want(4) and not [d for d in os.listdir(path) if d in ("batch_id=3", "batch_id=4")]
    for i in range(5, 8):
        log.append(batch(i), i)
        log.fold()
    assert state() == want(7) and sorted(d for d in os.listdir(path) if "=" in d) == ["snapshot=6", "snapshot=7"]


def replayed_in_batches(spark, tmp_path, batches, life, delay):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    stream = as_stream(spark, [lookup_frame(spark, rows) for rows in batches], str(tmp_path / "in"))
    for query in jobs.replay_ttl(stream, life, out, ckpt, delay):
        query.awaitTermination()
    return jobs.replayed_ttl(spark, out, life), spark.read.parquet(f"{out}/openings")


def test_cache_replay_in_out_of_order_batches(spark, tmp_path):
    rng = random.Random(3)
    second = 1000000
    rows = [(f"k{rng.randrange(6)}" if i % 2 else "hot", (i // 3) * second, 1000 + i, rng.random() < 0.8) for i in range(900)]
    # Every row may come up to 100 s after its time; ids have four digits, so text order is number order.
    mixed = sorted(rows, key=lambda r: r[1] + rng.randrange(100) * second)
    got, openings = replayed_in_batches(spark, tmp_path, [mixed[a : a + 150] for a in range(0, 900, 150)], 25 * second, 101)
    got = {int(r["lookup_id"]): (r["hit"], int(r["served_by"])) for r in got.collect()}
    assert got == brute_replay(rows, 25 * second)
    kinds = {r["state"]: r["count"] for r in openings.groupBy("state").count().collect()}
    assert kinds["overtaken"] > 0 and "late" not in kinds


def test_late_look_ups_are_listed_and_open_nothing(spark, tmp_path):
    second = 1000000
    batches = [
        [("a", 100 * second, 1, True), ("b", 100 * second, 2, True)],
        [("a", 300 * second, 3, True)],
        # Behind the mark of 240 s: one inside the life of the first entry, one outside.
        [("a", 104 * second, 4, True), ("a", 150 * second, 5, True), ("c", 400 * second, 6, True), (None, 400 * second, 7, True)],
        [("a", 152 * second, 8, False)],
    ]
    got, openings = replayed_in_batches(spark, tmp_path, batches, 10 * second, 60)
    got = {int(r["lookup_id"]): (r["hit"], int(r["served_by"])) for r in got.collect()}
    assert got == {1: (False, 1), 2: (False, 2), 3: (False, 3), 4: (True, 1), 5: (False, 5), 6: (False, 6), 7: (False, 7), 8: (False, 8)}
    assert sorted(r["anchor_id"] for r in openings.filter("state = 'late'").collect()) == ["4", "5"]


def test_cache_state_holds_live_keys_only(spark, tmp_path):
    second = 1000000
    batches = [[(f"k{b}-{i}", b * 1000 * second + i, b * 100 + i, True) for i in range(50)] for b in range(5)]
    stream = as_stream(spark, [lookup_frame(spark, rows) for rows in batches], str(tmp_path / "in"))
    queries = jobs.replay_ttl(stream, 10 * second, str(tmp_path / "out"), str(tmp_path / "ckpt"), 60)
    for query in queries:
        query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in queries[1].recentProgress if p["stateOperators"]]
    assert max(held) <= 100 and held[-1] <= 50


def test_settle_against_whole_replay():
    rng = random.Random(8)
    for _ in range(200):
        life, delay = rng.randrange(1, 30), rng.randrange(0, 60)
        rows = [(t, str(1000 + i)) for i, t in enumerate(rng.randrange(300) for _ in range(60))]
        mixed = sorted(rows, key=lambda r: r[0] + rng.randrange(delay + 1))
        held, mark, state, newest = (-(2**62), {}, {}), -(2**62), {}, -1
        while mixed:
            n = rng.randrange(1, 9)
            arrived = {}
            for at, i in mixed[:n]:
                arrived[at] = min(i, arrived.get(at, i))
            mixed = mixed[n:]
            held, out = cache_state.settle(held, arrived, mark, life)
            newest = max([newest, *arrived])
            mark = newest - delay
            for at, i, kind in out:
                assert kind != "late"
                state[at] = (i, kind)
        want, ends = {}, -1
        for at, i in sorted(rows):
            if at >= ends:
                want[at], ends = i, at + life
        assert {at: i for at, (i, kind) in state.items() if kind == "open"} == want


def test_repeats_of_a_restart_are_dropped(spark, tmp_path):
    rows = alert_rows(spark, [{}] * 10)
    stream = as_stream(spark, [rows, rows.filter("alert_id < '5'"), rows], str(tmp_path / "in"))
    jobs.to_table(jobs.drop_repeats(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(r["alert_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(map(str, range(10)))


def brute_answers(alerts, events, lookback, n):
    out = {}
    for at, i in alerts:
        seen = sorted(((t, e) for t, e in events if at - lookback <= t <= at), reverse=True)
        out[i] = [e for _, e in seen[:n]]
    return out


def test_answers_settle_as_the_batch_join():
    rng = random.Random(4)
    for _ in range(100):
        lookback, n, delay = rng.randrange(1, 60), rng.randrange(1, 5), rng.randrange(60)
        events = [(rng.randrange(200), f"e{i:03d}") for i in range(60)]
        alerts = [(rng.randrange(200), f"a{i}") for i in range(30)]
        rows = sorted([(t, 1, i) for t, i in events] + [(t, 0, i) for t, i in alerts], key=lambda r: r[0] + rng.randrange(delay + 1))
        held, waiting, mark, newest, got, most = [], {}, -(2**62), -1, {}, 0
        while rows:
            k = rng.randrange(1, 12)
            part, rows = rows[:k], rows[k:]
            held, waiting, out = history_state.settle(
                held, waiting, [(t, i) for t, e, i in part if e], [(t, i) for t, e, i in part if not e], mark, lookback, n
            )
            most = max(most, sum(t < mark for t, _ in held))
            newest = max([newest, *(t for t, _, _ in part)])
            mark = newest - delay
            for kind, i, _, found in out:
                assert kind == "answer"
                got[i] = [e for _, e in found]
        assert got == brute_answers(alerts, events, lookback, n) and most <= n


def test_recent_events_of_two_streams(spark, tmp_path):
    base, rng = 1_700_000_000, random.Random(5)
    alerts = [(f"a{i}", f"u{i % 3}" if i else None, base + 600 * i) for i in range(20)]
    events = [(f"u{j % 3}", base + 300 * j, f"e{j:02d}") for j in range(40)]

    def mixed(rows, at, schema, column, folder):
        # Up to 3000 s out of order, in three files; the last one has one row that is much too late.
        rows = sorted(rows, key=lambda r: r[at] + rng.randrange(3000))
        cut = len(rows) // 3
        frames = [spark.createDataFrame(part, schema).withColumn(column, F.timestamp_seconds(column)) for part in (rows[:cut], rows[cut : 2 * cut], rows[2 * cut :])]
        return as_stream(spark, frames, str(tmp_path / folder))

    a = mixed(alerts, 2, "alert_id string, username string, received_at long", "received_at", "a")
    e = mixed(events, 1, "username string, event_time long, event_id string", "event_time", "e")
    jobs.recent_events(a, e, str(tmp_path / "out"), str(tmp_path / "ckpt"), 60, 2, 6000).awaitTermination()
    got = {r["alert_id"]: r["event_ids"] for r in jobs.answered(spark, str(tmp_path / "out")).collect()}
    want = {}
    for name in ("u0", "u1", "u2"):
        want |= brute_answers([(t, i) for i, u, t in alerts if u == name], [(t, i) for u, t, i in events if u == name], 3600, 2)
    assert got == want


def test_late_alerts_are_answered_and_late_events_listed(spark, tmp_path):
    first = spark.createDataFrame([("a1", "u", 1000), ("a2", "u", 90_000)], "alert_id string, username string, s long")
    second = spark.createDataFrame([("a3", "u", 2000)], "alert_id string, username string, s long")
    a = as_stream(spark, [df.withColumn("received_at", F.timestamp_seconds("s")).drop("s") for df in (first, first.limit(0), second)], str(tmp_path / "a"))
    rows = [[("u", 900, "e1"), ("u", 90_000, "e2")], [("u", 90_001, "e4")], [("u", 1500, "e3")]]
    e = as_stream(spark, [spark.createDataFrame(r, "username string, s long, event_id string").withColumn("event_time", F.timestamp_seconds("s")).drop("s") for r in rows], str(tmp_path / "e"))
    out = str(tmp_path / "out")
    jobs.recent_events(a, e, out, str(tmp_path / "ckpt"), 60, 5, 60).awaitTermination()
    got = {r["alert_id"]: (r["late"], r["event_ids"]) for r in jobs.answered(spark, out).collect()}
    assert got["a1"] == (False, ["e1"]) and got["a2"] == (False, ["e2"]) and got["a3"][0] and set(got) == {"a1", "a2", "a3"}
    assert [r["id"] for r in spark.read.parquet(out).filter("kind = 'late_event'").collect()] == ["e3"]


def test_delivery_keeps_undeliverable_rows(spark, tmp_path):
    rows = alert_rows(spark, [{"n": i} for i in range(120)]).select(
        F.struct(*queues.STORED_ALERT).alias("alert"), F.lit("test").alias("runbook"), F.col("received_at").alias("enriched_at"),
        F.lit("{}").alias("extracted"), F.lit(None).cast("string").alias("runbook_error"),
        F.when(F.col("alert_id").cast("int") % 10 == 0, "universal").otherwise("splunk").alias("destination"),
    )
    parts = [rows.filter(F.col("alert.alert_id").cast("int") % 2 == i) for i in range(2)]
    out, lost, ckpt = (str(tmp_path / n) for n in ("out", "lost", "ckpt"))
    jobs.deliver(as_stream(spark, parts, str(tmp_path / "in")), out, lost, ckpt, universal_configured=False).awaitTermination()
    sent = spark.read.parquet(out)
    assert sent.agg(F.sum("events")).first()[0] == 108 and sent.agg(F.max("events")).first()[0] <= 50
    assert spark.read.parquet(lost).count() == 12


def logged_send(folder, replies, breaks=None):
    """A sender that notes every call in a file of its own, and answers with the next status for a payload's first alert."""
    import json
    import uuid

    def send(text, payload_id):
        first = json.loads(text.split("\n")[0])["event"]["alert"]["id"]
        before = sum(f.startswith(f"{first}-") for f in os.listdir(folder))
        with open(f"{folder}/{first}-{uuid.uuid4().hex}", "w") as f:
            f.write(payload_id)
        if breaks and first == breaks[0] and not os.path.exists(breaks[1]):
            open(breaks[1], "w").close()
            raise SystemExit("the task is lost")
        answer = replies.get(first, [200])
        answer = answer[min(before, len(answer) - 1)]
        if answer is None:
            raise OSError("no route")
        return answer

    return send


def enriched_rows(spark, n):
    # Ids of three digits, so that their order as text is that of their numbers.
    return alert_rows(spark, [{"n": i} for i in range(n)]).withColumn("alert_id", F.lpad("alert_id", 3, "0")).select(
        F.struct(*queues.STORED_ALERT).alias("alert"), F.lit("test").alias("runbook"), F.col("received_at").alias("enriched_at"),
        F.lit("{}").alias("extracted"), F.lit(None).cast("string").alias("runbook_error"),
        F.when(F.col("alert_id") < "100", "hook").when(F.col("alert_id") < "110", "other").otherwise(F.lit(None)).alias("destination"),
    )


def calls(folder):
    return collections.Counter(f.split("-")[0] for f in os.listdir(folder))


def test_a_destination_of_the_callers_own(spark, tmp_path):
    folder, path = str(tmp_path / "calls"), str(tmp_path / "out")
    os.makedirs(folder)
    replies = {"010": [503, 200], "020": [404], "030": [None, None, None], "040": [429, None, 201]}

    def envelope(settings):
        return F.struct(F.lit(settings.host).alias("from"), F.struct(F.struct(F.col("alert.alert_id").alias("id")).alias("alert")).alias("event"))

    hook = sending.Destination("hook", logged_send(folder, replies), envelope, batch_size=10, pause=0.0, senders=3)
    stream = as_stream(spark, [enriched_rows(spark, 112)], str(tmp_path / "in"))
    sending.deliver_to(stream, [hook], path, str(tmp_path / "ckpt")).awaitTermination()
    got = {r["batch"]: (r["outcome"], r["attempts"], r["last_status"], r["events"], r["last_error"]) for r in spark.read.parquet(f"{path}/outcomes").collect()}
    want = {b: ("delivered", 1, 200, 10, None) for b in range(10)}
    want |= {1: ("delivered", 2, 200, 10, None), 2: ("permanent_error", 1, 404, 10, None), 4: ("delivered", 3, 201, 10, None)}
    want[3] = ("failed", 3, 0, 10, "OSError: no route")
    assert got == want
    assert calls(folder) == {f"{10 * b:03d}": want[b][1] for b in range(10)}
    rest = spark.read.parquet(f"{path}/undelivered").select("undeliverable").collect()
    assert collections.Counter(r[0] for r in rest) == {"no client for destination other": 10, "no client for destination null": 2}


def test_a_failed_job_sends_nothing_again_that_its_tasks_have_noted(spark, tmp_path):
    folder, path = str(tmp_path / "calls"), str(tmp_path / "out")
    os.makedirs(folder)
    send = logged_send(folder, {}, ("050", str(tmp_path / "broken")))
    hook = sending.Destination("hook", send, batch_size=10, pause=0.0, senders=10)
    stream = as_stream(spark, [enriched_rows(spark, 100)], str(tmp_path / "in"))
    with pytest.raises(Exception):
        sending.deliver_to(stream, [hook], path, str(tmp_path / "ckpt")).awaitTermination()
    noted = {f"{10 * r['batch']:03d}" for r in spark.read.schema(sending.ATTEMPT).parquet(f"{path}/ledger/destination=hook/batch_id=0").collect()}
    before = calls(folder)
    assert "050" not in noted and set(before) >= noted
    sending.deliver_to(stream, [hook], path, str(tmp_path / "ckpt")).awaitTermination()
    outcomes = spark.read.parquet(f"{path}/outcomes").collect()
    assert len(outcomes) == 10 and {r["outcome"] for r in outcomes} == {"delivered"}
    after = calls(folder)
    assert all(after[k] == before[k] for k in noted) and after["050"] == 2
    # A further start has nothing to do.
    sending.deliver_to(stream, [hook], path, str(tmp_path / "ckpt")).awaitTermination()
    assert calls(folder) == after


def test_rates_count_late_rows_in_their_windows(spark, tmp_path):
    rows = spark.range(300).selectExpr("concat('a', id) AS alert_id", "if(id % 3 = 0, 'q1', 'q2') AS queue", "timestamp_seconds(id) AS received_at")
    late = rows.filter("received_at < timestamp_seconds(40)")
    parts = [rows.filter("received_at BETWEEN timestamp_seconds(40) AND timestamp_seconds(179)"), rows.filter("received_at >= timestamp_seconds(180)").unionByName(late)]
    out = str(tmp_path / "out")
    jobs.rates(as_stream(spark, parts, str(tmp_path / "in")), out, str(tmp_path / "ckpt"), 100, fold_every=2).awaitTermination()
    got = jobs.current_rates(spark, out)
    want = jobs.windowed_rates(rows).select("window_start", "queue", "alerts", "rate")
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, want.collect()))
    # Behind 179 - 100 seconds are those before second 79, of which the second batch has the first forty.
    assert got.agg(F.sum("late")).first()[0] == 40
    assert {r["alert_id"] for r in spark.read.parquet(f"{out}/late").collect()} == {f"a{i}" for i in range(40)}


def test_append_new_keeps_alerts_without_a_time(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, "p"), ("a", None, "p"), ("b", None, "q"), ("b", 7, "r"), ("b", 9, "s"), ("c", 1, "t")],
        "alert_id string, t int, raw_payload string").select("alert_id", F.timestamp_seconds("t").alias("received_at"), "raw_payload")
    out = str(tmp_path / "out")
    jobs.append_new(as_stream(spark, [rows], str(tmp_path / "in")), out, str(tmp_path / "ckpt")).awaitTermination()
    got = spark.read.parquet(out).selectExpr("alert_id", "unix_seconds(received_at)", "raw_payload")
    assert sorted(map(tuple, got.collect())) == [("a", None, "p"), ("b", 7, "r"), ("c", 1, "t")]


def test_batches_of_a_stream_are_several_files_in_order(spark, tmp_path, monkeypatch):
    """A batch that is one small file is read and parsed by one task, whatever the size of the table."""
    from checks import registry

    monkeypatch.setattr(registry, "STREAM_FILE_ROWS", 20)
    events = spark.range(401).selectExpr(
        "if(id = 400, NULL, id) AS event_id", "timestamp_seconds(id) AS ts", "id % 7 AS user_id", "'view' AS event_type", "0D AS value", "'' AS props"
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    stream = registry.event_stream(spark, str(tmp_path), "lookups")
    seen = {}

    def write(batch, batch_id):
        rows = batch.selectExpr("lookup_id", "input_file_name() AS file").collect()
        seen[batch_id] = (sorted(r["lookup_id"] for r in rows), len({r["file"] for r in rows}))

    jobs._each_batch(stream, str(tmp_path / "ckpt"), write).awaitTermination()
    assert seen == {i: (list(range(i, 400, 4)), 5) for i in range(4)}


def test_names_of_a_bucket_share_one_state(spark, tmp_path, monkeypatch):
    """Calls of the state functions are bounded by the buckets, and the names of one do not mix."""
    monkeypatch.setattr(history_state, "BUCKETS", 1)
    monkeypatch.setattr(cache_state, "BUCKETS", 1)
    base, rng = 1_700_000_000, random.Random(9)
    rows = [(rng.randrange(3000), f"u{rng.randrange(9)}", i) for i in range(300)]
    schema = "at long, username string, id long"
    parts = [spark.createDataFrame(rows[i::3], schema).withColumn("at", F.timestamp_seconds(F.col("at") + base)) for i in range(3)]
    both = as_stream(spark, parts, str(tmp_path / "in"))
    asked = both.filter("id % 3 = 0").selectExpr("concat('a', id) AS alert_id", "username", "at AS received_at")
    known = both.selectExpr("username", "at AS event_time", "format_string('e%03d', id) AS event_id")
    out = str(tmp_path / "out")
    query = jobs.recent_events(asked, known, out, str(tmp_path / "ckpt"), 10, 3, 3600)
    query.awaitTermination()
    got = {r["alert_id"]: r["event_ids"] for r in jobs.answered(spark, out).collect()}
    want = {}
    for name in {n for _, n, _ in rows}:
        mine = [(at, f"a{i}") for at, n, i in rows if n == name and i % 3 == 0]
        want |= brute_answers(mine, [(at, f"e{i:03d}") for at, n, i in rows if n == name], 600, 3)
    assert got == want
    assert {p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]} == {1}

    second = 1000000
    batches = [[(f"k{i % 9}", (i * 7 % 100) * second, 1000 + i, i % 5 > 0) for i in range(b, 200, 3)] for b in range(3)]
    stream = as_stream(spark, [lookup_frame(spark, part) for part in batches], str(tmp_path / "lookups"))
    queries = jobs.replay_ttl(stream, 10 * second, str(tmp_path / "ttl"), str(tmp_path / "ttl-ckpt"), 600)
    for q in queries:
        q.awaitTermination()
    served = {(int(r["lookup_id"]), r["hit"], int(r["served_by"])) for r in jobs.replayed_ttl(spark, str(tmp_path / "ttl"), 10 * second).collect()}
    assert served == {(i, *v) for i, v in brute_replay([r for b in batches for r in b], 10 * second).items()}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in queries[1].recentProgress if p["stateOperators"]) == 1
