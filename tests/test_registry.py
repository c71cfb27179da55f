"""Registered queries against DuckDB on the small data; ``ALL_QUERIES=1`` runs every one of them."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "routing_summary", "sqs_normalize", "universal_normalize", "route_alerts", "principal_aws", "history_top_n", "ttl_replay",
    "counters_all", "overview", "latest_snapshot", "delivery_outcome", "batch_number", "stream_route", "hec_batches", "stats_every_n",
    "metric_events", "runbook_failures", "inspect_resources", "enriched_assemble", "cached_history", "stream_ttl", "stream_counters",
    "stream_windowed_rates", "stream_late_alerts", "stream_destinations",
]
NAMES = sorted(entry_point.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def shown(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in row) for row in rows)


def test_every_query_has_a_check():
    without = set(entry_point.queries()) - set(entry_point.oracle_sql())
    assert not {n for n in without if not re.match(r"op\d+_|pipeline$", n)}


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = duck.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert shown(df.select(*[f"`{c}`" for c in columns]).collect()) == shown([tuple(r[i] for i in order) for r in result.fetchall()])


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
