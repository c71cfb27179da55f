"""State of the resources an actor has changed, as it was when the alert came in."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.functions import identity as I
from alertweave.functions import payload as P
from alertweave.operators.asof import newest_before
from alertweave.session import materialise

# The Arrow function below travels to the executors with its helpers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Which events change which kind of resource.
INSPECTED_EVENTS = [
    ("s3.amazonaws.com", "PutObject", "s3:object"),
    ("s3.amazonaws.com", "DeleteObject", "s3:object"),
    ("s3.amazonaws.com", "CopyObject", "s3:object"),
    ("iam.amazonaws.com", "CreateUser", "iam:user"),
    ("iam.amazonaws.com", "UpdateUser", "iam:user"),
    ("iam.amazonaws.com", "DeleteUser", "iam:user"),
    ("iam.amazonaws.com", "CreateRole", "iam:role"),
    ("iam.amazonaws.com", "UpdateRole", "iam:role"),
    ("iam.amazonaws.com", "DeleteRole", "iam:role"),
    ("ec2.amazonaws.com", "RunInstances", "ec2:instance"),
]


def resource_type(event: Column) -> Column:
    """Kind of resource the event changes, NULL for events nobody inspects."""
    called = F.concat_ws("|", P.string_at(event, "$.eventSource"), P.string_at(event, "$.eventName"))
    names = {kind: [f"{s}|{n}" for s, n, k in INSPECTED_EVENTS if k == kind] for _, _, kind in INSPECTED_EVENTS}
    kind = F.lit(None).cast("string")
    for name, calls in names.items():
        kind = F.when(called.isin(calls), F.lit(name)).otherwise(kind)
    return kind


def resource_keys(event: Column, kind: Column) -> Column:
    """Keys of the changed resources; an empty list when the event does not name them."""

    def text(path: str) -> Column:
        return F.when(P.truthy(event, path), P.as_text(event, path))

    def one(prefix: str, name: Column) -> Column:
        return F.when(name.isNotNull(), F.array(F.concat(F.lit(prefix), name)))

    items = F.try_variant_get(event, "$.responseElements.instancesSet.items", "array<variant>")
    named = F.filter(items, lambda i: P.truthy(i, "$.instanceId"))
    instances = F.transform(named, lambda i: F.concat(F.lit("ec2:instance:"), P.as_text(i, "$.instanceId")))
    keys = (
        F.when(
            kind == "s3:object",
            one("s3:object:", F.concat(text("$.requestParameters.bucketName"), F.lit("/"), text("$.requestParameters.key"))),
        )
        .when(kind == "iam:user", one("iam:user:", text("$.requestParameters.userName")))
        .when(kind == "iam:role", one("iam:role:", text("$.requestParameters.roleName")))
        .when(kind == "ec2:instance", instances)
    )
    return F.coalesce(keys, F.array().cast("array<string>"))


def strip_response_metadata(payload: Column) -> Column:
    """Drops the transport part of a described resource, ``map<string,variant>`` from JSON text."""
    return F.map_filter(F.from_json(payload, "map<string,variant>"), lambda k, _: k != "ResponseMetadata")


def load_resources(raw: DataFrame) -> DataFrame:
    """``resource_key, valid_from, valid_to, payload``, the payload without its transport part."""
    return raw.select(
        "resource_key", "valid_from", "valid_to", F.to_json(strip_response_metadata(F.col("payload"))).alias("payload")
    )


@dataclass(frozen=True)
class Stored:
    """Resource versions as stored. Payloads are read (``load_resources``) of the versions alone that some moment can see.

    A table from ``load_resources`` does as well, but a join is not moved below a computed column, so all its payloads are read.
    """

    raw: DataFrame


def named_targets(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per write and resource key of column ``writes``: ``keep, position, event_name, resource_key``."""
    written = rows.select(*keep, F.posexplode("writes").alias("position", "event"))
    kinds = P.compute(written, kind=resource_type(F.col("event"))).filter(F.col("kind").isNotNull())
    return kinds.select(
        *keep,
        "position",
        F.coalesce(P.string_at(F.col("event"), "$.eventName"), F.lit("?")).alias("event_name"),
        F.explode(resource_keys(F.col("event"), F.col("kind"))).alias("resource_key"),
    )


def targets(alerts: DataFrame) -> DataFrame:
    """One row per write and resource key: ``alert_id, at, position, event_name, resource_key``."""
    return named_targets(alerts.withColumn("at", F.unix_micros("received_at")), "alert_id", "at")


_FOREVER = (1 << 63) - 1

VISIBLE = "resource_key string, seen_from bigint, seen_to bigint, valid_from bigint"


def _sweep(batches: Iterator) -> Iterator:
    """Stretches of time in which each version is the one that counts, from versions sorted by key and start.

    One pass with a stack of the versions that began and have not ended, the newest on top. A version that begins takes
    those off which end no later, as they are hidden for good, so ends grow from top to bottom; where the top ends, the one
    below shows again. Every version is put on and taken off once.
    """
    import pyarrow as pa

    current, since = None, 0
    stack: list[tuple[int, int]] = []  # (valid_to, valid_from)
    out: list[tuple] = []

    def show(until: int) -> None:
        """Report what is seen from ``since`` to ``until``."""
        nonlocal since
        while stack and since < until:
            ends, began = stack[-1]
            if ends > since:
                out.append((current, since, min(ends, until), began))
                since = min(ends, until)
            if ends <= until:
                stack.pop()
        since = until

    def emitted() -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), (), ()]
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = ["resource_key", "seen_from", "seen_to", "valid_from"]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        out.clear()
        return made

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("resource_key", "valid_from", "valid_to"))
        for key, began, ends in zip(*columns):
            if key != current:
                show(_FOREVER)
                stack.clear()
                current, since = key, began
            show(began)
            while stack and stack[-1][0] <= ends:
                stack.pop()
            stack.append((ends, began))
        if out:
            yield emitted()
    show(_FOREVER)
    yield emitted()


def visible(versions: DataFrame) -> DataFrame:
    """``resource_key, valid_from, valid_to`` (one row a key and start) -> disjoint stretches with the version that counts."""
    ordered = versions.select("resource_key", "valid_from", "valid_to").filter("valid_from < valid_to")
    return (
        ordered.repartition("resource_key")
        .sortWithinPartitions("resource_key", "valid_from")
        .mapInArrow(_sweep, VISIBLE)
    )


def _in_reach(versions: DataFrame, moments: DataFrame) -> DataFrame:
    """Versions that neither ended before the first moment of their key nor begin after the last."""
    spans = moments.groupBy(F.col("resource_key").alias("_key")).agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    begun = F.unix_micros("valid_from") <= F.col("_last")
    lasting = F.col("valid_to").isNull() | (F.unix_micros("valid_to") > F.col("_first"))
    return versions.join(spans, (F.col("resource_key") == F.col("_key")) & begun & lasting, "left_semi")


def state_at(moments: DataFrame, resources: DataFrame | Stored) -> DataFrame:
    """The version of each ``resource_key`` valid at ``at`` (microseconds), ``valid_from <= at < valid_to``.

    Of several valid versions the one that began last counts; of those that began together the one that ends last,
    then the one with the greatest payload. So an old version shows again where a later one has ended within it: the versions
    are swept into disjoint stretches first, and one as-of look-up finds the stretch of a moment. Versions that ended before the
    first moment of their key or begin after the last hide nothing from any moment, and go before their payload is read.
    """
    wanted = moments.select("resource_key", "at").distinct()
    if isinstance(resources, Stored):
        versions = load_resources(_in_reach(resources.raw, wanted))
    else:
        versions = _in_reach(resources, wanted)
    versions = versions.select(
        "resource_key",
        F.unix_micros("valid_from").alias("valid_from"),
        F.coalesce(F.unix_micros("valid_to"), F.lit(_FOREVER)).alias("valid_to"),
        "payload",
    )
    # A version that begins with another and ends first is never seen.
    versions = materialise(
        versions.groupBy("resource_key", "valid_from")
        .agg(F.max(F.struct("valid_to", "payload")).alias("v"))
        .select("resource_key", "valid_from", "v.valid_to", "v.payload"),
        "versions",
    )
    facts = visible(versions).select(
        F.col("resource_key").alias("key"), F.col("seen_from").alias("at"), F.struct("seen_to", "valid_from").alias("fact_id")
    )
    newest = newest_before(wanted.select(F.col("resource_key").alias("key"), "at"), facts, 1, None)
    seen = newest.filter(F.col("at") < F.col("fact_id.seen_to")).select(
        F.col("key").alias("resource_key"), "at", F.col("fact_id.valid_from").alias("valid_from")
    )
    return seen.join(versions, ["resource_key", "valid_from"]).select("resource_key", "at", "payload")


def looked_up(wanted: DataFrame, resources: DataFrame | Stored) -> DataFrame:
    """``targets`` with the ``payload`` of each resource, NULL where none was valid."""
    return wanted.join(state_at(wanted.select("resource_key", "at"), resources), ["resource_key", "at"], "left")


def inspected(found: DataFrame) -> DataFrame:
    """Per alert: ``inspected_objects`` (key -> payload) and ``inspection_errors``.

    A write with a target that cannot be found adds one error and no object; for a repeated key the later
    write counts. One shuffle by alert serves all three steps.
    """
    write = Window.partitionBy("alert_id", "position")
    marked = found.repartition("alert_id").withColumn(
        "missing", F.min(F.when(F.col("payload").isNull(), F.col("resource_key"))).over(write)
    )
    problem = F.struct(
        "position",
        F.lit("object_inspection").alias("enricher"),
        F.concat("event_name", F.lit(" target inspection failed: no state of "), "missing").alias("error"),
        F.lit("ResourceNotFound").alias("type"),
    )
    complete = F.col("missing").isNull()
    per_key = marked.groupBy("alert_id", "resource_key").agg(
        F.max_by(F.when(complete, F.col("payload")), F.when(complete, F.col("position"))).alias("payload"),
        F.collect_set(F.when(F.col("missing") == F.col("resource_key"), problem)).alias("problems"),
    )
    entry = F.struct(F.col("resource_key").alias("key"), F.col("payload").alias("value"))
    per_alert = per_key.groupBy("alert_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("payload").isNotNull(), entry))).alias("_objects"),
        F.array_sort(F.flatten(F.collect_list("problems"))).alias("_problems"),
    )
    return per_alert.select(
        "alert_id",
        F.map_from_entries("_objects").alias("inspected_objects"),
        F.transform(
            "_problems",
            lambda e: F.struct(e["enricher"].alias("enricher"), e["error"].alias("error"), e["type"].alias("type")),
        ).cast(f"array<{I.ERROR_TYPE}>").alias("inspection_errors"),
    )


def with_inspection(alerts: DataFrame, resources: DataFrame | Stored) -> DataFrame:
    """Adds ``inspected_objects`` and ``inspection_errors``, both empty where there was nothing to inspect."""
    return inspect(alerts, targets(alerts), resources)


def inspect(alerts: DataFrame, wanted: DataFrame, resources: DataFrame | Stored) -> DataFrame:
    """As ``with_inspection``, given the targets of the alerts; columns of the alerts are only carried along."""
    found = inspected(looked_up(materialise(wanted, "targets"), resources))
    return alerts.join(found, "alert_id", "left").select(
        *alerts.columns,
        F.coalesce(F.col("inspected_objects"), F.expr("cast(map() as map<string,string>)")).alias("inspected_objects"),
        F.coalesce(F.col("inspection_errors"), F.array().cast(f"array<{I.ERROR_TYPE}>")).alias("inspection_errors"),
    )
