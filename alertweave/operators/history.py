"""What an actor did shortly before an alert, and which of it changed something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.functions import identity as I
from alertweave.functions import payload as P
from alertweave.operators import ttl
from alertweave.operators.asof import newest_before
from alertweave.session import materialise

HISTORY_ITEM = "struct<event_id:string,event_time:timestamp,cloudtrail_event:string>"


def identify(alerts: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``principal`` and ``identity_error``; the second is set where the first is not."""
    read = P.compute(alerts, _given=P.field(F.col(payload), "$.userIdentity"))
    read = P.compute(read, _ui=F.when(P.is_object(F.col("_given")), F.col("_given")))
    read = I.add_principal_aws(read, "_ui")
    known = F.col("_ui").isNotNull()
    problem = F.struct(
        F.lit("principal_identity").alias("enricher"),
        F.when(known, F.col("problem")).otherwise(F.lit("alert payload missing userIdentity")).alias("error"),
        F.when(known, F.lit("ValueError")).otherwise(F.lit("PreconditionError")).alias("type"),
    ).cast(I.ERROR_TYPE)
    read = P.compute(
        read.drop("_given"),
        _principal=F.when(known, F.col("principal")),
        identity_error=F.when(~known | F.col("problem").isNotNull(), problem),
    )
    return read.select(*alerts.columns, F.col("_principal").alias("principal"), "identity_error")


def eligibility(identified: DataFrame) -> DataFrame:
    """Adds ``eligible`` and ``history_error``: why an alert gets no history look-up."""
    who = F.col("principal")
    supported = I.history_supported(who)
    missing = F.struct(
        F.lit("principal_history").alias("enricher"),
        F.lit("no principal — run after PrincipalIdentityEnricher").alias("error"),
        F.lit("PreconditionError").alias("type"),
    )
    skipped = F.struct(
        F.lit("principal_history").alias("enricher"),
        F.concat(F.lit("skipped: unsupported provider="), who["provider"]).alias("error"),
        F.lit("PrincipalSkipped").alias("type"),
    )
    timeless = F.struct(
        F.lit("principal_history").alias("enricher"),
        F.lit("alert has no time to look back from").alias("error"),
        F.lit("PreconditionError").alias("type"),
    )
    no_time = F.col("received_at").isNull() if "received_at" in identified.columns else F.lit(False)
    return P.compute(
        identified,
        eligible=F.coalesce(supported, F.lit(False)) & ~no_time,
        history_error=F.when(who.isNull(), missing).when(~supported, skipped).when(no_time, timeless).cast(I.ERROR_TYPE),
    )


def audit_events_from_items(items: DataFrame, text: str = "item") -> DataFrame:
    """Look-up items as JSON text -> audit events. Items that are not objects are left out.

    ``CloudTrailEvent`` may be JSON text or an object already.
    """
    read = P.compute(items, _v=P.parse(F.col(text)))
    v = F.col("_v")
    event = P.field(v, "$.CloudTrailEvent")
    return read.filter(P.is_object(v)).select(
        P.string_at(v, "$.Username").alias("username"),
        P.string_at(v, "$.EventTime").try_cast("timestamp").alias("event_time"),
        P.string_at(v, "$.EventId").alias("event_id"),
        F.when(P.is_object(event), F.to_json(event))
        .otherwise(P.string_at(v, "$.CloudTrailEvent"))
        .alias("cloudtrail_event"),
    )


def history_pairs(
    alerts: DataFrame,
    audit_events: DataFrame,
    lookback_minutes: int = 60,
    max_results: int | None = 50,
) -> DataFrame:
    """``username, at`` of every distinct look-up with its events, newest first as ``place`` 1, 2, ...

    ``alerts`` has ``username, received_at``. Look-ups of one name at one instant share their result, so they are
    asked for once.
    Without ``max_results`` a look-up gets all events of its look-back.
    """
    if lookback_minutes <= 0 or (max_results is not None and max_results <= 0):
        raise ValueError("the look-back and the number of results must be positive")
    probes = alerts.select(F.col("username").alias("key"), F.unix_micros("received_at").alias("at"))
    probes = materialise(probes.filter(F.col("key").isNotNull() & F.col("at").isNotNull()).distinct(), "probes")
    facts = _in_reach(audit_events, probes, lookback_minutes).join(
        probes.select(F.col("key").alias("username")).distinct(), "username", "left_semi"
    ).select(
        F.col("username").alias("key"), F.unix_micros("event_time").alias("at"), F.col("event_id").alias("fact_id")
    )
    found = newest_before(probes, facts, max_results, lookback_minutes * 60 * 1000000)
    return found.select(
        F.col("key").alias("username"), "at", F.col("fact_id").alias("event_id"),
        F.timestamp_micros("fact_at").alias("event_time"), "place",
    )


def _in_reach(audit_events: DataFrame, probes: DataFrame, lookback_minutes: int) -> DataFrame:
    """Audit events that some look-up (``at``, microseconds) can see, as constants that reach the scan."""
    first, last = probes.agg(F.min("at"), F.max("at")).first()
    if first is None:
        return audit_events.filter(F.lit(False))
    reach = [F.timestamp_micros(F.lit(t)) for t in (first - lookback_minutes * 60 * 1000000, last)]
    return audit_events.filter(F.col("event_time").between(*reach))


def histories(pairs: DataFrame, audit_events: DataFrame) -> DataFrame:
    """One row per look-up: ``username, at, events``, newest first.

    Event texts are joined to the found pairs only, and once. Copies of one event (same name, time and id) have one text.
    """
    text = audit_events.select("username", "event_time", "event_id", "cloudtrail_event")
    item = F.struct("place", F.struct("event_id", "event_time", "cloudtrail_event").alias("item"))
    collected = (
        pairs.join(text, ["username", "event_time", "event_id"])
        .groupBy("username", "at")
        .agg(F.array_sort(F.collect_set(item)).alias("_events"))
    )
    # Of copies the last in order, which has the greatest text.
    last = F.filter(
        "_events", lambda e, i: ~F.coalesce(F.get("_events", i + 1)["place"] == e["place"], F.lit(False))
    )
    return collected.select("username", "at", last.alias("_events")).select(
        "username", "at", F.col("_events.item").cast(f"array<{HISTORY_ITEM}>").alias("events")
    )


NO_EVENTS = f"array<{HISTORY_ITEM}>"


def lookups(
    alerts: DataFrame,
    audit_events: DataFrame,
    ttl_seconds: int | None,
    lookback_minutes: int = 60,
    max_results: int | None = 50,
) -> tuple[DataFrame, DataFrame]:
    """``alert_id, anchor_id, cache_hit`` of every eligible alert, and ``anchor_id, events`` of every look-up made for them.

    An alert refers to the look-up that serves it, and the texts of that look-up stand once, however many alerts it
    serves. With ``ttl_seconds`` the cache is replayed first, and alerts of one principal within the life of a look-up share
    it. Without, alerts of one name and instant do, and ``cache_hit`` is NULL.
    """
    asked = alerts.filter("eligible").select(
        I.principal_key(F.col("principal")).alias("key"),
        F.unix_micros("received_at").alias("at"),
        F.col("alert_id").alias("lookup_id"),
        F.lit(True).alias("lookup_ok"),
        I.lookup_username(F.col("principal")).alias("username"),
        "received_at",
    )
    if ttl_seconds is None:
        first = F.min("lookup_id").over(Window.partitionBy("username", "at"))
        asked = materialise(asked.withColumn("served_by", first).withColumn("hit", F.lit(None).cast("boolean")), "asked")
        anchors = asked.filter(F.col("lookup_id") == F.col("served_by"))
    else:
        asked = materialise(ttl.replay(asked, ttl_seconds * 1000000), "replayed")
        anchors = asked.filter(~F.col("hit"))
    pairs = materialise(history_pairs(anchors, audit_events, lookback_minutes, max_results), "pairs")
    found = anchors.join(histories(pairs, _in_reach(audit_events, pairs, lookback_minutes)), ["username", "at"], "left").select(
        F.col("lookup_id").alias("anchor_id"), F.coalesce(F.col("events"), F.array().cast(NO_EVENTS)).alias("events")
    )
    served = asked.select(F.col("lookup_id").alias("alert_id"), F.col("served_by").alias("anchor_id"), F.col("hit").alias("cache_hit"))
    return served, found


def with_history(
    alerts: DataFrame,
    audit_events: DataFrame,
    lookback_minutes: int = 60,
    max_results: int | None = 50,
) -> DataFrame:
    """Adds ``events`` to eligible alerts (``eligible, principal, received_at``); an empty list where none is found,
    NULL where there is no principal. Every row gets a copy of its texts; ``lookups`` keeps references."""
    served, found = lookups(alerts, audit_events, None, lookback_minutes, max_results)
    return _with_texts(alerts, served, found).drop("cache_hit", "served_by")


def with_cached_history(
    alerts: DataFrame,
    audit_events: DataFrame,
    ttl_seconds: int = 900,
    lookback_minutes: int = 60,
    max_results: int | None = 50,
) -> DataFrame:
    """As ``with_history``, but alerts of one principal within the life of a look-up reuse its result.

    The cache is replayed first, so history is looked up for the anchors only. Adds ``cache_hit`` and ``served_by``.
    """
    return _with_texts(alerts, *lookups(alerts, audit_events, ttl_seconds, lookback_minutes, max_results))


def _with_texts(alerts: DataFrame, served: DataFrame, found: DataFrame) -> DataFrame:
    rows = alerts.join(served, "alert_id", "left").join(found, "anchor_id", "left")
    return rows.select(
        *alerts.columns,
        shown_events(F.col("principal")).alias("events"),
        "cache_hit",
        F.col("anchor_id").alias("served_by"),
    )


def shown_events(principal: Column) -> Column:
    """Column ``events`` as it is shown: NULL without a principal, empty where no look-up was made."""
    return F.when(principal.isNotNull(), F.coalesce(F.col("events"), F.array().cast(NO_EVENTS)))


def successful_writes(alerts: DataFrame) -> DataFrame:
    """Adds ``writes`` (events with ``readOnly`` false and no ``errorCode`` key, in history order),
    ``unreadable`` and ``write_error``."""
    nothing = F.array().cast("array<variant>")
    texts = F.transform("events", lambda item: P.parse(item["cloudtrail_event"]))
    parsed = P.compute(alerts, _parsed=F.coalesce(texts, nothing))
    parsed = P.compute(parsed, _objects=F.filter("_parsed", P.is_object))

    def succeeded(v: Column) -> Column:
        return P.is_false(v, "$.readOnly") & ~P.has_key(v, "$.errorCode")

    parsed = P.compute(
        parsed,
        writes=F.filter("_objects", succeeded),
        unreadable=F.size("_parsed") - F.size("_objects"),
    )
    return parsed.select(*alerts.columns, "writes", "unreadable", write_error().alias("write_error"))


def write_error() -> Column:
    """The error record of column ``unreadable``, NULL where every entry was read."""
    text = F.concat(F.lit("failed to parse "), F.col("unreadable").cast("string"), F.lit(" CloudTrailEvent entries"))
    problem = F.struct(F.lit("write_filter").alias("enricher"), text.alias("error"), F.lit("PartialParseFailure").alias("type"))
    return F.when(F.col("unreadable") > 0, problem.cast(I.ERROR_TYPE))
