"""Runbooks: what is done with the alerts of one queue, as a chain of DataFrame steps."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave import settings as S
from alertweave.functions import identity as I
from alertweave.functions import payload as P
from alertweave.operators import extract, history, resources
from alertweave.operators.queues import STORED_ALERT, earliest
from alertweave.plans import guard
from alertweave.plans.guard import RowFunction
from alertweave.session import materialise

Step = Callable[[DataFrame], DataFrame]
SharedStep = Callable[[DataFrame, dict[str, DataFrame]], DataFrame]

NO_ERRORS = f"array<{I.ERROR_TYPE}>"


@dataclass(frozen=True)
class Enricher:
    """A step that adds columns to the alerts of a runbook; ``error`` names the error column it adds, if any.

    A step with ``shared`` also gets a dictionary from a key column to a table with that column. What many alerts have in common, or
    is long, goes there; the alerts carry the key, and each table is joined once, when the rows are put together.
    """

    name: str
    transform: Step | SharedStep = field(repr=False)
    depends_on: tuple[str, ...] = ()
    error: str | None = None
    shared: bool = False


def in_order(enrichers: Iterable[Enricher]) -> list[Enricher]:
    """Every enricher after those it depends on, otherwise as given."""
    waiting = list(enrichers)
    names = [e.name for e in waiting]
    if len(set(names)) != len(names):
        raise ValueError("enricher names must be unique")
    unknown = {d for e in waiting for d in e.depends_on} - set(names)
    if unknown:
        raise ValueError(f"unknown enrichers: {sorted(unknown)}")
    done: list[Enricher] = []
    while waiting:
        ready = [e for e in waiting if set(e.depends_on) <= {d.name for d in done}]
        if not ready:
            raise ValueError(f"circular dependency among {[e.name for e in waiting]}")
        done.append(ready[0])
        waiting.remove(ready[0])
    return done


@dataclass(frozen=True)
class Runbook:
    """``fields`` reads the payload; ``more`` turns the columns of the enrichers into further extracted fields.

    ``failure`` gives the reason, as text, why the payload of a row cannot be handled, and NULL where it can. Fields read by a
    function (``guard.RowFunction``) fail by raising. A row that fails keeps its alert, carries the reason as ``runbook_error``, goes
    through no enricher, and stops no other row. In a ``guarded`` runbook it is a finished row like any other; otherwise it
    counts as an error and is not delivered (``failed``).
    """

    name: str
    queue: str
    fields: Callable[[Column], Column] | RowFunction = field(repr=False)
    destination: str = "splunk"
    enrichers: tuple[Enricher, ...] = ()
    more: Callable[[], list[Column]] | None = field(default=None, repr=False)
    failure: Callable[[Column], Column] | None = field(default=None, repr=False)
    guarded: bool = True

    def _read(self, mine: DataFrame) -> DataFrame:
        """Adds ``_fields`` and ``_failure``; the first is NULL where the second is not."""
        if isinstance(self.fields, RowFunction):
            read = P.compute(mine, _made=self.fields(F.col("raw_payload")))
            return read.select(*mine.columns, F.col("_made.value").alias("_fields"), F.col("_made.failure").alias("_failure"))
        if self.failure is None:
            return mine.select("*", self.fields(F.col("payload")).alias("_fields"), F.lit(None).cast("string").alias("_failure"))
        read = P.compute(mine, _failure=self.failure(F.col("payload")))
        return read.select(*mine.columns, F.when(F.col("_failure").isNull(), self.fields(F.col("payload"))).alias("_fields"), "_failure")

    def enrich(self, routed: DataFrame, enriched_at: Column | None = None) -> DataFrame:
        """Alerts of this runbook's queue -> enriched rows."""
        mine = routed.filter(F.col("queue") == self.queue)
        if "payload" not in mine.columns:
            mine = P.compute(mine, payload=P.parse(F.col("raw_payload")))
        mine = self._read(mine)
        stamp = F.current_timestamp() if enriched_at is None else enriched_at
        rows = mine.select(*STORED_ALERT, "_fields", "_failure", stamp.alias("enriched_at"))
        none = F.array().cast(NO_ERRORS)
        if not self.enrichers:
            return self._assemble(rows.withColumn("enricher_errors", none), [])
        # The enrichment joins move ids and derived columns only; whole alerts are joined once, at the end.
        steps = in_order(self.enrichers)
        slim = mine.filter(F.col("_failure").isNull()).select("alert_id", "received_at", "payload")
        tables: dict[str, DataFrame] = {}
        for step in steps:
            slim = step.transform(slim, tables) if step.shared else step.transform(slim)
        found_errors = []
        for column in (s.error for s in steps if s.error):
            many = slim.schema[column].dataType.typeName() == "array"
            found_errors.append(F.coalesce(F.col(column), none) if many else F.array(column))
        extra = [c for c in slim.columns if c not in ("received_at", "payload")]
        errors = F.filter(F.concat(none, *found_errors), lambda e: e.isNotNull())
        # A row that failed has no enrichment.
        rows = rows.join(slim.select(*extra, errors.alias("enricher_errors")), "alert_id", "left")
        rows = rows.withColumn("enricher_errors", F.coalesce("enricher_errors", none))
        for key, table in tables.items():
            rows = rows.join(table, key, "left")
        return self._assemble(rows, self.more() if self.more else [])

    def _assemble(self, rows: DataFrame, more: list[Column]) -> DataFrame:
        errors = F.when(F.size("enricher_errors") > 0, F.col("enricher_errors"))
        is_struct = rows.schema["_fields"].dataType.typeName() == "struct"
        names = [f"_more{i}" for i in range(len(more))]
        if is_struct:
            kept = [F.when(F.col("_failure").isNull(), F.col(n)).alias(shown) for n, shown in zip(names, self._shown(rows, more))]
            extracted = P.render_present(F.struct("_fields.*", *kept, errors.alias("enricher_errors")))
        else:
            extracted = F.coalesce(F.to_json("_fields"), F.lit("{}"))
        hit = F.col("cache_hit") if "cache_hit" in rows.columns else F.lit(None).cast("boolean")
        return rows.select("*", *[c.alias(n) for c, n in zip(more, names)]).select(
            F.struct(*STORED_ALERT).alias("alert"),
            F.lit(self.name).alias("runbook"),
            "enriched_at",
            extracted.alias("extracted"),
            F.col("_failure").alias("runbook_error"),
            F.lit(self.destination).alias("destination"),
            "enricher_errors",
            hit.alias("cache_hit"),
        )

    @staticmethod
    def _shown(rows: DataFrame, more: list[Column]) -> list[str]:
        return rows.select(*more).columns


def row_enricher(
    name: str, function: Callable[..., dict | None], takes: Iterable[str], returns: str, depends_on: tuple[str, ...] = ()
) -> Enricher:
    """An enricher from a Python function of one alert: the values of the columns ``takes`` -> the new columns.

    The function runs in Arrow batches. Where it raises, the row goes on with NULL in the new columns and an error of this
    enricher, as it would with a built-in step.
    """
    call = RowFunction(function, returns)
    takes = tuple(takes)

    def step(df: DataFrame) -> DataFrame:
        made = P.compute(df, _made=call.of(df, takes))
        return made.select(*df.columns, "_made.value.*", guard.error_record(name, F.col("_made")).alias(f"{name}_error"))

    return Enricher(name, step, depends_on, f"{name}_error")


def failed(runbooks: Iterable[Runbook]) -> Column:
    """Which enriched rows are errors of runbooks that are not guarded."""
    open_ = [r.name for r in runbooks if not r.guarded]
    return F.col("runbook").isin(open_) & F.col("runbook_error").isNotNull() if open_ else F.lit(False)


def _cloudtrail_more() -> list[Column]:
    shown = F.transform(
        history.shown_events(F.col("principal")),
        lambda e: F.struct(
            e["event_id"].alias("EventId"),
            P.iso_utc(e["event_time"]).alias("EventTime"),
            e["cloudtrail_event"].alias("CloudTrailEvent"),
        ),
    )
    inspected = F.transform_values("inspected_objects", lambda _, p: P.parse(p))
    return [
        F.struct(
            shown.alias("principal_recent_events"),
            F.coalesce("writes", F.array().cast("array<variant>")).alias("successful_writes"),
            inspected.alias("inspected_objects"),
        ).alias("cloudtrail"),
        F.col("principal"),
    ]


def cloudtrail(
    audit_events: DataFrame, known_resources: DataFrame | resources.Stored, settings: S.Settings = S.DEFAULTS, cached: bool = True
) -> Runbook:
    """Identity, then recent activity, then the writes among it, then the state of what was written.

    Events and writes belong to a look-up, not to an alert: alerts carry ``anchor_id`` through the steps.
    """

    def identity(df: DataFrame) -> DataFrame:
        # Copies of an alert are enriched once, as of the earliest; the payload is gone before they are brought together.
        return earliest(history.identify(df).drop("payload"))

    def recent(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        eligible = materialise(history.eligibility(df), "identified")
        ttl_seconds = settings.cache_ttl_seconds if cached else None
        served, found = history.lookups(
            eligible, audit_events, ttl_seconds, settings.lookback_minutes, settings.history_max_results
        )
        tables["anchor_id"] = materialise(history.successful_writes(found).drop("write_error"), "look-ups")
        return materialise(eligible.join(served, "alert_id", "left"), "served")

    def writes(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        unread = tables["anchor_id"].filter("unreadable > 0").select("anchor_id", history.write_error().alias("write_error"))
        return df.join(unread, "anchor_id", "left")

    def inspection(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        named = resources.named_targets(tables["anchor_id"], "anchor_id")
        asked = df.select("alert_id", "anchor_id", F.unix_micros("received_at").alias("at"))
        return resources.inspect(df, asked.join(named, "anchor_id").drop("anchor_id"), known_resources)

    steps = (
        Enricher("principal_identity", identity, (), "identity_error"),
        Enricher("principal_history", recent, ("principal_identity",), "history_error", shared=True),
        Enricher("write_filter", writes, ("principal_history",), "write_error", shared=True),
        Enricher("object_inspection", inspection, ("write_filter",), "inspection_errors", shared=True),
    )
    return Runbook(
        "cloud.aws.cloudtrail", S.QUEUE_CLOUDTRAIL, extract.cloudtrail_fields, "splunk", steps, _cloudtrail_more
    )


def gcp_audit() -> Runbook:
    return Runbook("cloud.gcp.event_audit", S.QUEUE_GCP_AUDIT, extract.gcp_fields)


def test_echo() -> Runbook:
    return Runbook("test", S.QUEUE_TEST, lambda v: v)


def default_runbooks(
    audit_events: DataFrame, known_resources: DataFrame | resources.Stored, settings: S.Settings = S.DEFAULTS, cached: bool = True
) -> list[Runbook]:
    return [cloudtrail(audit_events, known_resources, settings, cached), gcp_audit(), test_echo()]


# Runbooks and the queues they read. Alerts of the other queues wait in their partition.
RUNBOOK_QUEUES = [
    ("cloud.aws.cloudtrail", S.QUEUE_CLOUDTRAIL),
    ("cloud.gcp.event_audit", S.QUEUE_GCP_AUDIT),
    ("test", S.QUEUE_TEST),
]


def runbook_table(spark: SparkSession, runbooks: Iterable[tuple[str, str]] = RUNBOOK_QUEUES) -> DataFrame:
    """``name, source_queue``; of runbooks with one name the first counts."""
    seen: dict[str, str] = {}
    for name, queue in runbooks:
        seen.setdefault(name, queue)
    return spark.createDataFrame(list(seen.items()), "name string, source_queue string")


def enrich_all(routed: DataFrame, runbooks: Iterable[Runbook], enriched_at: Column | None = None) -> DataFrame:
    """All runbooks side by side. On a table stored by queue each one reads its own partition only."""
    first, *rest = [r.enrich(routed, enriched_at) for r in runbooks]
    for other in rest:
        first = first.unionByName(other)
    return first


def force_destination(enriched: DataFrame, runbooks: Iterable[Runbook]) -> DataFrame:
    """Set the destination to the runbook's own, whatever the row says."""
    own = F.col("destination")
    for r in runbooks:
        own = F.when(F.col("runbook") == r.name, F.lit(r.destination)).otherwise(own)
    return enriched.withColumn("destination", own)
