"""Content routing: ordered predicates over the parsed payload, first match wins."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave import settings as S
from alertweave.functions import payload as P

Predicate = Callable[[Column], Column]

# Fixed values the matchers compare with.
EKS_API_VERSION = "audit.k8s.io/v1"
AWS_SOURCE_SUFFIX = ".amazonaws.com"
GCP_AUDIT_TYPE = "type.googleapis.com/google.cloud.audit.AuditLog"


def match_eks(v: Column) -> Column:
    return P.string_at(v, "$.apiVersion") == EKS_API_VERSION


def match_cloudtrail(v: Column) -> Column:
    return P.string_at(v, "$.eventSource").endswith(AWS_SOURCE_SUFFIX) & P.is_string(P.field(v, "$.eventVersion"))


def match_guardduty(v: Column) -> Column:
    return P.is_string(P.field(v, "$.schemaVersion")) & P.string_at(v, "$.type").contains("/")


def match_gcp_audit(v: Column) -> Column:
    return P.string_at(v, '$.protoPayload["@type"]') == GCP_AUDIT_TYPE


def match_test(flag: str = S.DEFAULTS.test_flag) -> Predicate:
    return lambda v: P.is_true(v, f"$.{flag}")


@dataclass(frozen=True)
class Route:
    name: str
    queue: str
    predicate: Predicate = field(repr=False, compare=False)
    description: str = ""


class RouteCatalog:
    """Routes in registration order. A name may be registered once only."""

    def __init__(self, routes: Iterable[Route] = ()) -> None:
        self._routes: list[Route] = []
        for route in routes:
            self.register(route)

    def register(self, route: Route) -> None:
        if any(known.name == route.name for known in self._routes):
            raise ValueError(f"route {route.name!r} is registered already")
        self._routes.append(route)

    def __iter__(self):
        return iter(self._routes)

    def __len__(self) -> int:
        return len(self._routes)

    def route_of(self, v: Column) -> Column:
        """Name of the first matching route, NULL for none.

        A predicate that is NULL for a row, because something in it could not be read, counts as no match.
        """
        name = None
        for route in self._routes:
            hit = F.coalesce(route.predicate(v), F.lit(False))
            name = F.when(hit, route.name) if name is None else name.when(hit, route.name)
        return F.lit(None).cast("string") if name is None else name

    def queue_of(self, route: Column) -> Column:
        queue = F.lit(None).cast("string")
        for known in self._routes:
            queue = F.when(route == known.name, known.queue).otherwise(queue)
        return queue

    def table(self, spark: SparkSession) -> DataFrame:
        """The catalog as rows: ``position, name, queue, description``."""
        rows = [(i, r.name, r.queue, r.description) for i, r in enumerate(self._routes, 1)]
        return spark.createDataFrame(rows, "position int, name string, queue string, description string")


def default_catalog(settings: S.Settings = S.DEFAULTS) -> RouteCatalog:
    return RouteCatalog(
        [
            Route("cloud.aws.eks", S.QUEUE_EKS, match_eks, "Kubernetes audit log of managed clusters"),
            Route("cloud.aws.cloudtrail", S.QUEUE_CLOUDTRAIL, match_cloudtrail, "AWS API activity and console logins"),
            Route("cloud.aws.guardduty", S.QUEUE_GUARDDUTY, match_guardduty, "AWS threat findings"),
            Route("cloud.gcp.event_audit", S.QUEUE_GCP_AUDIT, match_gcp_audit, "GCP audit log entries"),
            Route("test", S.QUEUE_TEST, match_test(settings.test_flag), "Flagged test events"),
        ]
    )


def route_alerts(alerts: DataFrame, catalog: RouteCatalog | None = None) -> DataFrame:
    """Adds ``payload`` (parsed once, unless it is there), ``route`` and ``queue``, NULL for an unroutable alert."""
    catalog = catalog or default_catalog()
    parsed = alerts if "payload" in alerts.columns else P.compute(alerts, payload=P.parse(F.col("raw_payload")))
    routed = P.compute(parsed, route=catalog.route_of(F.col("payload")))
    return routed.select("*", catalog.queue_of(F.col("route")).alias("queue"))


def matched(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("route").isNotNull())


def unmatched(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("route").isNull())
