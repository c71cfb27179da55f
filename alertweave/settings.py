"""Values a deployment may change, with neutral defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Queue names of the alert flow.
QUEUE_ALERTS = "alerts"
QUEUE_CLOUDTRAIL = "runbook.cloudtrail"
QUEUE_GUARDDUTY = "runbook.guardduty"
QUEUE_EKS = "runbook.eks"
QUEUE_GCP_AUDIT = "runbook.gcp.event_audit"
QUEUE_TEST = "runbook.test"
QUEUE_ENRICHED = "enriched"
QUEUE_DLQ = "alerts.dlq"
QUEUE_METRICS = "alerts.metrics"

ALL_QUEUES = (
    QUEUE_ALERTS,
    QUEUE_CLOUDTRAIL,
    QUEUE_GUARDDUTY,
    QUEUE_EKS,
    QUEUE_GCP_AUDIT,
    QUEUE_TEST,
    QUEUE_ENRICHED,
    QUEUE_DLQ,
    QUEUE_METRICS,
)


@dataclass(frozen=True)
class Settings:
    """Names stamped on outgoing events and limits of the enrichment steps."""

    test_flag: str = "_pipeline_test"
    host: str = "alert-pipeline"
    index: str = "main"
    enriched_sourcetype: str = "alerts:enriched_alert"
    dlq_sourcetype: str = "alerts:dlq_alert"
    delivery_batch_size: int = 50
    delivery_attempts: int = 3
    lookback_minutes: int = 60
    history_max_results: int = 50
    cache_ttl_seconds: int = 900
    cache_stats_every: int = 50
    backfill_minutes: int = 5

    def __post_init__(self) -> None:
        for name in (
            "delivery_batch_size",
            "delivery_attempts",
            "lookback_minutes",
            "history_max_results",
            "cache_ttl_seconds",
        ):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")


DEFAULTS = Settings()
