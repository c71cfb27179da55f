"""Fields a runbook reads straight from the payload. Values keep their JSON kind (VARIANT)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertweave.functions import payload as P


def cloudtrail_fields(v: Column) -> Column:
    """``user, user_type`` unless ``userIdentity`` is something other than an object, and four plain fields."""
    unknown = P.json_constant('"unknown"')
    identity = P.field(v, "$.userIdentity")
    readable = identity.isNull() | P.is_object(identity)
    user = (
        F.when(P.truthy(v, "$.userIdentity.userName"), P.field(v, "$.userIdentity.userName"))
        .when(P.has_key(v, "$.userIdentity.arn"), P.field(v, "$.userIdentity.arn"))
        .otherwise(unknown)
    )
    return F.struct(
        F.when(readable, user).alias("user"),
        F.when(readable, F.coalesce(P.field(v, "$.userIdentity.type"), unknown)).alias("user_type"),
        P.value_or_absent(v, "$.eventName").alias("event_name"),
        P.value_or_absent(v, "$.eventSource").alias("event_source"),
        P.value_or_absent(v, "$.awsRegion").alias("aws_region"),
        P.value_or_absent(v, "$.sourceIPAddress").alias("source_ip"),
    )


def gcp_fields(v: Column) -> Column:
    return F.struct(
        P.value_or_absent(v, "$.resource.labels.project_id").alias("project_id"),
        P.value_or_absent(v, "$.protoPayload.methodName").alias("method_name"),
        P.value_or_absent(v, "$.protoPayload.serviceName").alias("service_name"),
        P.value_or_absent(v, "$.protoPayload.authenticationInfo.principalEmail").alias("principal_email"),
    )


def as_json(fields: Column) -> Column:
    """Extracted fields -> JSON text; a field that is absent has no key."""
    return P.render_present(fields)
