"""Parts of cloud resource names, ``arn:partition:service:region:account:resource``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(arn: Column, position: int) -> Column:
    return F.try_element_at(F.split(arn, ":"), F.lit(position))


def collapse_session(arn: Column) -> Column:
    """A session of an assumed role -> the role itself; any other name is unchanged."""
    pattern = r"^[^:]*:([^:]*):sts:[^:]*:([^:]*):assumed-role/([^/:]*)(?:[/:][\s\S]*)?$"
    role = F.concat(
        F.lit("arn:"),
        F.regexp_extract(arn, pattern, 1),
        F.lit(":iam::"),
        F.regexp_extract(arn, pattern, 2),
        F.lit(":role/"),
        F.regexp_extract(arn, pattern, 3),
    )
    return F.when(arn.rlike(pattern), role).otherwise(arn)


def account(arn: Column) -> Column:
    """Account part, NULL when missing or empty."""
    return F.nullif(_part(arn, 5), F.lit(""))


def resource_name(arn: Column) -> Column:
    """What follows the first slash of the resource part, or the whole part when it has none."""
    resource = _part(arn, 6)
    after_slash = F.regexp_extract(resource, r"^[^/]*/([\s\S]*)$", 1)
    return F.when(resource.contains("/"), after_slash).otherwise(resource)
