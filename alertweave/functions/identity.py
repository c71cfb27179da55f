"""One canonical actor identity per alert, whatever the provider.

Each step adds ``principal`` and ``problem`` to a frame: exactly one of the two is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.functions import arn as names
from alertweave.functions import payload as P

PRINCIPAL_TYPE = (
    "struct<provider:string,normalized_id:string,raw_id:string,display_name:string,account_or_project:string>"
)
ERROR_TYPE = "struct<enricher:string,error:string,type:string>"

# Fixed value: host suffix of service-account addresses.
SERVICE_ACCOUNT_SUFFIX = ".iam.gserviceaccount.com"

NOT_TEXT = "identity field is not a string"


def _principal(provider: str, nid: Column, raw: Column, display: Column, scope: Column) -> Column:
    return F.struct(
        F.lit(provider).alias("provider"),
        nid.alias("normalized_id"),
        raw.alias("raw_id"),
        display.alias("display_name"),
        scope.cast("string").alias("account_or_project"),
    ).cast(PRINCIPAL_TYPE)


def _settle(df: DataFrame, keep: list[str], problem: Column, principal: Column) -> DataFrame:
    """``principal`` and ``problem``: exactly one of the two is set."""
    settled = P.compute(df, problem=problem)
    return settled.select(*keep, F.when(F.col("problem").isNull(), principal).alias("principal"), "problem")


_AWS_LEAVES = "struct<type:variant,arn:variant,accountId:variant,userName:variant,invokedBy:variant,sessionContext:variant>"


def add_principal_aws(df: DataFrame, ui: str) -> DataFrame:
    """Identity from the ``userIdentity`` object of a cloud audit event, held in column ``ui``."""
    read = P.compute(df, _leaf=F.try_variant_get(F.col(ui), "$", _AWS_LEAVES))
    issuer = "$.sessionIssuer"
    leaves = {
        "type": F.col("_leaf.type"),
        "arn": F.col("_leaf.arn"),
        "account": F.col("_leaf.accountId"),
        "user": F.col("_leaf.userName"),
        "invoker": F.col("_leaf.invokedBy"),
        "issuer": P.field(F.col("_leaf.sessionContext"), f"{issuer}.arn"),
        "issuer_name": P.field(F.col("_leaf.sessionContext"), f"{issuer}.userName"),
    }
    read = P.compute(read, **{f"_{n}": v for n, v in leaves.items()})
    texts = {f"{n}_text": P.filled_string(F.col(f"_{n}"), "$") for n in leaves}
    odd = {f"{n}_odd": P.truthy_not_string(F.col(f"_{n}"), "$") for n in leaves}
    shown = F.when(F.col("_type").isNull(), F.lit("None")).otherwise(P.quoted_or_plain(F.col("_type"), "$"))
    read = P.compute(read, _f=F.struct(*[c.alias(n) for n, c in {**texts, **odd}.items()], shown.alias("type_shown")))

    def f(name: str) -> Column:
        return F.col(f"_f.{name}")

    def is_a(kind: str) -> Column:
        return F.coalesce(f("type_text") == kind, F.lit(False))

    read = P.compute(
        read,
        _service=is_a("AWSService"),
        _role=is_a("AssumedRole"),
        _root=is_a("Root"),
        _role_id=F.coalesce(f("issuer_text"), names.collapse_session(f("arn_text"))),
    )
    service, role, root, role_id = (F.col(c) for c in ("_service", "_role", "_root", "_role_id"))
    arn = f("arn_text")
    problem = (
        F.when(service & f("invoker_odd"), F.lit(NOT_TEXT))
        .when(service & f("invoker_text").isNull(), F.lit("AWSService userIdentity missing invokedBy"))
        .when(service, F.lit(None).cast("string"))
        .when(f("arn_odd"), F.lit(NOT_TEXT))
        .when(
            role & f("issuer_text").isNull() & ~f("issuer_odd") & arn.isNull(),
            F.lit("AssumedRole missing arn and sessionIssuer.arn"),
        )
        .when(role & (f("issuer_odd") | f("issuer_name_odd") | f("account_odd")), F.lit(NOT_TEXT))
        .when(role, F.lit(None).cast("string"))
        .when(arn.isNull(), F.concat(F.lit("userIdentity type="), f("type_shown"), F.lit(" missing arn")))
        .when(f("account_odd") | (~root & f("user_odd")), F.lit(NOT_TEXT))
    )
    nid = F.when(service, F.concat(F.lit("service:"), F.lower(f("invoker_text")))).when(role, role_id).otherwise(arn)
    raw = F.when(service, f("invoker_text")).when(role, F.coalesce(arn, role_id)).otherwise(arn)
    named = F.coalesce(F.when(role, f("issuer_name_text")).otherwise(f("user_text")), names.resource_name(F.col("_name")))
    read = P.compute(read, _name=F.when(role, role_id).otherwise(arn))
    display = F.when(service, f("invoker_text")).when(root, F.lit("root")).otherwise(named)
    scope = F.when(~service, F.coalesce(f("account_text"), names.account(F.col("_name"))))
    return _settle(read, df.columns, problem, _principal("aws", nid, raw, display, scope))


def add_principal_gcp(df: DataFrame, auth: str) -> DataFrame:
    """Identity from an ``authenticationInfo`` object: bare address for services, ``user:`` for people."""
    read = P.compute(df, _email=P.filled_string(F.col(auth), "$.principalEmail"))
    email, lowered = F.col("_email"), F.lower("_email")
    is_service = lowered.endswith(SERVICE_ACCOUNT_SUFFIX)
    host = F.when(lowered.contains("@"), F.substring_index(lowered, "@", -1))
    project = F.nullif(
        F.substring(host, F.lit(1), F.length(host) - F.lit(len(SERVICE_ACCOUNT_SUFFIX))), F.lit("")
    )
    problem = F.when(email.isNull(), F.lit("authenticationInfo missing principalEmail"))
    nid = F.when(is_service, lowered).otherwise(F.concat(F.lit("user:"), lowered))
    return _settle(read, df.columns, problem, _principal("gcp", nid, email, email, F.when(is_service, project)))


def add_principal_ad(df: DataFrame, event: str) -> DataFrame:
    """Identity from a directory event: ``DOMAIN\\account``, long or short field names."""
    v = F.col(event)

    def first_truthy(*paths: str) -> Column:
        return F.coalesce(*[F.when(P.truthy(v, p), P.as_text(v, p)) for p in paths])

    read = P.compute(
        df,
        _domain=first_truthy("$.domain_name", "$.domain"),
        _sam=first_truthy("$.sam_account_name", "$.sam_account"),
    )
    domain, sam = F.col("_domain"), F.col("_sam")
    problem = F.when(domain.isNull() | sam.isNull(), F.lit("AD event missing domain and sam_account fields"))
    nid = F.concat(F.upper(domain), F.lit("\\"), F.lower(sam))
    raw = F.concat(domain, F.lit("\\"), sam)
    return _settle(read, df.columns, problem, _principal("ad", nid, raw, sam, F.upper(domain)))


def principal_key(principal: Column) -> Column:
    """``provider::id``; NULL without a principal."""
    return F.concat(principal["provider"], F.lit("::"), principal["normalized_id"])


def lookup_username(principal: Column) -> Column:
    """The name the audit log knows the actor by."""
    nid = principal["normalized_id"]
    return F.coalesce(F.nullif(principal["display_name"], F.lit("")), F.substring_index(nid, "/", -1))


def history_supported(principal: Column) -> Column:
    """Users and roles have a history; services, account roots and federated users have none."""
    nid = principal["normalized_id"]
    return ~(nid.startswith("service:") | nid.endswith(":root") | nid.contains(":federated-user/"))
