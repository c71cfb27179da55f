import json

import pytest
from pyspark.sql import functions as F

from alertweave.functions import arn, identity
from alertweave.functions import payload as P
from alertweave.operators import extract, history

ACC = "123456789012"
IAM, STS = f"arn:aws:iam::{ACC}:", f"arn:aws:sts::{ACC}:"
ISSUER = {"sessionContext": {"sessionIssuer": {"type": "Role", "arn": IAM + "role/MyRole", "userName": "MyRole"}}}
ODD = identity.NOT_TEXT

# userIdentity -> (id, raw id, name, account) or an error text.
AWS = [
    ({"type": "IAMUser", "arn": IAM + "user/alice", "userName": "alice", "accountId": ACC}, (IAM + "user/alice", IAM + "user/alice", "alice", ACC)),
    ({"type": "AssumedRole", "arn": STS + "assumed-role/MyRole/s1", **ISSUER}, (IAM + "role/MyRole", STS + "assumed-role/MyRole/s1", "MyRole", ACC)),
    ({"type": "AssumedRole", "arn": STS + "assumed-role/MyRole/s2"}, (IAM + "role/MyRole", STS + "assumed-role/MyRole/s2", "MyRole", ACC)),
    ({"type": "AssumedRole", **ISSUER}, (IAM + "role/MyRole", IAM + "role/MyRole", "MyRole", ACC)),
    ({"type": "AssumedRole", "arn": "odd", "sessionContext": 3}, ("odd", "odd", None, None)),
    ({"type": "AssumedRole", "sessionContext": {"sessionIssuer": []}}, "AssumedRole missing arn and sessionIssuer.arn"),
    ({"type": "Root", "arn": IAM + "root", "userName": 7}, (IAM + "root", IAM + "root", "root", ACC)),
    ({"type": "AWSService", "invokedBy": "EC2.amazonaws.com"}, ("service:ec2.amazonaws.com", "EC2.amazonaws.com", "EC2.amazonaws.com", None)),
    ({"type": "AWSService", "invokedBy": ""}, "AWSService userIdentity missing invokedBy"),
    ({"type": "AWSService", "invokedBy": 4}, ODD),
    ({"type": "FederatedUser", "arn": STS + "federated-user/a/b"}, (STS + "federated-user/a/b", STS + "federated-user/a/b", "a/b", ACC)),
    ({"type": "AWSAccount", "arn": "arn:aws:iam::", "accountId": ""}, ("arn:aws:iam::", "arn:aws:iam::", "", None)),
    ({"type": "IAMUser", "arn": ""}, "userIdentity type='IAMUser' missing arn"),
    ({"type": "O'Neil", "arn": None}, 'userIdentity type="O\'Neil" missing arn'),
    ({}, "userIdentity type=None missing arn"),
    ({"type": True, "arn": []}, "userIdentity type=True missing arn"),
    ({"type": "IAMUser", "arn": 5}, ODD),
    ({"type": "IAMUser", "arn": IAM + "user/x", "accountId": 5}, ODD),
    ({"type": "IAMUser", "arn": IAM + "user/x", "userName": {"a": 1}}, ODD),
]


def test_aws(spark):
    df = spark.createDataFrame([(i, json.dumps(u)) for i, (u, _) in enumerate(AWS)], "n int, t string")
    rows = identity.add_principal_aws(df.select("n", P.parse(F.col("t")).alias("ui")), "ui").collect()
    for r in rows:
        given, expected = AWS[r["n"]]
        p = r["principal"]
        shown = r["problem"] if p is None else (p["normalized_id"], p["raw_id"], p["display_name"], p["account_or_project"])
        if isinstance(expected, tuple) and given.get("arn") == "arn:aws:iam::":
            # Five parts only: no resource part, hence no name.
            expected = (*expected[:2], None, None) if len(given["arn"].split(":")) < 6 else expected
        assert shown == expected, given
        assert p is None or p["provider"] == "aws"


ARNS = [
    STS + "assumed-role/R/S", STS + "assumed-role/R", STS + "assumed-role/R/S/T", IAM + "role/R", "arn:aws-cn:sts:x:1:assumed-role/R/S",
    "", "a:b", "arn:aws:sts::1:federated-user/x", STS + "assumed-role/R/S:more", IAM + "user/path/alice", IAM + "root", "arn:aws:iam:::x",
]


def collapse(a):
    parts = a.split(":")
    if len(parts) < 6 or parts[2] != "sts" or not parts[5].startswith("assumed-role/"):
        return a
    return f"arn:{parts[1]}:iam::{parts[4]}:role/{parts[5].split('/')[1]}"


def account(a):
    return (a.split(":") + [""] * 5)[4] or None


def name(a):
    parts = a.split(":")
    return None if len(parts) < 6 else parts[5].split("/", 1)[-1]


def test_arn_parts(spark):
    df = spark.createDataFrame([(a,) for a in ARNS], "a string")
    a = F.col("a")
    rows = df.select("a", arn.collapse_session(a), arn.account(a), arn.resource_name(a)).collect()
    assert [tuple(r) for r in rows] == [(x, collapse(x), account(x), name(x)) for x in ARNS]


@pytest.mark.parametrize(
    "auth, expected",
    [
        ({"principalEmail": "Svc@My-Project.iam.gserviceaccount.com"}, ("svc@my-project.iam.gserviceaccount.com", "my-project")),
        ({"principalEmail": "A.User@Example.com"}, ("user:a.user@example.com", None)),
        ({"principalEmail": "x.iam.gserviceaccount.com"}, ("x.iam.gserviceaccount.com", None)),
        ({"principalEmail": "@.iam.gserviceaccount.com"}, ("@.iam.gserviceaccount.com", None)),
        ({"principalEmail": 5}, None),
        ({}, None),
    ],
)
def test_gcp(spark, auth, expected):
    df = spark.createDataFrame([(json.dumps(auth),)], "t string").select(P.parse(F.col("t")).alias("v"))
    r = identity.add_principal_gcp(df, "v").first()
    p = r["principal"]
    assert (p and (p["normalized_id"], p["account_or_project"])) == expected
    assert r["problem"] == (None if expected else "authenticationInfo missing principalEmail")


@pytest.mark.parametrize(
    "event, expected",
    [
        ({"domain_name": "corp", "sam_account_name": "Alice"}, ("CORP\\alice", "corp\\Alice")),
        ({"domain": "Corp", "sam_account": "ALICE"}, ("CORP\\alice", "Corp\\ALICE")),
        ({"domain_name": "", "domain": "d", "sam_account": 12}, ("D\\12", "d\\12")),
        ({"domain": "d", "sam_account": 0}, None),
        ({"domain": "d"}, None),
    ],
)
def test_directory(spark, event, expected):
    df = spark.createDataFrame([(json.dumps(event),)], "t string").select(P.parse(F.col("t")).alias("v"))
    p = identity.add_principal_ad(df, "v").first()["principal"]
    assert (p and (p["normalized_id"], p["raw_id"])) == expected


IDENTITIES = [None, "x", [], {"type": "IAMUser", "arn": IAM + "user/a"}, {"type": "IAMUser"}, {"type": "Root", "arn": IAM + "root"}]


def test_identity_and_history_errors(spark):
    rows = [(str(i), json.dumps({"userIdentity": u})) for i, u in enumerate(IDENTITIES)] + [("6", "{}")]
    df = spark.createDataFrame(rows, "alert_id string, t string").select("alert_id", P.parse(F.col("t")).alias("payload"))
    out = {r["alert_id"]: r for r in history.eligibility(history.identify(df)).collect()}
    for i in ("0", "1", "2", "6"):
        assert tuple(out[i]["identity_error"]) == ("principal_identity", "alert payload missing userIdentity", "PreconditionError")
        assert out[i]["history_error"]["type"] == "PreconditionError"
    assert out["3"]["eligible"] and out["3"]["identity_error"] is None and out["3"]["history_error"] is None
    assert out["4"]["identity_error"]["type"] == "ValueError"
    assert out["5"]["history_error"]["error"] == "skipped: unsupported provider=aws"


def fields(spark, payload, reader):
    df = spark.createDataFrame([(json.dumps(payload),)], "t string").select(P.parse(F.col("t")).alias("v"))
    return json.loads(df.select(extract.as_json(reader(F.col("v")))).first()[0])


@pytest.mark.parametrize(
    "payload, expected",
    [
        ({}, {"user": "unknown", "user_type": "unknown"}),
        ({"userIdentity": None, "eventName": "E"}, {"event_name": "E"}),
        ({"userIdentity": "x"}, {}),
        ({"userIdentity": {"userName": "", "arn": "a", "type": "T"}}, {"user": "a", "user_type": "T"}),
        ({"userIdentity": {"arn": None, "type": None}}, {"user": None, "user_type": None}),
        ({"userIdentity": {"userName": 7}, "awsRegion": None, "sourceIPAddress": 5, "eventSource": "s"},
         {"user": 7, "user_type": "unknown", "source_ip": 5, "event_source": "s"}),
    ],
)
def test_cloudtrail_fields(spark, payload, expected):
    assert fields(spark, payload, extract.cloudtrail_fields) == expected


@pytest.mark.parametrize(
    "payload, expected",
    [
        ({"resource": {"labels": {"project_id": "p"}}, "protoPayload": {"methodName": "m", "serviceName": None,
          "authenticationInfo": {"principalEmail": "e"}}}, {"project_id": "p", "method_name": "m", "principal_email": "e"}),
        ({"resource": "none", "protoPayload": []}, {}),
    ],
)
def test_gcp_fields(spark, payload, expected):
    assert fields(spark, payload, extract.gcp_fields) == expected
