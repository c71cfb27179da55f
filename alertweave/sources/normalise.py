"""Transport messages -> alerts, for batch and streaming frames alike.

Every normaliser keeps one output row per message. A message that cannot become an alert carries a
``reject_reason``; ``alerts`` and ``rejects`` split the frame, so the input is scanned once and nothing
is lost without a row saying why. None of these steps shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.functions import payload as P

ALERT_COLUMNS = ["alert_id", "source", "received_at", "raw_payload", "metadata"]

# ``payload`` is the parsed payload, for plans that go on reading it; it is not stored.
NORMALISED_COLUMNS = [*ALERT_COLUMNS, "reject_reason", "reject_detail", "raw", "payload"]

# Why a message did not become an alert.
REJECT_REASONS = [
    "null_value",
    "bad_utf8",
    "bad_json",
    "not_object",
    "missing_payload",
    "bad_metadata",
    "bad_source",
    "alert_invalid",
]


def identity(source: str, position: list[Column], content: Column) -> Column:
    """Alert id in UUID form, the same for every replay of the same message.

    It is derived from where the message stood in its transport, or from its content where any part of that position
    is missing: a position with a gap is shared by messages that differ.
    """
    # A bar within a part is escaped, so that no two positions read the same.
    parts = [F.regexp_replace(part, r"([\\|])", r"\\$1") for part in position]
    by_position = F.concat_ws("|", F.lit(source), *parts)
    by_content = F.concat_ws("|", F.lit(source), content)
    known = F.lit(bool(position))
    for part in position:
        known = known & part.isNotNull()
    digest = F.md5(F.when(known, by_position).otherwise(by_content))
    parts = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def _utf8(data: Column) -> Column:
    """Bytes -> text; NULL when they are not UTF-8."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))


def _arrival(received_at: Column | None) -> Column:
    return F.current_timestamp() if received_at is None else received_at.cast("timestamp")


def _object_reason(parsed: Column) -> Column:
    return F.when(parsed.isNull(), F.lit("bad_json")).when(~P.is_object(parsed), F.lit("not_object"))


def _finish(
    read: DataFrame, alert_id: Column, source: Column, text: Column, metadata: Column, reason: Column, raw: Column,
    payload: Column, detail: Column | None = None,
) -> DataFrame:
    """The normalised columns; a rejected row has no id and no payload but keeps its raw text."""
    told = P.compute(read, reject_reason=reason, reject_detail=F.lit("") if detail is None else detail)
    ok = F.col("reject_reason").isNull()
    return told.select(
        F.when(ok, alert_id).alias("alert_id"),
        source.alias("source"),
        "received_at",
        F.when(ok, text).alias("raw_payload"),
        metadata.alias("metadata"),
        "reject_reason",
        "reject_detail",
        F.when(~ok, raw).alias("raw"),
        payload.alias("payload"),
    )


def kafka(df: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Rows of Spark's Kafka source: ``key, value, topic, partition, offset``."""
    read = df.select("*", F.when(F.length("key") > 0, F.col("key")).alias("_key"), _arrival(received_at).alias("received_at"))
    read = P.compute(read, _text=_utf8(F.col("value")), _key_text=_utf8(F.col("_key")))
    read = P.compute(read, _v=P.parse(F.col("_text")))
    bad_key = F.col("_key").isNotNull() & F.col("_key_text").isNull()
    position = [F.col(c).cast("string") for c in ("topic", "partition", "offset")]
    return _finish(
        read,
        identity("kafka", position, F.col("_text")),
        F.lit("kafka"),
        F.col("_text"),
        P.render(F.struct("topic", "partition", "offset", F.col("_key_text").alias("key"))),
        F.when(F.col("value").isNull(), F.lit("null_value"))
        .when(F.col("_text").isNull() | bad_key, F.lit("bad_utf8"))
        .otherwise(_object_reason(F.col("_v"))),
        F.hex("value"),
        F.col("_v"),
        F.when(F.col("_text").isNotNull() & bad_key, F.lit("key")).otherwise(F.lit("")),
    )


def sqs(df: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Rows ``MessageId, ReceiptHandle, Body``, unwrapping notification envelopes."""
    read = df.select(
        "*", F.coalesce(F.col("Body"), F.lit("{}")).alias("_body"), _arrival(received_at).alias("received_at")
    )
    read = P.compute(read, _b=P.parse(F.col("_body")))
    b = F.col("_b")
    wrapped = F.coalesce(P.string_at(b, "$.Type") == "Notification", F.lit(False)) & P.has_key(b, "$.Message")
    read = P.compute(read, _wrapped=wrapped)
    read = P.compute(read, _inner=F.when(F.col("_wrapped"), P.string_at(b, "$.Message")))
    read = P.compute(read, _i=P.parse(F.col("_inner")))
    inner_ok = F.col("_i").isNotNull()
    as_message = P.render(F.struct(P.field(b, "$.Message").alias("message")))
    text = F.when(~F.col("_wrapped"), F.col("_body")).when(inner_ok, F.col("_inner")).otherwise(as_message)
    payload = F.when(~F.col("_wrapped"), b).when(inner_ok, F.col("_i")).otherwise(P.parse(as_message))
    return _finish(
        read,
        identity("sqs", [F.col("MessageId")], F.col("_body")),
        F.lit("sqs"),
        text,
        P.render(
            F.struct(
                F.col("MessageId").alias("message_id"),
                F.col("ReceiptHandle").alias("receipt_handle"),
                P.field(b, "$.TopicArn").alias("topic_arn"),
                P.field(b, "$.Subject").alias("subject"),
            )
        ),
        F.when(b.isNull(), F.lit("bad_json"))
        .when(~P.is_object(b), F.lit("not_object"))
        .when(F.col("_wrapped") & inner_ok & ~P.is_object(F.col("_i")), F.lit("not_object")),
        F.col("_body"),
        payload,
    )


def pubsub(df: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Rows ``data, message_id, publish_time, attributes, subscription``; plain text becomes ``{"data": text}``."""
    read = df.select("*", _arrival(received_at).alias("received_at"))
    read = P.compute(read, _text=F.when(F.col("data").isNull(), F.lit("")).otherwise(_utf8(F.col("data"))))
    read = P.compute(read, _v=P.parse(F.col("_text")))
    v = F.col("_v")
    wrapped = P.render(F.struct(F.col("_text").alias("data")))
    return _finish(
        read,
        identity("pubsub", [F.col("subscription"), F.col("message_id")], F.col("_text")),
        F.lit("pubsub"),
        F.when(v.isNull(), wrapped).otherwise(F.col("_text")),
        P.render(
            F.struct(
                "message_id",
                P.iso_utc(F.col("publish_time")).alias("publish_time"),
                F.coalesce(F.col("attributes"), F.expr("cast(map() as map<string,string>)")).alias("attributes"),
                "subscription",
            )
        ),
        F.when(F.col("_text").isNull(), F.lit("bad_utf8")).when(v.isNotNull() & ~P.is_object(v), F.lit("not_object")),
        F.hex("data"),
        F.when(v.isNull(), P.parse(wrapped)).otherwise(v),
    )


def splunk(df: DataFrame, search: str, received_at: Column | None = None) -> DataFrame:
    """Result rows of a notable-event search, one JSON text per row in column ``row``."""
    read = P.compute(df.select("*", _arrival(received_at).alias("received_at")), _v=P.parse(F.col("row")))
    v = F.col("_v")
    return _finish(
        read,
        identity("splunk_es", [], F.col("row")),
        F.lit("splunk_es"),
        F.col("row"),
        P.render(
            F.struct(
                F.lit(search).alias("search"),
                P.field(v, "$._time").alias("event_time"),
                P.field(v, "$.host").alias("host"),
                P.field(v, "$.sourcetype").alias("sourcetype"),
            )
        ),
        F.when(F.col("row").isNull(), F.lit("null_value")).otherwise(_object_reason(v)),
        F.col("row"),
        v,
    )


def universal(df: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Posted bodies ``body, remote_addr`` and, where the landing writes one, ``request_id``."""
    request = F.col("request_id").cast("string") if "request_id" in df.columns else F.lit(None).cast("string")
    read = df.select("*", request.alias("_request"), _arrival(received_at).alias("received_at"))
    read = P.compute(
        read,
        _v=P.parse(F.col("body")),
        _body=F.from_json("body", "raw_payload string, metadata map<string,variant>"),
    )
    v = F.col("_v")
    read = P.compute(
        read,
        _payload=P.field(v, "$.raw_payload"),
        _metadata=P.field(v, "$.metadata"),
        _source=P.field(v, "$.source"),
    )
    none_given = F.col("_metadata").isNull()
    given = F.when(none_given, F.expr("cast(map() as map<string,variant>)")).otherwise(
        F.map_filter(F.col("_body.metadata"), lambda k, _: k != "remote_addr")
    )
    address = F.create_map(
        F.lit("remote_addr"), F.coalesce(F.col("remote_addr").cast("variant"), P.json_constant("null"))
    )
    return _finish(
        read,
        identity("universal", [F.col("_request")], F.col("body")),
        F.coalesce(P.string_at(F.col("_source"), "$"), F.lit("universal")),
        F.col("_body.raw_payload"),
        F.to_json(F.map_concat(given, address)),
        F.when(F.col("body").isNull(), F.lit("null_value"))
        .when(v.isNull(), F.lit("bad_json"))
        .when(~P.is_object(v), F.lit("not_object"))
        .when(~P.is_object(F.col("_payload")), F.lit("missing_payload"))
        .when(~none_given & ~P.is_object(F.col("_metadata")), F.lit("bad_metadata"))
        .when(F.col("_source").isNotNull() & ~P.is_string(F.col("_source")), F.lit("bad_source")),
        F.col("body"),
        F.col("_payload"),
    )


def alerts(normalised: DataFrame, with_payload: bool = False) -> DataFrame:
    """The accepted messages; ``with_payload`` keeps the parsed payload for the next step of the same plan."""
    columns = [*ALERT_COLUMNS, "payload"] if with_payload else ALERT_COLUMNS
    return normalised.filter(F.col("reject_reason").isNull()).select(*columns)


def rejects(normalised: DataFrame) -> DataFrame:
    return normalised.filter(F.col("reject_reason").isNotNull()).select(
        "source",
        F.col("reject_reason").alias("reason"),
        F.col("reject_detail").alias("detail"),
        "raw",
        "metadata",
        F.col("received_at").alias("rejected_at"),
    )


def all_sources(*normalised: DataFrame) -> DataFrame:
    """The sources side by side, duplicates kept."""
    first, *rest = normalised
    for other in rest:
        first = first.unionByName(other)
    return first


class SourceCatalog:
    """Normalisers by the name of their source. A normaliser makes the normalised form of the frame that its source lands."""

    def __init__(self, sources: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
        self._sources = dict(sources or {})

    def register(self, name: str, normaliser: Callable[[DataFrame], DataFrame]) -> None:
        if name in self._sources:
            raise ValueError(f"a source named {name!r} is registered already")
        self._sources[name] = normaliser

    @property
    def names(self) -> list[str]:
        return list(self._sources)

    def normalise(self, landed: dict[str, DataFrame]) -> DataFrame:
        """The messages of all given sources in their normalised form, side by side; batch and streaming frames alike."""
        unknown = set(landed) - set(self._sources)
        if unknown or not landed:
            raise ValueError(f"no normaliser for {sorted(unknown)}" if unknown else "no source is given")
        made = []
        for name, frame in landed.items():
            rows = self._sources[name](frame)
            missing = set(NORMALISED_COLUMNS) - set(rows.columns)
            if missing:
                raise ValueError(f"the normaliser of {name!r} leaves out {sorted(missing)}")
            made.append(rows.select(*NORMALISED_COLUMNS))
        return all_sources(*made)


def default_sources() -> SourceCatalog:
    """The sources of this module by their names; Splunk frames need their search, so callers register that themselves."""
    return SourceCatalog({"kafka": kafka, "sqs": sqs, "pubsub": pubsub, "universal": universal})
