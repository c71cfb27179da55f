"""Kind-exact reading of JSON payloads held as VARIANT.

A cast from VARIANT turns ``42`` into ``'42'`` and ``"true"`` into ``true``. Matchers and identity rules
must tell them apart, so every reader here tests the kind of the value first. Three states differ:
key absent (SQL NULL), JSON null (kind VOID) and a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once per row, whatever is built on them later.

    A plain projection is merged into the filters and projections above it, and a parsed payload that is
    read in twenty places would then be parsed twenty times. A generator is not merged. It stays inside
    whole-stage code, and filters on the other columns still reach the scan.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def parse(text: Column) -> Column:
    """JSON text -> VARIANT; NULL when the text is not JSON."""
    return F.try_parse_json(text)


def field(v: Column, path: str) -> Column:
    """Value at ``path`` as VARIANT; NULL when the key is absent."""
    return F.try_variant_get(v, path, "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_string(value: Column) -> Column:
    return _holds(kind(value) == "STRING")


def is_boolean(value: Column) -> Column:
    return _holds(kind(value) == "BOOLEAN")


def is_object(value: Column) -> Column:
    """Only an object reads as a struct. Unlike ``kind`` this does not walk through all of the value."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def is_array(value: Column) -> Column:
    return _holds(kind(value).startswith("ARRAY"))


def is_null(value: Column) -> Column:
    """JSON null, as opposed to an absent key."""
    return _holds(kind(value) == "VOID")


def has_key(v: Column, path: str) -> Column:
    """True for a present key, also when its value is JSON null."""
    return field(v, path).isNotNull()


def has_value(v: Column, path: str) -> Column:
    """True for a present key whose value is not JSON null."""
    value = field(v, path)
    return _holds(kind(value) != "VOID")


def is_true(v: Column, path: str) -> Column:
    return is_boolean(field(v, path)) & _holds(F.try_variant_get(v, path, "boolean"))


def is_false(v: Column, path: str) -> Column:
    return is_boolean(field(v, path)) & _holds(~F.try_variant_get(v, path, "boolean"))


def string_at(v: Column, path: str) -> Column:
    """The text at ``path`` when it is a JSON string, else NULL."""
    return F.when(is_string(field(v, path)), F.try_variant_get(v, path, "string"))


def filled_string(v: Column, path: str) -> Column:
    """As ``string_at``, with the empty string read as NULL."""
    return F.nullif(string_at(v, path), F.lit(""))


# JSON forms that count as false in an "a or b" chain, besides numeric zero.
FALSY_JSON = ["null", "false", '""', "[]", "{}"]


def truthy(v: Column, path: str) -> Column:
    """False for an absent key, null, false, zero and empty text, array or object."""
    value = field(v, path)
    number_is_zero = _holds(F.try_variant_get(v, path, "double") == 0) & kind(value).rlike(
        "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
    )
    return _holds(~F.to_json(value).isin(FALSY_JSON) & ~number_is_zero)


def truthy_not_string(v: Column, path: str) -> Column:
    """A value an identity field cannot take: present, truthy and not text."""
    return truthy(v, path) & ~is_string(field(v, path))


def value_or_absent(v: Column, path: str) -> Column:
    """The value as VARIANT, with JSON null read as an absent key."""
    return F.when(has_value(v, path), field(v, path))


def json_constant(text: str) -> Column:
    return F.parse_json(F.lit(text))


def as_text(v: Column, path: str) -> Column:
    """Text form of a scalar: strings as they are, booleans and null as Python writes them."""
    value = field(v, path)
    return (
        F.when(is_string(value), F.try_variant_get(v, path, "string"))
        .when(is_true(v, path), F.lit("True"))
        .when(is_false(v, path), F.lit("False"))
        .when(value.isNull() | is_null(value), F.lit("None"))
        .otherwise(F.to_json(value))
    )


def quoted(text: Column) -> Column:
    """A string written as a Python literal: single quotes unless only single quotes occur inside."""
    escaped = text
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    only_single = text.contains("'") & ~text.contains('"')
    return F.when(only_single, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def quoted_or_plain(v: Column, path: str) -> Column:
    """``as_text`` with strings quoted."""
    return F.when(is_string(field(v, path)), quoted(as_text(v, path))).otherwise(as_text(v, path))


def render(struct: Column) -> Column:
    """Struct -> JSON text with an entry for every field, null included."""
    return F.to_json(struct, {"ignoreNullFields": "false"})


def render_present(struct: Column) -> Column:
    """Struct -> JSON text without the fields that are SQL NULL."""
    return F.to_json(struct, {"ignoreNullFields": "true"})


def iso_utc(ts: Column) -> Column:
    """ISO 8601 in UTC, with microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    fine = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.unix_micros(ts) % 1000000 == 0, whole).otherwise(fine)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 with all six places, as a decimal: a double would be written with an exponent."""
    return (F.unix_micros(ts).cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(20,6)")
