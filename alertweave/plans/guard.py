"""Python functions of one row whose failures become values: the row goes on, and so does every other."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from alertweave.functions import identity as I

# The batch functions below travel to the executors with their helpers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _batches(function: Callable[..., dict | None], fields: list[str], loads: list[bool], kind: StructType):
    def run(*columns):
        import pyarrow as pa

        out = []
        for row in zip(*(c.to_pylist() for c in columns)):
            entry = {"value": None, "error": None, "type": None, "failure": None}
            try:
                made = function(*(json.loads(v) if load and v is not None else v for v, load in zip(row, loads)))
                entry["value"] = None if made is None else {f: made.get(f) for f in fields}
            except Exception as problem:  # whatever a user's function raises is that row's error
                name = type(problem).__name__
                entry |= {"error": str(problem), "type": name, "failure": f"{name}: {problem}"}
            out.append(entry)
        return pa.array(out, to_arrow_type(kind))

    return run


@dataclass(frozen=True)
class RowFunction:
    """``function`` of the values of one row, returning the fields of ``returns`` as a dictionary.

    Called with columns it gives ``value``, and ``error, type, failure`` where the function raised: the message, the name of
    the exception, and both as one text.
    """

    function: Callable[..., dict | None] = field(repr=False)
    returns: str

    def __call__(self, *columns: Column, loads: list[bool] | None = None) -> Column:
        """``loads`` tells which arguments are JSON text to be read first; all, if it is left out."""
        made = StructType.fromDDL(self.returns)
        kind = StructType().add("value", made).add("error", "string").add("type", "string").add("failure", "string")
        return F.arrow_udf(_batches(self.function, made.names, loads or [True] * len(columns), kind), kind)(*columns)

    def of(self, df: DataFrame, names: tuple[str, ...]) -> Column:
        """The call with columns of ``df``; nested values reach the function as Python lists and dictionaries."""
        nested = [df.schema[n].dataType.typeName() in ("variant", "struct", "array", "map") for n in names]
        return self(*[F.to_json(n) if deep else F.col(n) for n, deep in zip(names, nested)], loads=nested)


def error_record(name: str, made: Column) -> Column:
    """The error of an enricher, NULL where its function returned."""
    record = F.struct(F.lit(name).alias("enricher"), made["error"].alias("error"), made["type"].alias("type"))
    return F.when(made["type"].isNotNull(), record.cast(I.ERROR_TYPE))
