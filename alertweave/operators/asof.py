"""Newest facts at or before a moment: the join behind history and resource look-ups.

A plain interval join pairs every probe with every fact of the same key before it cuts the list down,
which is quadratic for a key that owns much of the data. Here facts get a running number per key, a probe
learns the number of the last fact it may see, and the two meet on ``(key, number)``:

* facts of one instant are first cut to the newest ``n``, in map-side partials, since no probe needs more;
* the running number comes from ranges of ``(key, time)`` and not from windows over a key (see ``numbering``), so neither a key
  nor a minute of a key is ever in one task as a whole;
* a probe is expanded to exactly the numbers it returns, so the join never builds a pair it throws away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertweave.operators.numbering import positions

_LOWER, _FACT, _UPPER = 0, 1, 2


def newest_before(
    probes: DataFrame,
    facts: DataFrame,
    n: int | None,
    lookback_micros: int | None = None,
) -> DataFrame:
    """The newest ``n`` facts per probe (all where it is None), not after it and not older than the look-back, both ends included.

    ``probes`` has ``key, at`` and ``facts`` has ``key, at, fact_id`` (``at`` in microseconds). The result is
    ``key, at, fact_id, fact_at, place``, place 1 being the newest; among facts of one instant the highest id
    comes first. Probes without a fact have no row.
    """
    if n is not None and n <= 0:
        raise ValueError("n must be positive")
    if lookback_micros is not None and lookback_micros < 0:
        raise ValueError("the look-back must not be negative")

    kept = facts.select("key", "at", "fact_id").filter(F.col("key").isNotNull() & F.col("at").isNotNull())
    if n is not None:
        instant = Window.partitionBy("key", "at").orderBy(F.col("fact_id").desc())
        kept = kept.withColumn("_rn", F.row_number().over(instant)).filter(F.col("_rn") <= n).drop("_rn")
    moments = probes.select("key", "at").filter(F.col("key").isNotNull() & F.col("at").isNotNull()).distinct()

    nothing = F.lit(None)
    points = kept.select(
        "key", "at", F.lit(_FACT).alias("role"), "fact_id", F.lit(None).cast("bigint").alias("probe_at")
    )
    no_fact = nothing.cast(kept.schema["fact_id"].dataType).alias("fact_id")
    bounds = [(_UPPER, F.lit(0))]
    if lookback_micros is not None:
        bounds.append((_LOWER, F.lit(lookback_micros)))
    edges = F.array(*[F.struct(F.lit(role).alias("role"), shift.cast("bigint").alias("shift")) for role, shift in bounds])
    probe_points = moments.select("key", "at", F.explode(edges).alias("edge")).select(
        "key",
        (F.col("at") - F.col("edge.shift")).alias("at"),
        F.col("edge.role").alias("role"),
        no_fact,
        F.col("at").alias("probe_at"),
    )
    points = points.unionByName(probe_points).withColumn("weight", (F.col("role") == _FACT).cast("bigint"))
    placed = positions(points, ["key"], ["at", "role", "fact_id"], ("weight",)).drop("position")
    placed = placed.withColumnRenamed("running_weight", "position")

    numbered = placed.filter(F.col("role") == _FACT).select(
        "key", F.col("position").alias("number"), "fact_id", F.col("at").alias("fact_at")
    )
    ranges = (
        placed.filter(F.col("role") != _FACT)
        .groupBy("key", "probe_at")
        .agg(
            F.max(F.when(F.col("role") == _UPPER, F.col("position"))).alias("last"),
            F.coalesce(F.max(F.when(F.col("role") == _LOWER, F.col("position"))), F.lit(0)).alias("skipped"),
        )
        .select(
            "key",
            F.col("probe_at").alias("at"),
            "last",
            (F.col("skipped") if n is None else F.greatest(F.col("skipped"), F.col("last") - n)).alias("after"),
        )
        .filter(F.col("last") > F.col("after"))
    )
    wanted = ranges.select(
        "key", "at", "last", F.explode(F.sequence(F.col("after") + 1, F.col("last"))).alias("number")
    )
    return wanted.join(numbered, ["key", "number"]).select(
        "key", "at", "fact_id", "fact_at", (F.col("last") - F.col("number") + 1).alias("place")
    )
