"""Exact running positions and sums within groups of any size.

A window over a group puts the whole group into one task. Here the rows are dealt by ranges of ``(group, order)``, so that a large group
lies in many partitions, each after the one before. A partition counts its own rows in one pass; the totals of a group's partitions,
one small row each, give every partition what came before it.

The ranges are drawn from a sample and differ from run to run, the positions do not. The counted rows are written once to the
shared folder, so that the totals and the rows that they are added to are of one deal.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertweave.session import materialise

# The Arrow function below travels to the executors with its helpers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _counted(group: list[str], sums: list[str]):
    """Adds the running count and sums of each run of rows of one group; rows come sorted by group."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        last, held = None, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = [batch.column(g) for g in group]
            change = np.zeros(n, dtype=bool)
            for key in keys:
                one, two = key.slice(1), key.slice(0, n - 1)
                same = pc.fill_null(pc.equal(one, two), pa.scalar(False))
                same = pc.or_(same, pc.and_(pc.is_null(one), pc.is_null(two)))
                change[1:] |= ~same.to_numpy(zero_copy_only=False)
            first = tuple(key[0].as_py() for key in keys)
            weights = [np.ones(n, dtype=np.int64)]
            weights += [pc.fill_null(batch.column(s), 0).to_numpy(zero_copy_only=False) for s in sums]
            starts = np.flatnonzero(change)
            run_of = np.searchsorted(starts, np.arange(n), side="right")
            columns = []
            for i, weight in enumerate(weights):
                total = np.cumsum(weight)
                before = np.concatenate(([0], total[starts - 1]))
                made = total - before[run_of]
                if last == first:
                    made[run_of == 0] += held[i]
                columns.append(made)
            last, held = tuple(key[n - 1].as_py() for key in keys), [c[-1] for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, pa.int64()) for c in columns)],
                [*batch.schema.names, "_n", *(f"_sum_{s}" for s in sums)],
            )

    return run


def positions(rows: DataFrame, group: list[str], order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``position``, from 1, in the order of ``order`` within ``group``, and ``running_<name>`` for the bigint columns ``sums``.

    Keep ``rows`` slim: they are moved once and written once. Rows that agree in the whole order are placed in any order.
    """
    sums = list(sums)
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    fields = [f"`{c}` {t}" for c, t in rows.dtypes] + ["_n bigint", *(f"`_sum_{s}` bigint" for s in sums)]
    counted = dealt.mapInArrow(_counted(group, sums), ", ".join(fields)).withColumn("_part", F.spark_partition_id())
    counted = materialise(counted, "positions")
    totals = counted.groupBy(*group, "_part").agg(F.max("_n").alias("_n"), *(F.max_by(f"_sum_{s}", "_n").alias(f"_sum_{s}") for s in sums))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    measures = ["_n", *(f"_sum_{s}" for s in sums)]
    offsets = totals.select(
        *[F.col(g).alias(f"_of_{g}") for g in group], F.col("_part").alias("_of_part"),
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_before{m}") for m in measures],
    )
    meets = F.col("_part") == F.col("_of_part")
    for g in group:
        meets &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return counted.join(offsets, meets).select(
        *rows.columns,
        (F.col("_n") + F.col("_before_n")).alias("position"),
        *[(F.col(f"_sum_{s}") + F.col(f"_before_sum_{s}")).alias(f"running_{s}") for s in sums],
    )
